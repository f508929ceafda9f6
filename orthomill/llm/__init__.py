"""Corpus operators for the project's texts and vectors: review notes, tile features, web pages.

The text record is a reviewer's feedback row, ``(tile_id, source_file, notes)``; other
columns pass by unread. Nothing outside this package imports it.
"""
