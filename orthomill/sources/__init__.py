"""Reading and writing: files, tile documents, vector layers, detections."""
