"""Ready-made compositions of operators and the query registry."""
