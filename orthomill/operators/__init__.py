"""DataFrame operators, grouped by the kind of data they work on."""
