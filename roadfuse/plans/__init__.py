"""Jobs over stored tables, and the catalogue of queries with their SQL twins."""
