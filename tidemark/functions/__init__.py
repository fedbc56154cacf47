"""Column-level helpers and fixed vocabularies."""
