"""Column builders: statistics of a row's columns and of groups."""
