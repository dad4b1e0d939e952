"""Reading landing data and reading and writing tables."""
