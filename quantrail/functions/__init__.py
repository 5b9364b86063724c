"""Column and SQL expressions: random numbers, distributions, special functions, finance and sheet functions."""
