"""Risk analytics on Spark: every trial is a row, every input and result a column."""
