"""Column expressions; none of them is a Python UDF."""
