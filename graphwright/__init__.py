"""graphwright: validation, rules and queries over graph-shaped data, planned as Spark DataFrames."""
