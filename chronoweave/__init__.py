"""Change analytics on PySpark: event chains, graphs, rules and reports as DataFrames."""
