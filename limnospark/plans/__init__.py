"""Registered queries: each operator of the inventory run on the driver
tables, paired (where SQL can express it) with an equivalent DuckDB query."""
