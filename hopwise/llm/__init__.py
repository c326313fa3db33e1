"""Training-data operators on Spark DataFrames.

Nothing outside this folder imports it; `queries` holds the registered queries.
"""
