"""Table-file diagnostics, streaming ingestion and inventory reports on Spark.

Every operator is a function from DataFrames to DataFrames; streaming jobs return
the started ``StreamingQuery``. The session is always passed in.
"""
