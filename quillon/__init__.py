"""Single-table analytics over CSV, Parquet and streams, written as Spark DataFrame jobs."""
