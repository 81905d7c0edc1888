"""Load-series analytics expressed as Spark DataFrame and streaming operators."""
