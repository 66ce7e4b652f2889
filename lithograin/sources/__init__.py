"""Tables on Parquet."""
