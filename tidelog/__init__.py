"""tidelog: log analytics on PySpark."""
