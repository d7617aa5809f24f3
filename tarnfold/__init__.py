"""Document retrieval and catalogue analytics on PySpark."""
