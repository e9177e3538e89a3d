"""Analytics for the operation of data pipelines, as PySpark jobs."""
