"""Label-capture analytics as PySpark jobs."""
