"""Deal-financing analytics and text-data operators on PySpark."""
