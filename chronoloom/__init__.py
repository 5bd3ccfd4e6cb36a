"""chronoloom: interval, trace and training-data analytics on PySpark."""
