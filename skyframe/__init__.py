"""skyframe: a PySpark-native engine for large sky and time partitioned catalogues."""
