"""spanloom: Spark-native, explainable person-mention analytics over document collections."""
