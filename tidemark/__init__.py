"""Spark-native data operators for SQL results, status streams and cluster snapshots."""
