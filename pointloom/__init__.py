"""Spark-native 3-D point-cloud, mesh and event analytics."""
