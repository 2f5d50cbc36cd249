"""Spark-native retrieval and processing of 3-D simulation and sensor data."""
