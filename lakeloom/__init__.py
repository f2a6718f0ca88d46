"""A PySpark-native real-time commerce warehouse and feature store."""
