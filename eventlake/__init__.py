"""A PySpark-native analytics engine for append-only event logs."""
