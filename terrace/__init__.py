"""terrace: a PySpark-native analytics engine for spatial-capture and sequence data."""
