"""signal_lake: a PySpark-native engine for time-series factor research and training-data preparation."""
