"""A PySpark-native analytics engine: relational core, small SQL dialect, search, sources and streaming."""
