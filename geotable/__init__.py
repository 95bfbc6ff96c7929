"""geotable: a PySpark-native engine for tables of nested vector geometries."""
