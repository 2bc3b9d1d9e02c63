"""fotolith: a PySpark-native analytics engine for photograph catalogues."""
