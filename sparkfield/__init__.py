"""A PySpark-native engine for compressed numeric arrays and the queries around them."""
