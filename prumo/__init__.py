"""prumo: a PySpark-native analytics engine for property-listing data."""
