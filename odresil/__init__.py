"""odresil: a PySpark-native analytics engine for origin-destination mobility under disruption."""
