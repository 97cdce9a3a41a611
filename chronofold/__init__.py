"""A PySpark-native engine for schedule material: text in, validated calendar events out."""
