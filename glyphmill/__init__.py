"""glyphmill: a PySpark-native engine for symbol catalogues, code lint and their data upkeep."""
