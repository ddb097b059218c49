"""parley: a PySpark-native keyword-retrieval engine over stored conversations."""
