"""terrane: a PySpark-native engine for spatial co-occurrence and community analysis."""
