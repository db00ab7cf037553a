"""A PySpark-native engine for provenance, deduplication and corpus analytics."""
