"""A PySpark-native engine for declarative relational plans."""
