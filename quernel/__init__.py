"""A PySpark-native engine for fitting, comparing and checking parametric distributions."""
