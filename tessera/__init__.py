"""A PySpark-native analytics engine for cohort-style tables."""
