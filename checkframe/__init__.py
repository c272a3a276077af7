"""PySpark-native data validation: rules compile to plain Spark columns."""
