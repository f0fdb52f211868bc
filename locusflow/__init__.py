"""PySpark-native analytics engine for short-read genomic data."""
