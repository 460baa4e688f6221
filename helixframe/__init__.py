"""PySpark-native analytics for contact graphs, record stores and sequence data."""
