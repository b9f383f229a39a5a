"""PySpark-native analytics for network accessibility: pure functions from DataFrame to DataFrame."""
