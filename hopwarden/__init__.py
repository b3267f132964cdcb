"""PySpark-native analytics over inter-domain routing links."""
