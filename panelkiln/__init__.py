"""Spark-native panel analytics: factor research operators as lazy DataFrame plans."""
