"""Spark-native cluster analysis: prepare, cluster, score, explain, and ask "what if"."""
