"""Spark-native engine for labelled time intervals, embeddings and keyed text tables."""
