"""Spark-native operators for labelled event and clip datasets, and (in ``llm``) for text corpora."""
