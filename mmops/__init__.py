"""Spark-native data operators for multimodal training and evaluation corpora."""
