"""Spark-native analytics of count matrices and genomic intervals."""
