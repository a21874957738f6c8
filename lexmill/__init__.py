"""Corpus analytics on PySpark: DataFrame-to-DataFrame operators for text corpora."""
