"""Corpus operators on PySpark: DataFrame in, DataFrame out."""
