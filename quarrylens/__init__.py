"""Spark-native analytics over source-code corpora: files, tokens, symbols, issues and reports as DataFrames."""

__version__ = "0.1.0"
