"""corpusloom: a Spark-native engine for ingesting, searching and measuring text corpora."""

__version__ = "0.1.0"
