"""rowsmith: a Spark-native engine for record queries with declarative clauses and Python expressions."""

__version__ = "0.1.0"
