"""Spark-native engine for curating code and text corpora and analysing evaluation runs."""
