"""Spark-native workbench for messy tables and text corpora."""
