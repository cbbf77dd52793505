"""Spark-native analysis of source layout, with tables in and tables out."""
