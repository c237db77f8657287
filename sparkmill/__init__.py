"""Spark-native analytics for metagenomic binning."""
