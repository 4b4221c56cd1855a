"""Automatic analysis of tabular data as Spark DataFrame operators."""
