"""Whole queries over a directory of Parquet tables."""
