"""Spark-native analytics for genomic intervals, transcript structures and the
semi-structured records around them.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (whole queries
over a table directory) and ``streaming``.
"""
