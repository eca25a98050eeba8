"""Listening-history analytics on Spark: pure ``DataFrame -> DataFrame`` functions."""
