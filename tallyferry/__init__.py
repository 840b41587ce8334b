"""Bulk export, validated import and run-history analytics on Spark DataFrames."""
