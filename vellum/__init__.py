"""Catalogue, change-log and sequence operators for Spark DataFrames."""
