"""Curation and search of a captioned media corpus on Spark DataFrames."""
