"""Bulk web-site audits on Spark: page records, structured-data checks, scores and site reports as DataFrames."""
