"""Operators on tables of pages: records, audits, structured data, scores, sites."""
