"""Tables that audits read and write."""
