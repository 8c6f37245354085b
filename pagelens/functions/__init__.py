"""Column functions: text rules of HTML pages, and URLs."""
