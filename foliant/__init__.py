"""A PySpark engine for filings, market text and the corpora trained on them."""
