"""millrace: a PySpark engine for building and curating model training data."""
