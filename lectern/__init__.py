"""lectern: document-to-ranking analytics as PySpark DataFrame transformations."""
