"""folioforge: document-collection analytics as PySpark DataFrame plans."""
