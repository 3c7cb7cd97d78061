"""Find, replace and restore personal data in tables of documents, on Spark."""
