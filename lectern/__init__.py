"""lectern: bibliographic and document-corpus analytics as PySpark DataFrame operators."""
