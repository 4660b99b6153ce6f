"""Text-corpus curation, structuring, retrieval and audit as PySpark DataFrame operators."""
