"""loam: a PySpark engine for text knowledge bases, their event logs and training corpora."""
