"""foliomill: document structure, enrichment and reading queries on PySpark DataFrames."""
