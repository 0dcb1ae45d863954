"""tesserae: set-based text enrichment and corpus analytics on PySpark."""
