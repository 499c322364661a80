"""tesserae: document-knowledge analytics on Spark (blocks, chunks, an embedding index, retrieval, review)."""
