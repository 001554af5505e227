"""Training-data operators (deduplication, packing, language ID, PII, ...)."""
