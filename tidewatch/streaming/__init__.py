"""Rules over streams: durable state, late correction, deduplication, metrics."""
