"""Training-data operators: deduplication, packing, scoring, scanning and archives."""
