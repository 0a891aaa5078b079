"""Training-data operators: near-dedup, filters, scoring, packing, archives."""
