"""Training-data operators: sharding, extraction, scoring, decontamination, filtering, tokenising, deduplication, scanning."""
