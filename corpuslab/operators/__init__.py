"""DataFrame operators: selection, aggregation, gates, statistics, vectors, generation, models."""
