"""DataFrame operators: schema, duplicates, similarity, selection, reports, metrics, models."""
