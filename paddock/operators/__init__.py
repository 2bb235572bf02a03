"""Table-level operators: features, standings, datasets, training, metrics."""
