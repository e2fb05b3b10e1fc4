"""Table-level operators: joins, aggregates, reshaping, ranking, statistics."""
