"""DataFrame operators: relational, statistics, vectors, evaluation, models."""
