"""DataFrame operators: prepare, aggregate, join, look up, score, validate, train."""
