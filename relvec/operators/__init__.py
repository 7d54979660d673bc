"""DataFrame operators: dictionaries, joins, labels, weights, metrics."""
