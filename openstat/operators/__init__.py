"""DataFrame-to-DataFrame operators: profiling, joins, tests, ranking, metrics."""
