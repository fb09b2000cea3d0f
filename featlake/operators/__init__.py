"""DataFrame operators: projection, filters, joins, aggregation, features, encoders, windows, clickstream, paths, profiling."""
