"""DataFrame -> DataFrame operators (filters, joins, aggregations, graph loops)."""
