"""Windows, joins, aggregates, anomalies and blends over panels."""
