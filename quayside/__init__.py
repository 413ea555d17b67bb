"""Demand panels at scale: features, forecasts, evaluation, anomalies and blends as Spark plans."""
