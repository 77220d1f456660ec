"""Keyed station time series and event nowcast analytics on Spark."""
