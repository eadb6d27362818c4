"""Schemas, loaders and sinks for the five quality-control tables."""
