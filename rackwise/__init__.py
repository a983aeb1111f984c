"""Consignment-retail analytics on Spark: DataFrames in, DataFrames out."""

from rackwise.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
