"""Delivery-risk analytics on Spark: ingestion, redaction, features, scoring, drift, reports."""

__version__ = "0.1.0"
