"""Aggregate mobility analytics and disclosure-risk auditing on Spark."""
