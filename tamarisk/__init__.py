"""Prompt compression and text analytics on Spark."""
