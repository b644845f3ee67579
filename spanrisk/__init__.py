"""Inventory risk analytics on Spark."""
