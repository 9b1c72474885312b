"""Palimp: layered analysis of versioned, multi-author text on Spark."""
