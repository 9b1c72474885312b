"""Lineage of streams that grow."""
