"""Readers, adapters, profiling and writers."""
