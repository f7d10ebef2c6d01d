"""Readers and sinks: price and climate files in the shapes they are published in."""
