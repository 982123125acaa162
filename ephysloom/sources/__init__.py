"""Readers of text tables and recordings, sinks and run registries."""
