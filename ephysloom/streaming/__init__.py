"""Structured Streaming jobs: bursts, windows, edges and parts as they arrive."""
