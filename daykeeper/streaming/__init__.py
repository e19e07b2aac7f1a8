"""Structured Streaming forms of the progress, status and catch-up operators."""
