"""Structured Streaming forms of the profile operators."""
