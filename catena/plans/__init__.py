"""Whole analyses, driven by parameter files."""
