"""Readers and writers of grids, point tables and shapes."""
