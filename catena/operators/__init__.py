"""Operators on cells, flow trees, channel networks and channel profiles."""
