"""Operators of the clustered analytics engine."""
