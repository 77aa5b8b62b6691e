"""Streaming of the clustered analytics engine."""
