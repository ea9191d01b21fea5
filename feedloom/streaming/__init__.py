"""Streaming of the feedloom engine."""
