"""Operators of the feedloom engine."""
