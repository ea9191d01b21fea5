"""Functions of the feedloom engine."""
