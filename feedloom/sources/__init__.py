"""Sources of the feedloom engine."""
