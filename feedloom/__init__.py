"""feedloom: survey-feedback and training-data analytics as composable DataFrame plans."""

__version__ = "0.1.0"
