"""Named queries of the feedloom engine."""

from . import catalog, payloads  # noqa: F401
