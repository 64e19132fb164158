"""Row-local operators on Structured Streaming frames."""

from .guard import BatchOnly, batch_only

__all__ = ["BatchOnly", "batch_only"]
