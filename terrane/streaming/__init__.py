"""Summaries that follow a stream of events."""

from .refresh import windowed_means

__all__ = ["windowed_means"]
