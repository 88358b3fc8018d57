"""Incremental counting over document streams."""

from .incremental import count_stream  # noqa: F401
