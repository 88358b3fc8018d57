"""Readers and writers."""

from .files import *  # noqa: F403
