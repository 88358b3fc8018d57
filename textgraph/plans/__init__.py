"""Whole builds composed of operators."""

from .constructor import GraphConstructor, QuestionAnswering  # noqa: F401
