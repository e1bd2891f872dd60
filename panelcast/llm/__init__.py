"""Operators for training corpora; nothing else in the library imports them."""

from panelcast.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
