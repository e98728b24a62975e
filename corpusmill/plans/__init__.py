"""Registered queries: importing this package fills the registry."""

from . import records, searches, states, texts

__all__ = ["records", "searches", "states", "texts"]
