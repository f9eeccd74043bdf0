"""Shared-folder and materialisation helpers for the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from versight.functions.store import discard, scratch, shared_dir, written

__all__ = ["discard", "let", "scratch", "shared_dir", "written"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
