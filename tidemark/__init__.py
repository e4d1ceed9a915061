"""Windowed log analytics on Spark."""

from tidemark.engine import LogAnalytics
from tidemark.session import tune
from tidemark.sources.store import WindowStore

__all__ = ["LogAnalytics", "WindowStore", "tune"]
