"""Tidewright: Spark-native table preparation, AutoML and chart-data operators."""

from .session import durable, local_session, scratch_path, spread

__all__ = ["durable", "local_session", "scratch_path", "spread"]
