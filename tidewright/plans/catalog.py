"""Import every topic so its queries are registered."""

from . import activity, charting, cleaning, encoding, flows, learning, profiling, sampling, scaling, scanning, texts, tracking  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
