"""Import every operator so that its query is registered."""

from . import (  # noqa: F401
    decontamination,
    exact_dedup,
    hilbert,
    licences,
    merkle,
    negatives,
    packing,
    piece_bpe,
    pseudo_lm,
    simhash,
    token_counts,
    toxicity,
    url_rules,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
