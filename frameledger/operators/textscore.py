"""Model-based text scores behind one interface: loaded once per worker, whole batches at a time.

``EmbeddingScorer`` is the greedy matching of token vectors (precision: each candidate token's best match, recall: each
reference token's best match) with whatever model gives the vectors; its texts are cut to the length the model takes."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def positive(value) -> int | None:
    """A length limit as given by a tokenizer or model: a whole number above 0, else None (flags are no numbers)."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        n = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if n > 0 else None


def length_limit(*limits) -> int | None:
    """The least of the limits that are positive whole numbers; None if none is."""
    known = [n for n in map(positive, limits) if n is not None]
    return min(known) if known else None


class Scorer:
    """Subclass; ``start`` loads the model (once per worker), ``score`` gives one number per pair."""

    def start(self) -> None:
        pass

    def score(self, references: list[str], candidates: list[str]) -> list[float]:
        raise NotImplementedError


class EmbeddingScorer(Scorer):
    """``load()`` gives a function from (texts, length limit) to one matrix of token vectors per text. ``limits``: what the
    tokenizer and the model say of their lengths. ``baseline``: the score of unrelated texts, to which scores are rescaled."""

    def __init__(self, load: Callable, limits: tuple = (), baseline: float | None = None):
        self.load, self.limit, self.baseline = load, length_limit(*limits), baseline
        self.embed = None

    def start(self):
        if self.embed is None:
            self.embed = self.load()

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def score(self, references, candidates):
        both = self.embed([*references, *candidates], self.limit)
        out = []
        for r, c in zip(both[: len(references)], both[len(references) :]):
            if not len(r) or not len(c):
                out.append(0.0)
                continue
            near = self._unit(np.asarray(r, float)) @ self._unit(np.asarray(c, float)).T
            recall, precision = near.max(1).mean(), near.max(0).mean()
            f1 = 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0
            out.append(float(f1 if self.baseline is None else (f1 - self.baseline) / (1 - self.baseline)))
        return out


def text_score(scorer: Scorer) -> Callable[[Column, Column], Column]:
    """The scorer as a function of two Columns. Only pairs of two texts that are not empty reach it; others are null."""

    @F.pandas_udf(DoubleType())
    def scored(reference: pd.Series, candidate: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(reference), index=reference.index, dtype="float64")
        use = (reference.fillna("") != "") & (candidate.fillna("") != "")
        if use.any():
            scorer.start()
            out[use] = scorer.score(reference[use].tolist(), candidate[use].tolist())
        return out

    return scored
