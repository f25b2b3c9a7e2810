"""Grounding of claims by local alignment with the cited text.

The words of a claim are aligned with those of the text: equal words gain
``MATCH``, other pairs and gaps cost ``MISS``, and the best run of any length counts
(Smith and Waterman). A claim that is quoted in part scores its part, one whose
words are reordered scores its longest ordered run, so both rank below a true
quotation, where ratios of shared words can't tell them apart.

Only bands are filled: the diagonals within ``BAND`` of one that holds an equal
pair of words. Farther from any match an alignment has only losses. Pairs are
dealt out by Spark; the table of a pair is one row at a time in memory.

Defined results: null and empty claims and texts align to nothing, with a score of
0 and a null span; of equal scores the alignment that ends first counts, in the
text and then in the claim.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_tokens
from ..session import import_path

MATCH, MISS, BAND = 2, 1, 8
_SPAN = "score int, first int, last int, share double"


def align(claim: list[str], text: list[str], band: int = BAND) -> tuple[int, int | None, int | None, float]:
    """(score, first and last aligned word of the text from 0, score as a share of a whole quotation's)."""
    m, n = len(claim), len(text)
    if not m or not n:
        return 0, None, None, 0.0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(claim))}
    a = np.array([numbers[w] for w in claim])
    b = np.array([numbers.get(w, -1) for w in text])
    # diagonals text place - claim place that hold a match, widened to bands
    places = {i: np.flatnonzero(a == i) for i in range(len(numbers))}
    hits = np.flatnonzero(b >= 0)
    if not len(hits):
        return 0, None, None, 0.0
    open_ = np.zeros(n + m + 2 * band + 1, np.int32)
    for j in hits.tolist():
        d = j - places[b[j]] + m
        np.add.at(open_, d, 1)
        np.add.at(open_, d + 2 * band + 1, -1)
    open_ = np.cumsum(open_) > 0  # of diagonal d - band
    last = np.zeros(m + 1, np.int64)  # column of the text word before: scores, and where they began
    origin = np.zeros(m + 1, np.int64)
    best = (0, None, None)
    rows = np.arange(1, m + 1)
    for j in range(n):
        inside = open_[j - rows + 1 + m + band]
        step = np.where(a == b[j], MATCH, -MISS)
        diagonal, up = last[:-1] + step, last[1:] - MISS
        score = np.maximum(np.maximum(diagonal, up), 0)
        start = np.where(diagonal >= up, np.where(last[:-1] > 0, origin[:-1], j), origin[1:])
        score = np.where(inside, score, 0)
        # gaps in the text: a running maximum of score + place, for a loss of one a place
        raised = score + rows * MISS
        run = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == run, np.arange(m), 0))
        filled = np.where(inside, np.maximum(run - rows * MISS, 0), 0)
        start = np.where(filled > score, start[source], start)
        last = np.concatenate((np.zeros(1, np.int64), filled))
        origin = np.concatenate((np.zeros(1, np.int64), start))
        top = int(filled.max())
        if top > best[0]:
            best = (top, int(start[int(filled.argmax())]), j)
    return (*best, best[0] / (MATCH * m))


def ground(pairs: DataFrame, band: int = BAND) -> DataFrame:
    """The pairs (claim, text and others) with score, first, last and share; ``alignment`` holds these four."""
    import_path(pairs.sparkSession)

    @F.pandas_udf(_SPAN)
    def run(claims: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(list(c), list(t), band) for c, t in zip(claims, texts, strict=True)], columns=["score", "first", "last", "share"]).astype({"first": "Int32", "last": "Int32"})

    found = run(document_tokens(F.col("claim")), document_tokens(F.col("text")))
    return pairs.select(F.struct("*").alias("row"), found.alias("alignment")).select("row.*", "alignment")
