"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes: ``h = 2 h + GEAR[byte] mod 2**32``, so
it depends on the last 32 bytes only and a chunk boundary moves with its text.
Chunking is normalised: up to ``AVERAGE`` bytes a boundary needs one bit more
than log2(AVERAGE), from there on one bit less; no chunk is under ``LEAST``
(but the last) or over ``MOST`` bytes.

A fingerprint is the sorted set of ``digest.length`` of the chunks. The
likeness of two fingerprints is the length of the chunks they share over the
length of the larger one, i.e. how far the larger text is contained in the
other; 1 for equal fingerprints, two empty ones included.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import import_path, plan_bytes
from .arrowio import batched, map_arrow, rows_of

AVERAGE, LEAST, MOST = 64, 16, 256


def gear_table(seed: int = 2024) -> np.ndarray:
    """256 32-bit values from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte, by doubling the span of partial sums."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        if len(h) <= span:
            break
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h = more
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    bits = AVERAGE.bit_length() - 1
    h = gear_hashes(data)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - bits + 1)))
    hard = easy[h[easy] < np.uint32(1 << (32 - bits - 1))]
    easy, hard = (easy + 1).tolist(), (hard + 1).tolist()
    ends, start, n = [], 0, len(data)
    while n - start > LEAST:
        middle, last = min(start + AVERAGE, n), min(start + MOST, n)
        at = bisect_left(hard, start + LEAST)
        if at < len(hard) and hard[at] < middle:
            end = hard[at]
        else:
            at = bisect_left(easy, middle)
            end = easy[at] if at < len(easy) and easy[at] < last else last
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str | None) -> dict[int, int]:
    """48-bit digest -> length in bytes of the distinct chunks."""
    data = text.encode() if text else b""
    out, start = {}, 0
    for end in cut_points(data):
        out[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return out


def encode(chunks: dict[int, int]) -> str:
    return ",".join([f"{d:012x}.{n}" for d, n in sorted(chunks.items())])


def decode(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(".") for x in fingerprint.split(",") if x)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if a == b:
        return 1.0
    return sum(a[x] for x in a.keys() & b.keys()) / max(sum(a.values()), sum(b.values()))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; null text counts as empty."""
    from .arrowio import map_rows

    return map_rows(documents.select("doc_id", "text"), lambda: lambda r: [(r[0], encode(chunk_set(r[1])))], "doc_id long, fingerprint string", limit=200)


def in_order(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, text dealt into runs of descending doc_id, one run a partition.

    ``next_run`` marks, behind the rows of a run, those that follow it: the
    first of the next run, or after the last run the first of all. Run borders
    are ids of the table, so that each run's follower is known from its id.
    Rows of one doc_id, and rows without one, are one run and so one task, streamed in
    the order of their texts: doc_id is taken for a key that few rows share.
    """
    spark = documents.sparkSession
    import_path(spark)
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(plan_bytes(documents) >> 26, 100_000))
    steps = [i / partitions for i in range(1, partitions + 1)]
    found = documents.select(F.percentile_approx("doc_id", steps, max(10_000, 10 * partitions)).alias("q"), F.max("doc_id").alias("m")).first()
    borders = np.array(sorted({*(found["q"] or ()), *([] if found["m"] is None else [found["m"]])}), np.int64)

    @F.pandas_udf("array<int>")
    def runs(ids: pd.Series) -> pd.Series:
        # nulls come last of all, in run 0; the ids at a border also follow the run above it
        known = ids.notna().to_numpy()
        at = np.zeros(len(ids), np.int64)
        at[known] = np.searchsorted(borders, ids[known].astype("int64").to_numpy())
        edge = known.copy()
        edge[known] = borders[at[known]] == ids[known].astype("int64").to_numpy()
        if not len(borders):
            edge[:] = True
        after = (at + 1) % max(1, len(borders))
        return pd.Series([[a, b] if e else [a] for a, b, e in zip(at.tolist(), after.tolist(), edge.tolist(), strict=True)])

    dealt = documents.select("doc_id", "text", F.posexplode(runs("doc_id")).alias("next_run", "run"))
    return (
        dealt.repartitionById(max(1, len(borders)), F.col("run"))
        .sortWithinPartitions("run", "next_run", F.col("doc_id").desc_nulls_last(), "text")
        .select("run", F.col("next_run").cast("boolean").alias("next_run"), "doc_id", "text")
    )


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint against its edited text and the next document.

    The next document is the one behind it in descending doc_id (rows of equal
    doc_id by text, null ids last), and after the last one the first. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, one row for each row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def pairs(batches):
        held = None
        for run, follows, doc_id, text in rows_of(batches, 64):
            text = text or ""
            if held and held[0] != run:
                held = None
            if follows and held is None:
                continue  # a run needs one follower only
            chunks = chunk_set(text)
            if held:
                _, old_id, old, had = held
                edited = edit(old, text)
                new = chunk_set(edited)
                yield old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), encode(had), encode(new), likeness(had, new), likeness(had, chunks)
            held = None if follows else (run, doc_id, text, chunks)

    def run_all(batches):
        return batched(pairs(batches), arrow, 200)

    return map_arrow(in_order(documents, partitions), run_all, schema)
