"""An inverted index that is refreshed by increments.

Every refresh writes one immutable segment: postings (segment, doc_id, len, term,
tf) and documents (segment, doc_id, len). Rows of older segments that it replaces
or removes are named in ``gone``, and the segment's counts of live documents and
tokens go down by theirs. A version's document number and mean length are sums
over its segments; a term's frequency is counted over its live postings. So the
scores are those of an index built from the live documents at once.

Segments of like size are merged when there are ``FAN`` of them, so a posting is
rewritten once a tier, and readers meet few segments a tier. All changes are
versions of one commit log (``sources.versions``): a search reads one version.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.versions import Conflict, Versions
from . import ranking

FAN = 4
#: Replaced rows that are broadcast (some 100 MB).
GONE_ROWS = 2_000_000
POSTINGS, DOCUMENTS, GONE = "postings", "documents", "gone"


def _tier(segment: dict, fan: int) -> int:
    return int(math.log(max(1, segment["docs"]), fan))


def _state(index: Versions, version: int | None = None) -> dict:
    state = index.state(version)
    if not state["facts"]:
        state["facts"] = {"segments": {}}
    return state


def _with(tables: dict, name: str, more: dict) -> dict:
    """``tables`` with the folders of ``more`` added to one of them."""
    old = tables.get(name, {"folders": []})["folders"]
    return tables | {name: {"schema": more["schema"], "folders": [*old, *more["folders"]]}}


def _live(index: Versions, state: dict, name: str, only: list[str] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Rows of a table of segments that no later refresh has replaced, those of ``terms`` if they are given.

    Terms are cut first. What is gone is broadcast up to ``GONE_ROWS`` rows, so that
    postings are not shuffled by document to take it off.
    """
    rows = index.read(name, state)
    rows = rows if only is None else rows.where(F.col("segment").isin(only))
    rows = rows if terms is None else rows.join(ranking.small(terms), "term", "left_semi")
    if not state["tables"].get(GONE, {"folders": []})["folders"]:
        return rows
    gone = index.read(GONE, state).select("segment", "doc_id")
    gone = gone if only is None else gone.where(F.col("segment").isin(only))
    few = gone.limit(GONE_ROWS + 1).count() <= GONE_ROWS
    return rows.join(F.broadcast(gone) if few else gone, ["segment", "doc_id"], "left_anti").select(rows.columns)


def _segment(index: Versions, postings: DataFrame, documents: DataFrame) -> tuple[dict, dict, str, dict]:
    """Staged postings and documents of a new segment, its name and its figures."""
    name = uuid.uuid4().hex
    mark = F.lit(name).alias("segment")
    ordered = postings.select("doc_id", "len", "term", "tf").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    p = index.stage(ordered.select(mark, "doc_id", "len", "term", "tf"), POSTINGS)  # the name is not shuffled
    d = index.stage(documents.select(mark, "doc_id", "len"), DOCUMENTS)
    docs, tokens = index.spark.read.parquet(f"{index.root}/data/{d['folders'][0]}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return p, d, name, {"docs": docs, "tokens": tokens, POSTINGS: p["folders"][0], DOCUMENTS: d["folders"][0]}


def refresh(index: Versions, docs: DataFrame | None = None, removed: DataFrame | None = None, text: str = "text", fan: int = FAN) -> int:
    """Add or replace ``docs`` (by doc_id) and remove doc_ids; returns the version.

    Removal comes first: a doc_id in both stays as in ``docs``. Rows of ``docs`` that
    share a doc_id are all kept, as a full build does. Null doc_ids replace nothing.
    """
    state = _state(index)
    tables, segments = dict(state["tables"]), {k: dict(v) for k, v in state["facts"]["segments"].items()}
    ids = [x.select("doc_id") for x in (docs, removed) if x is not None]
    if segments and ids:
        old = ids[0] if len(ids) == 1 else ids[0].unionAll(ids[1])
        gone = _live(index, state, DOCUMENTS).join(old.distinct(), "doc_id", "left_semi").select("segment", "doc_id", "len")
        staged = index.stage(gone, GONE)
        lost = index.spark.read.parquet(f"{index.root}/data/{staged['folders'][0]}").groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()  # a row a segment
        for r in lost:
            segments[r.segment]["docs"] -= r.n
            segments[r.segment]["tokens"] -= r["len"]
        if lost:
            tables = _with(tables, GONE, staged)
    if docs is not None:
        toks = materialize(ranking.tokenised(docs, text), "tokens")
        posts = ranking.terms_of(toks).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
        p, d, name, figures = _segment(index, posts, toks)
        tables = _with(_with(tables, POSTINGS, p), DOCUMENTS, d)
        segments[name] = figures
    version = index.commit(tables, state["version"], {"segments": segments})
    try:
        return merge(index, fan) if fan else version
    except Conflict:  # another writer was faster; merging can wait, the refresh is in
        return version


def merge(index: Versions, fan: int = FAN) -> int:
    """Merge tiers that hold ``fan`` segments or more, until none does; returns the version."""
    while True:
        state = _state(index)
        segments = state["facts"]["segments"]
        tiers: dict[int, list[str]] = {}
        for name, figures in segments.items():
            tiers.setdefault(_tier(figures, fan), []).append(name)
        full = [names for _, names in sorted(tiers.items()) if len(names) >= fan]
        if not full:
            return state["version"]
        names = full[0]
        p, d, name, figures = _segment(index, _live(index, state, POSTINGS, names), _live(index, state, DOCUMENTS, names))
        kept = {k: v for k, v in segments.items() if k not in names}
        tables = dict(state["tables"])
        for table, more in ((POSTINGS, p), (DOCUMENTS, d)):
            tables[table] = {"schema": more["schema"], "folders": [*(v[table] for v in kept.values()), *more["folders"]]}
        if tables.get(GONE, {"folders": []})["folders"]:
            left = index.read(GONE, state).where(F.col("segment").isin(list(kept)))
            tables[GONE] = index.stage(left, GONE) if kept else {**tables[GONE], "folders": []}
        index.commit(tables, state["version"], {"segments": kept | {name: figures}})


def statistics(index: Versions, version: int | None = None) -> tuple[int, float | None]:
    """Documents and mean length of a version, from its segments' figures."""
    segments = _state(index, version)["facts"]["segments"].values()
    n = sum(s["docs"] for s in segments)
    return n, sum(s["tokens"] for s in segments) / n if n else None


def search(index: Versions, queries: DataFrame, k: int, version: int | None = None, decimals: int | None = None) -> DataFrame:
    """Lexical top k of queries (query_id, query) in one version."""
    state = _state(index, version)
    terms = ranking.query_terms(queries)
    post = _live(index, state, POSTINGS, terms=terms.select("term").distinct())
    scored = ranking.bm25_of_postings(terms, post, statistics(index, state["version"]), decimals)
    return ranking.ranked(scored, [F.col("score"), F.col("doc_id")], k)
