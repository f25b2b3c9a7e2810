"""Benchmark decontamination with one Aho-Corasick automaton over words.

Every window of ``window`` consecutive words of a benchmark item (the whole item
if it has fewer words) is a pattern. Patterns are sequences of word numbers, so
one pass over a document's words finds all of them at once, and a match never
begins or ends inside a word. Hit words are mapped back to code-point offsets of
the original text.

The benchmark is read to the driver in blocks of some ``block_words`` words,
sized by a count taken first. A window adds as many nodes as it has words at
most, so a block's automaton has some ``window * block_words`` nodes: 88 MB in a
Python worker for 200,000 random words at the default window. Each block is one
broadcast and one pass over the documents, whose hits are written before the next
begins, so that a task never holds two automata; a larger benchmark needs more
passes, not more memory, and nothing is left out. With several blocks the rows are
written once with numbers, and a block adds the rows that it hits. Blocks are dealt by item, so an item with
more words than a block makes its block larger.

Defined results: null or empty text has no words and no hits; an item without
words has no windows; a repeated ``item_id`` counts once; a null ``item_id``
counts as an item of its own and is written as an empty string.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize, release
from .arrowio import map_rows
from .words import letter_words

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "array<struct<start:int,end:int>>"


def build_automaton(items: list[tuple], window: int):
    """(word -> number, automaton or None, owners); a pattern's value is a place in owners: (length, item ids)."""
    numbers: dict[bytes, int] = {}
    owners: list[tuple[int, frozenset]] = []
    places: dict[tuple[int, frozenset], int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def place(owner: tuple[int, frozenset]) -> int:
        if owner not in places:
            places[owner] = len(owners)
            owners.append(owner)
        return places[owner]

    for item_id, text in items:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in letter_words(text))
        size = min(window, len(ids))
        mine = frozenset((item_id,))
        for at in range(len(ids) - size + 1 if size else 0):
            pattern = ids[at : at + size]
            old = automaton.get(pattern, -1)
            automaton.add_word(pattern, place((size, mine if old < 0 else owners[old][1] | mine)))
    if not owners:
        return numbers, None, owners
    automaton.make_automaton()
    return numbers, automaton, owners


def find_hits(words: list[bytes], numbers: dict[bytes, int], automaton, owners: list[tuple[int, frozenset]]) -> tuple[list[list[int]], set]:
    """Merged word ranges [first, after last] of all occurrences, and their items."""
    get = numbers.get
    spans: list[list[int]] = []
    items: set = set()
    for last, place in automaton.iter(tuple([get(w, 0) for w in words])):
        length, who = owners[place]
        first = last - length + 1
        items |= who
        while spans and spans[-1][0] >= first:
            spans.pop()
        if spans and spans[-1][1] >= first:
            spans[-1][1] = last + 1
        else:
            spans.append([first, last + 1])
    return spans, items


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(map(list, spans)):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def char_spans(text: str, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Ordered word ranges as code-point ranges of the original text."""
    data = text.encode()
    edges = [m.span() for m in _WORD.finditer(data)]
    out, at, chars = [], 0, 0
    for first, last in spans:
        places = []
        for byte in (edges[first][0], edges[last - 1][1]):
            chars += byte - at if len(data) == len(text) else len(data[at:byte].decode())
            at = byte
            places.append(chars)
        out.append((places[0], places[1]))
    return out


_HIT_COLUMNS = f"n_words long, n_hit long, item_ids array<string>, word_spans {HITS}, char_spans {HITS}"


def _row_of(keys, text: str | None, n_words: int, spans: list[list[int]], items: set[str]) -> tuple:
    as_structs = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
    chars = char_spans(text, spans) if spans else []
    return keys, text, n_words, sum(b - a for a, b in spans), sorted(items), as_structs(spans), as_structs(chars)


def _names(items: set) -> set[str]:
    return {"" if x is None else str(x) for x in items}


def _one_pass(rows: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """Hits of one block in rows of keys and text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def make():
        numbers, automaton, owners = build_automaton(shared.value, window)

        def each(row):
            words = letter_words(row[1])
            spans, found = find_hits(words, numbers, automaton, owners) if automaton and words else ([], set())
            yield _row_of(*row, len(words), spans, _names(found))

        return each

    return map_rows(rows, make, StructType([*rows.schema, *StructType.fromDDL(_HIT_COLUMNS)]), limit=256)


def _block_hits(rows: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """row, spans and item_ids of the rows (row, text) that one block hits."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def make():
        numbers, automaton, owners = build_automaton(shared.value, window)

        def each(row):
            words = letter_words(row[1])
            spans, found = find_hits(words, numbers, automaton, owners) if automaton and words else ([], set())
            if found:
                yield row[0], [{"start": a, "end": b} for a, b in spans], sorted(_names(found))

        return each

    return map_rows(rows, make, f"row long, spans {HITS}, item_ids array<string>")


def _many_passes(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """Hits of several blocks: the rows are written once with numbers, each block adds the hits of its rows only."""
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    parts = [materialize(_block_hits(numbered.select("row", "text"), [tuple(r) for r in block.collect()], window), "benchmark-block") for block in blocks]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    found = found.groupBy("row").agg(F.collect_list(F.struct("spans", "item_ids")).alias("found"))

    def make():
        def each(row):
            keys, text, hits = row
            spans = merge_spans([[x["start"], x["end"]] for h in hits or () for x in h["spans"]])
            yield _row_of(keys, text, len(letter_words(text)), spans, {i for h in hits or () for i in h["item_ids"]})

        return each

    met = numbered.join(found, "row", "left").select("keys", "text", "found")
    out = materialize(map_rows(met, make, StructType([*rows.schema, *StructType.fromDDL(_HIT_COLUMNS)]), limit=256), "benchmark-hits")
    for table in (numbered, *parts):
        release(table)
    return out


def _scan(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int, columns: tuple[str, ...]) -> DataFrame:
    """keys (a struct of ``columns``), text and the hits of every row."""
    bench = benchmark.select("item_id", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    blocks = max(1, -(-(bench.agg(F.sum(words)).first()[0] or 0) // block_words))
    rows = documents.select(F.struct(*columns).alias("keys"), "text")
    if blocks == 1:
        return _one_pass(rows, [tuple(r) for r in bench.collect()], window)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return _many_passes(rows, [bench.where(dealt == b) for b in range(blocks)], window)


def scan(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """Hits of ``benchmark`` in each document.

    Returns doc_id, text, n_words, n_hit, item_ids (sorted as strings),
    word_spans and char_spans (ranges of the original text), one row for each
    row of ``documents``.
    """
    return _scan(documents, benchmark, window, block_words, ("doc_id",)).select("keys.*", "text", "n_words", "n_hit", "item_ids", "word_spans", "char_spans")


def report(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans.

    ``spans`` lists the hit ranges of the original text as start:end in code
    points (end exclusive), comma-joined.
    """
    hits = scan(documents, benchmark, window)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("char_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    # text goes along once, outside of the struct of the others
    rest = tuple(c for c in documents.columns if c != "text")
    hits = _scan(documents, benchmark, window, block_words, rest).where(F.col("n_hit") == 0)
    return hits.select(*[F.col("text") if c == "text" else F.col("keys")[c].alias(c) for c in documents.columns])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
