"""Removal of passages that repeat in the corpus, by content-defined line chunks.

A text is cut into lines: at line ends, behind words that end a sentence, and
behind words whose hash is lower than its neighbours' (a soft wrap, so that text
without either is cut too). A chunk ends at a line whose rolling hash, over its
own and the last line's hash, is lower than those of the lines beside it. Both
cuts depend on the text around them only, so they move with it, and a local
minimum never follows another at once, so a chunk within a text has two lines
or more. Where equal words, or lines, follow one another there is no minimum:
``EQUAL`` of them make a line, or a chunk.

Occurrences of a chunk are ordered by doc_id, row and place. The first one stays,
wherever it is; the others are repeats of it, in other documents and in its own.
Consecutive repeats whose first occurrences are consecutive, too, form a segment,
which is compared with the text of its first occurrence byte for byte (but for
the kind of white space) and then extended to both sides, word by word, as far
as the bytes before and behind agree, by ``REACH`` chunks at most (equal chunks
farther away are repeats themselves). Ranges of ``min_words`` words and more are removed with the
white space that follows. What a range repeats lies at a smaller place of the
order, so one copy of it always stays.

Only runs of ``LEAST_RUN`` words and more in repeated chunks are looked at, so a
repeated passage is found by a whole chunk inside of it. ``MIN_WORDS`` is the length
from which on more than 9 in 10 passages are found and go whole, whether on lines of
their own or amid other text (measured over 300 pairs of random texts a case: 98 and
92 in 100 of 40 words, over 99 from 45 on). With a smaller ``min_words`` shorter ones
go where they are found: of 30 words 98 and 95 in 100, of 25 words 93 and 77, of 20
words 76 and 55.

Rows are told apart by a number of their own, so rows that share a doc_id, and
equal rows, repeat one another like any others; a null doc_id counts as the
largest. Defined results: null and empty texts stay as they are; a text that
loses all its words becomes empty (:func:`drop_repeats` drops its row); rows of
one doc_id with a repeated passage keep it in the row that is read first.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize, release, tidy
from . import bloom
from .arrowio import map_arrow, map_texts
from .words import mix, words_of

MIN_WORDS = 40
#: Words in consecutive repeated chunks from which on a passage is looked at.
LEAST_RUN = 4
#: Of equal words or lines in a row so many make a line or a chunk.
EQUAL = 8
#: Chunks by which a segment may grow on either side; a cut moves by less next to other text.
REACH = 2
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _in_order(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of values from ``first`` on, by value and place."""
    lengths = np.diff(np.append(first, n))
    place = np.arange(n, dtype=np.uint64) - np.repeat(first.astype(np.uint64), lengths)
    place *= _SPREAD
    place += values
    return np.add.reduceat(mix(place), first)


def _low(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a value is lower than those beside it, or ends ``EQUAL`` equal ones.

    ``first`` has the first place of each text; values of other texts don't count.
    """
    n = len(values)
    own = np.ones(n + 1, bool)  # whether a value and the one before it belong to one text
    own[first] = False
    own = own[1:n]
    out = np.ones(n, bool)
    out[1:] &= ~own | (values[1:] < values[:-1])
    out[:-1] &= ~own | (values[:-1] < values[1:])
    equal = np.concatenate((np.zeros(1, bool), own & (values[1:] == values[:-1])))
    if equal.any():
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(equal, 0, at))
        out |= run % EQUAL == EQUAL - 1
    return out


def _beside(lines: np.ndarray, sizes: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """16 bits on the lines ``at``: 12 of the hash, and the number of words up to 15; 0 without ``own``."""
    at = np.where(own, at, 0)
    return np.where(own, (lines[at] >> np.uint64(52) << np.uint64(4)).astype(np.int64) | np.minimum(sizes[at], 15), 0)


def chunk_texts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its chunks: hashes, numbers of words, first bytes, and the lines before and behind in 32 bits."""
    words = words_of(texts)
    n = len(words.hashes)
    none = np.empty(0, np.int64)
    if not n:
        return [(none.view(np.uint64), none, none, none)] * len(texts)
    raw = np.frombuffer(words.data, np.uint8)
    last = raw[words.ends - 1]
    stop = (last == 46) | (last == 33) | (last == 63) | _low(words.hashes, words.first)
    feeds = np.flatnonzero(raw == 10)  # every text ends in one
    stop[np.searchsorted(words.starts, feeds) - 1] = True  # a feed before the first word stops the last one, as its end does
    stop[-1] = True
    line_first = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(stop)[:-1] + 1))
    lines = _in_order(words.hashes, line_first, n)
    text_line = np.searchsorted(line_first, words.first)  # first line of each text
    filled = text_line[1:] > text_line[:-1]
    before = np.concatenate((np.zeros(1, np.uint64), lines[:-1]))
    before[text_line[:-1][filled]] = 0
    cut = _low(mix(lines + before * _SPREAD), text_line)
    cut[text_line[1:][filled] - 1] = True
    chunk_line = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(cut)[:-1] + 1))
    hashes = _in_order(lines, chunk_line, len(lines))
    chunk_word = line_first[chunk_line]
    counts, begin = np.append(chunk_word[1:], n) - chunk_word, words.starts[chunk_word]
    sizes = np.append(line_first[1:], n) - line_first
    texts_of = np.searchsorted(chunk_line, text_line)
    inner = np.ones(len(chunk_line) + 1, bool)  # whether a chunk follows another one of its text
    inner[texts_of] = False
    after = np.append(chunk_line[1:], len(lines))
    edges = _beside(lines, sizes, chunk_line - 1, inner[:-1]) << 16 | _beside(lines, sizes, after, inner[1:] & (after < len(lines)))
    out = []
    for i, (a, b) in enumerate(pairwise(texts_of.tolist())):
        out.append((hashes[a:b], counts[a:b], begin[a:b] - words.offset[i], edges[a:b]))
    return out


def _chunked(documents: DataFrame) -> DataFrame:
    """Every row with a number of its own, its order, its other columns and its chunks; a scratch table.

    What follows reads this table, so the numbers stay as they are.
    """
    names = [c for c in documents.columns if c != "text"]
    rest = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(0).alias("_"))
    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), ord_.alias("ord"), rest.alias("rest"), F.col("text").cast("string").alias("text"))

    def make():
        def each(rows):
            for row, (h, n, a, e) in zip(rows, chunk_texts([r[3] for r in rows]), strict=True):
                yield *row, h.view(np.int64), n.astype(np.int32), a.astype(np.int32), e.astype(np.uint32).view(np.int32)

        return each

    chunks = StructType.fromDDL("h array<long>, n array<int>, a array<int>, e array<int>")
    return materialize(map_texts(rows, 3, make, StructType([*rows.schema, *chunks])), "line-chunks")


def _items(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, value) of the items of a list column of longs or ints."""
    lists = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, lists.flatten().to_numpy(zero_copy_only=False)


def _run_words(new: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each item the words of its run; ``new`` marks the first items of runs."""
    first = np.flatnonzero(new)
    return np.repeat(np.add.reduceat(words, first), np.diff(np.append(first, len(words)))) if len(words) else words


def _may_repeat(chunked: DataFrame, groups: DataFrame) -> DataFrame:
    """row, ord, idx, h, n, e of the chunks whose hash may be in ``groups``, in runs of LEAST_RUN words."""
    shared = chunked.sparkSession.sparkContext.broadcast(bloom.build(groups, "h"))

    def run(batches):
        for batch in batches:
            row, place, h = _items(batch, "h")
            n, e = (_items(batch, c)[2] for c in ("n", "e"))
            ok = shared.value.contains(h)
            row, place, h, n, e = (x[ok] for x in (row, place, h, n, e))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            ok = _run_words(new, n) >= LEAST_RUN
            row, place, h, n, e = (x[ok] for x in (row, place, h, n, e))
            key, ord_ = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ord_, place.astype(np.int32), h, n, e)], names=["row", "ord", "idx", "h", "n", "e"])

    return map_arrow(chunked.select("row", "ord", "h", "n", "e"), run, "row long, ord long, idx int, h long, n int, e int")


def _growth(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """How many words a run may gain on a side: any number if the next lines agree, else less than its own line."""
    return np.where((mine == theirs) & (mine > 0), 1 << 20, mine & 15) + np.where(mine & 15 == 15, 1 << 20, 0)


def _segments(repeats: DataFrame, min_words: int) -> DataFrame:
    """row, i0, i1 and home, j0, j1: chunks i0 to i1 of a row repeat chunks j0 to j1 of ``home``.

    Runs that can't reach ``min_words``, by the lines beside them and with the runs
    near them, are left out.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            items = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            idx, n, e, home, at, other = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            order = np.lexsort((idx, row))
            row, idx, n, e, home, at, other = (x[order] for x in (row, idx, n, e, home, at, other))
            gap = np.ones(len(row), bool)
            gap[1:] = (row[1:] != row[:-1]) | (idx[1:] != idx[:-1] + 1)
            first = np.flatnonzero(gap)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            words = np.add.reduceat(n, first) if len(first) else n
            most = words + _growth(e[first] >> 16 & 0xFFFF, other[first] >> 16 & 0xFFFF) + _growth(e[last] & 0xFFFF, other[last] & 0xFFFF)
            # runs that may grow until they touch count together
            far = np.ones(len(first), bool)
            far[1:] = (row[first[1:]] != row[last[:-1]]) | (idx[first[1:]] - idx[last[:-1]] > 2 * REACH + 1)
            ok = np.repeat((words >= LEAST_RUN) & (_run_words(far, most) >= min_words), last - first + 1)
            new = gap.copy()
            new[1:] |= (home[1:] != home[:-1]) | (at[1:] != at[:-1] + 1)
            row, idx, home, at, new = (x[ok] for x in (row, idx, home, at, new))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            key = batch.column(0).to_numpy(zero_copy_only=False)[row[first]]
            small = [x.astype(np.int32) for x in (idx[first], idx[last], at[first], at[last])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *small[:2], home[first], *small[2:])], names=["row", "i0", "i1", "home", "j0", "j1"])

    lists = repeats.groupBy("row").agg(F.collect_list(F.struct("idx", "n", "e", "home", "at", "other")).alias("chunks"))
    return map_arrow(lists, run, "row long, i0 int, i1 int, home long, j0 int, j1 int")


def _home_texts(chunked: DataFrame, segments: DataFrame) -> DataFrame:
    """home, j0, j1 of each segment once, with the bytes of chunks j0 to j1, of the ``REACH`` chunks before and behind."""
    wanted = segments.select("home", "j0", "j1").distinct()
    homes = materialize(segments.select("home").distinct(), "line-homes")
    texts = bloom.split(chunked.select("row", "text", "a"), "row", homes, "home")[0]
    release(homes)
    met = texts.join(wanted, F.col("row") == F.col("home"))
    data = F.col("text").cast("binary")
    start = lambda i: F.coalesce(F.get("a", i), F.length(data))
    borders = [start(F.greatest(F.col("j0") - REACH, F.lit(0))), start(F.col("j0")), start(F.col("j1") + 1), start(F.col("j1") + 1 + REACH)]
    pieces = [F.substring(data, a + 1, b - a) for a, b in pairwise(borders)]
    return met.select("home", "j0", "j1", *[x.alias(name) for x, name in zip(pieces, ("before", "data", "behind"), strict=True)])


def repeats(chunked: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The segments; and row and parts (i0, i1, and the bytes that these chunks repeat, with those around them).

    Hashes of chunks meet once, as longs with map-side combine; from there on a
    Bloom filter lets through only the chunks that may repeat. Each join reads
    tables that have been written, so that Spark may split a very common chunk.
    """
    each = chunked.select(F.explode("h").alias("h"))
    groups = materialize(each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "line-groups")
    found = materialize(_may_repeat(chunked, groups), "line-found")
    firsts = found.groupBy("h").agg(F.min(F.struct("ord", "row", "idx", "e")).alias("o"), F.count("*").alias("k")).where("k > 1")
    firsts = materialize(firsts.select("h", F.col("o.row").alias("home"), F.col("o.idx").alias("at"), F.col("o.e").alias("other")), "line-firsts")
    again = found.join(firsts, "h").where("row <> home or idx <> at")
    segments = materialize(_segments(again, min_words), "line-segments")
    for table in (groups, found, firsts):
        release(table)
    tidy(chunked.sparkSession)
    texts = materialize(_home_texts(chunked, segments), "line-texts")
    tidy(chunked.sparkSession)
    met = segments.join(texts, ["home", "j0", "j1"]).groupBy("row")
    return segments, met.agg(F.collect_list(F.struct("i0", "i1", "before", "data", "behind")).alias("parts"))


def _agree(one: bytes, other: bytes) -> int:
    """The length of the longest common beginning."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n
    low, high = 0, n  # the first low bytes agree, the first high ones don't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if one[:mid] == other[:mid] else (low, mid)
    return low


def _behind(mine: bytes, theirs: bytes) -> int:
    """Bytes at the beginning of ``mine`` that ``theirs`` has, too, in whole words."""
    n = _agree(mine, theirs)
    ends = lambda s: n == len(s) or s[n] == 32
    return n if ends(mine) and ends(theirs) else mine.rfind(b" ", 0, n) + 1


def _before(mine: bytes, theirs: bytes) -> int:
    """Bytes at the end of ``mine`` that ``theirs`` has, too, in whole words."""
    return _behind(mine[::-1], theirs[::-1])


def ranges(data: bytes, a: list[int], parts: list[dict], min_words: int) -> list[tuple[int, int]]:
    """The byte ranges to remove from a text whose chunks begin at ``a``, with the white space behind them."""
    plain = data.translate(_BLANKS)
    start_of = lambda i: a[i] if i < len(a) else len(plain)
    found = []
    for p in parts:
        i, j = p["i0"], p["i1"]
        low, high = a[i], start_of(j + 1)
        theirs = p["data"].translate(_BLANKS)
        core = theirs.rstrip()
        if plain[low:high].rstrip() != core:
            continue
        start = low - _before(plain[a[max(i - REACH, 0)] : low], p["before"].translate(_BLANKS))
        start += len(plain[start:low]) - len(plain[start:low].lstrip())
        end = low + len(core)
        end += _behind(plain[end : start_of(j + 1 + REACH)].rstrip(), (theirs[len(core) :] + p["behind"].translate(_BLANKS)).rstrip())
        found.append((start, end))
    merged: list[list[int]] = []
    for start, end in sorted(found):
        if merged and (start <= merged[-1][1] or not plain[merged[-1][1] : start].strip()):
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out = []
    for start, end in merged:
        if len(plain[start:end].split()) >= min_words:
            while end < len(plain) and plain[end] == 32:
                end += 1
            out.append((start, end))
    return out


def without(data: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without these byte ranges."""
    keep, at = [], 0
    for start, end in gone:
        keep.append(data[at:start])
        at = end
    keep.append(data[at:])
    return b"".join(keep).rstrip(b" \t\n\x0b\x0c\r").decode()


def clean(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``documents`` with the repeats taken out of text, and n_removed.

    n_removed is the number of ranges removed (a column of that name is replaced);
    n_chars, where there is one, is the new length. Only rows that may change are
    shuffled.
    """
    names = [c for c in documents.columns if c != "n_removed"]
    return _cleaned(documents, min_words).select(*[F.col("row")[c].alias(c) for c in names], F.col("removed").alias("n_removed"))


def _cleaned(documents: DataFrame, min_words: int) -> DataFrame:
    """row (a struct of the columns of ``documents``) and removed."""
    chunked = _chunked(documents)
    segments, gone = repeats(chunked, min_words)
    may, other = bloom.split(chunked.select("row", "rest", "text", "a"), "row", segments.select("row").distinct(), "row")
    hit = may.join(gone, "row", "left").select("rest", "text", "a", "parts")

    def make():
        def each(rows):
            for rest, text, a, parts in rows:
                data = text.encode() if parts else b""
                cut = ranges(data, a, parts, min_words) if parts else []
                yield rest, without(data, cut) if cut else text, len(cut)

        return each

    schema = chunked.select("rest", "text").schema.add("n_removed", "long")
    done = map_texts(hit, 1, make, schema, limit=200)
    names = documents.columns
    length = lambda c: F.when(F.col("n_removed") > 0, F.length("text").cast(documents.schema[c].dataType)).otherwise(F.col("rest")[c])
    columns = [(F.col("text") if c == "text" else length(c) if c == "n_chars" else F.col("rest")[c]).alias(c) for c in names]
    rows = done.unionAll(other.select("rest", "text", F.lit(0).cast("long").alias("n_removed")))
    return rows.select(F.struct(*columns).alias("row"), F.col("n_removed").alias("removed"))


def drop_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`clean` without the rows that have lost all their words."""
    cleaned = _cleaned(documents, min_words)
    return cleaned.where((F.col("removed") == 0) | (F.length(F.col("row")["text"]) > 0)).select("row.*")


def report(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_chars, n_removed and text_sha256 of the cleaned texts."""
    cleaned = clean(documents.select("doc_id", "text"), min_words)
    return cleaned.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_removed", F.sha2("text", 256).alias("text_sha256"))
