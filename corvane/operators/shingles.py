"""Shingles of words: sets of hashes, and signatures that say which sets are equal or may be alike.

Words are hashed where a text is read, each different one of ``ROWS`` documents once; a shingle's hash is
mixed from those of its words, for all shingles of these documents at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.text import FOLD_FROM, FOLD_TO, document_words
from ..session import import_path, spread

#: Texts that are hashed at once, and words whose hashes a task keeps.
ROWS, WORDS = 256, 1 << 18
FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a result depends on every bit of ``x`` (unsigned, of eight bytes)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(word: str) -> int:
    folded = word if word.isascii() else word.translate(FOLD)
    return int.from_bytes(hashlib.blake2b(folded.encode(), digest_size=8).digest(), "little")


class Shingles:
    """Sets of the hashes of texts' shingles of ``width`` words; knows the hashes of up to ``WORDS`` words that it has met.

    A text of fewer words is one shingle, one without words has none.
    """

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def _word(self, word: str) -> int:
        if len(self.known) >= WORDS:
            self.known.clear()
        out = self.known[word] = _hashed(word)
        return out

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the different shingles of texts (words between blanks), text after text and in order, and where each text's begin and end."""
        split = pc.split_pattern(texts, " ")
        each, row = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        full = pc.binary_length(each).to_numpy() > 0  # blanks at either end make empty words
        coded = each.filter(pa.array(full)).dictionary_encode()
        get = self.known.get
        hashed = np.array([get(w) or self._word(w) for w in coded.dictionary.to_pylist()], np.uint64)
        words, row, width = hashed[coded.indices.to_numpy()], row[full], self.width
        n = np.bincount(row, minlength=len(texts))
        first, sizes = np.cumsum(n) - n, np.where(n >= width, n - width + 1, n > 0)
        ends = np.r_[0, np.cumsum(sizes)]
        out = np.zeros(ends[-1], np.uint64)
        for length in range(1, width + 1):  # shorter texts whole
            at = first[n == length] if length < width else np.flatnonzero(np.arange(len(words)) + width <= np.repeat(first + n, n))
            if len(at):
                h = np.zeros(len(at), np.uint64)
                for i in range(length):
                    h = (h ^ words[at + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out[ends[row[at]] + at - first[row[at]]] = _mixed(h)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out[a:b].sort()
        starts = np.zeros(len(out), bool)
        starts[ends[:-1][sizes > 0]] = True
        new = starts
        new[1:] |= out[1:] != out[:-1]
        return out[new], np.r_[0, np.cumsum(new)][ends]


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), type=kind)


def hashes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and sh: hashes of the distinct word shingles of text."""
    import_path(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], StructField("sh", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, ends = shingles.sets(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(h.view(np.int64), ends, arrow.field(1).type)], schema=arrow)

    return docs.select("doc_id", document_words(F.col("text")).alias("text")).mapInArrow(run, schema)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)), _mixed(np.arange(1 << 32, (1 << 32) + n, dtype=np.uint64)) | np.uint64(1)


#: Marks the two sums of a set.
SUMS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def _sums(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(_mixed(h ^ s), first).view(np.int64) for s in SUMS]


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (size of the set of shingles), two sums of its hashes mixed anew, and keys: one a band, of minima of ``rows`` seeded hashes.

    Equal sets have equal sums; different ones of a size have with a chance of 2 ** -128. Texts without words are left out.
    """
    import_path(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], StructField("n", LongType()), StructField("sum1", LongType()), StructField("sum2", LongType()), StructField("keys", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        shingles, (xor, factor) = Shingles(width), _seeds(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, ends = shingles.sets(part.column(1))
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                first, keys = ends[some], np.zeros((len(some), bands), np.uint64)
                for i in range(bands * rows):
                    keys[:, i // rows] = _mixed(keys[:, i // rows] ^ np.minimum.reduceat((h ^ xor[i]) * factor[i], first))
                columns = [part.column(0).take(pa.array(some)), pa.array(np.diff(ends)[some]), *map(pa.array, _sums(h, first)), _lists(keys.view(np.int64).reshape(-1), np.arange(len(some) + 1) * bands, arrow.field(4).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spread(docs.select("doc_id", "text")).select("doc_id", document_words(F.col("text")).alias("text")).mapInArrow(run, schema)


#: A set in a bucket: which part of the bucket it belongs to, and the two parts that are compared there.
PLACES = "array<struct<sum1:bigint,sum2:bigint,bucket:bigint,own:int,low:int,high:int>>"


def dealt(docs: DataFrame, width: int) -> DataFrame:
    """bucket, low, high, own, doc_id, sum1, sum2 and sh of docs (doc_id, text, places): a set for each of its places."""
    import_path(docs.sparkSession)
    schema = StructType([*(StructField(c, LongType()) for c in ("bucket", "low", "high", "own")), docs.schema["doc_id"], StructField("sum1", LongType()), StructField("sum2", LongType()), StructField("sh", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, ends = shingles.sets(part.column(1))
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                sums = np.zeros((2, len(part)), np.int64)
                sums[:, some] = _sums(h, ends[some])
                places = part.column(2)
                row = np.repeat(np.arange(len(part)), np.diff(places.offsets.to_numpy()))
                field = {f.name: places.flatten().field(i).to_numpy() for i, f in enumerate(places.type.value_type)}
                mine = np.flatnonzero((field["sum1"] == sums[0][row]) & (field["sum2"] == sums[1][row]))  # rows may share a doc_id
                for a in range(0, len(mine), ROWS):
                    put = mine[a : a + ROWS]
                    size = np.diff(ends)[row[put]]
                    last = np.r_[0, np.cumsum(size)]
                    inner = np.arange(last[-1]) + np.repeat(ends[row[put]] - last[:-1], size)
                    columns = [*(pa.array(field[c][put].astype(np.int64)) for c in ("bucket", "low", "high", "own")), part.column(0).take(pa.array(row[put])), *(pa.array(x[row[put]]) for x in sums), _lists(h[inner].view(np.int64), last, arrow.field(7).type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", document_words(F.col("text")).alias("text"), F.col("places").cast(PLACES).alias("places")).mapInArrow(run, schema)


def first_alike(rank: np.ndarray, own: np.ndarray, sets: np.ndarray, ends: np.ndarray, least: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set (ranks ascend) the place of the set of lowest rank under its own that it is alike to, or -1, and the likeness; of sets of that rank the most alike.

    Sets go one after the other through those that no lower one has settled. ``across``: only sets of different parts are compared.
    """
    m, size = len(rank), np.diff(ends)
    codes = np.unique(sets, return_inverse=True)[1]
    table = np.zeros(codes.max(initial=0) + 1, bool)
    found, likeness, best = np.full(m, -1), np.zeros(m), np.full(m, rank[-1] + 1)
    left, codes_left, stale = np.arange(m), codes, 0
    last = ends
    for t in range(m - 1):
        if stale > len(left) // 4 + 8:  # settled sets and lower ones are taken out now and then
            keep = (rank[left] > rank[t]) & (best[left] >= rank[t])
            codes_left = codes_left[np.repeat(keep, size[left])]
            left, stale = left[keep], 0
            last = np.r_[0, np.cumsum(size[left])]
        stale += 1
        fit = (rank[left] > rank[t]) & (best[left] >= rank[t]) & (size[left] >= least * size[t]) & (size[left] * least <= size[t])
        fit = np.flatnonzero(fit & (own[left] != own[t]) if across else fit)
        if not len(fit):
            continue
        table[codes[ends[t] : ends[t + 1]]] = True
        if len(fit) * 4 > len(left):
            common = np.add.reduceat(table[codes_left], last[:-1], dtype=np.int64)[fit]
        else:
            own_size = size[left[fit]]
            cut = np.cumsum(own_size) - own_size
            inner = np.arange(own_size.sum()) + np.repeat(last[fit] - cut, own_size)
            common = np.add.reduceat(table[codes_left[inner]], cut, dtype=np.int64)
        table[codes[ends[t] : ends[t + 1]]] = False
        alike = common / (size[left[fit]] + size[t] - common)
        hit = (alike >= least) & (alike > likeness[left[fit]])
        x = left[fit[hit]]
        stale += np.count_nonzero(found[x] < 0)
        found[x], likeness[x], best[x] = t, alike[hit], rank[t]
    return found, likeness


def compared(placed: DataFrame, least: float) -> DataFrame:
    """sum1, sum2, keeper and jaccard: of each bucket's sets the ones with a set of a smaller doc_id at ``least``, and the smallest such."""
    rows = placed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "doc_id")
    schema = StructType([StructField("sum1", LongType()), StructField("sum2", LongType()), StructField("keeper", placed.schema["doc_id"].dataType), StructField("jaccard", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def of(held: list):
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            if len(group) < 2:
                return
            ids, sh = group.column(4), group.column(7)
            rank = np.r_[0, np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))]
            ends = sh.offsets.to_numpy().astype(np.int64)
            across = group.column(1)[0] != group.column(2)[0]
            found, likeness = first_alike(rank, group.column(3).to_numpy(), sh.flatten().to_numpy(), ends - ends[0], least, across)
            x = np.flatnonzero(found >= 0)
            if len(x):
                yield pa.RecordBatch.from_arrays([group.column(5).take(pa.array(x)), group.column(6).take(pa.array(x)), ids.take(pa.array(found[x])), pa.array(likeness[x])], schema=arrow)

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and key != tuple(keys[:, a]):
                    yield from of(held)
                    held = []
                key = tuple(keys[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from of(held)

    return rows.mapInArrow(run, schema)
