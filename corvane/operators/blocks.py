"""Postings of a whole corpus in blocks: counted where texts are read, put in order of terms there, and shuffled compressed.

A task counts the words of its documents and cuts the postings of up to ``HELD`` at a time, by term, into
blocks of ``BLOCK``, compressed columns. A block goes to the range of terms that it belongs to as it
is, so no posting is shuffled as a row, nor twice. Ranges are cut by the words of some documents, as
Spark's own are; a term of more than a range is dealt over several.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import FOLD_FROM, FOLD_TO, document_tokens, document_words
from ..session import import_path, spread

#: Texts that are counted at once; postings that a task holds, of a block, and of a range; documents by which ranges are cut.
ROWS, HELD, BLOCK, FILE, LOOKED_AT = 256, 1 << 21, 1 << 13, 1 << 21, 2000
FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
BLOCKS = StructType([StructField("part", IntegerType()), StructField("block", BinaryType())])


class Chunk:
    """Postings of some documents, by number of term and document."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lens, self.parts, self.docs, self.size = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        """``texts`` are words between blanks."""
        split = pc.split_pattern(texts, " ")
        each, row = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        full = pc.binary_length(each).to_numpy() > 0  # blanks at either end make empty words
        coded, row = each.filter(pa.array(full)).dictionary_encode(), row[full]
        known = self.known
        number = np.array([known.setdefault(w if w.isascii() else w.translate(FOLD), len(known)) for w in coded.dictionary.to_pylist()], np.int64)
        pairs, tf = np.unique(row << 32 | number[coded.indices.to_numpy()], return_counts=True)
        self.parts.append((pairs & 0xFFFFFFFF, (pairs >> 32) + self.docs, tf))
        self.ids.append(ids)
        self.lens.append(np.bincount(row, minlength=len(texts)))
        self.docs += len(texts)
        self.size += len(pairs)

    def rows(self, cuts: list[str]):
        """Range and block, in order; blocks of a term that fills ranges are dealt over these."""
        terms = sorted(self.known)
        place = np.empty(len(terms), np.int64)
        place[[self.known[t] for t in terms]] = np.arange(len(terms))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        term = place[term]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        ids, lens, words = pa.concat_arrays(self.ids), np.concatenate(self.lens), pa.array(terms, pa.string())
        low, high = (np.array([find(cuts, t) for t in terms], np.int64)[term] for find in (bisect_left, bisect_right))
        ends = np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        for a, b in zip([0, *ends], [*ends, len(term)], strict=True):
            for at in range(a, b, BLOCK):
                end = min(b, at + BLOCK)
                t, d = term[at:end], doc[at:end]
                own = pa.DictionaryArray.from_arrays(pa.array((t - t[0]).astype(np.int32)), words[int(t[0]) : int(t[-1]) + 1])
                batch = pa.record_batch([ids.take(pa.array(d)), pa.array(lens[d].astype(np.int32)), own, pa.array(tf[at:end].astype(np.int32))], names=["doc_id", "len", "term", "tf"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                block = sink.getvalue().to_pybytes()
                yield int(low[at]) + zlib.crc32(block) % int(high[at] - low[at] + 1), block


def _cuts(docs: DataFrame) -> list[str]:
    """Terms between ranges of some ``FILE`` postings; a term of several ranges is there several times."""
    rows, cores = docs.count(), docs.sparkSession.sparkContext.defaultParallelism
    share = min(1.0, LOOKED_AT / max(1, rows))
    some = docs.sample(fraction=share, seed=1) if share < 1 else docs
    tokens = some.select(F.explode_outer(F.array_distinct(document_tokens(F.col("text")))).alias("term")).where("term is not null")
    terms = sorted(t for t in tokens.toArrow().column(0).to_pylist())
    total = int(len(terms) / share)
    parts = max(-(-total // FILE), min(cores, total // (1 << 16)), 1)
    return [terms[len(terms) * i // parts] for i in range(1, parts)] if terms else []


def by_term(docs: DataFrame) -> DataFrame:
    """doc_id, len, term and tf of docs (doc_id, text): the postings, those of a range in each partition and in order of term there."""
    spark = docs.sparkSession
    import_path(spark)
    cuts, arrow = _cuts(docs), to_arrow_schema(BLOCKS)
    schema = StructType([docs.schema["doc_id"], StructField("len", LongType()), StructField("term", StringType()), StructField("tf", LongType())])
    rows = to_arrow_schema(schema)

    def count(batches):
        def written(chunk: Chunk):
            for part, block in chunk.rows(cuts):
                yield pa.RecordBatch.from_arrays([pa.array([part], arrow.field(0).type), pa.array([block], arrow.field(1).type)], schema=arrow)

        chunk = Chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                chunk.add(*batch.slice(at, ROWS).columns)
                if chunk.size >= HELD:
                    yield from written(chunk)
                    chunk = Chunk()
        if chunk.size:
            yield from written(chunk)

    def read(batches):
        for batch in batches:
            for block in batch.column(0):
                with pa.ipc.open_stream(block.as_buffer()) as stream:
                    for part in stream:
                        yield pa.RecordBatch.from_arrays([(c.dictionary_decode() if pa.types.is_dictionary(c.type) else c).cast(f.type) for c, f in zip(part.columns, rows, strict=True)], schema=rows)

    made = spread(docs.select("doc_id", "text")).select("doc_id", document_words(F.col("text")).alias("text")).mapInArrow(count, BLOCKS)
    return made.repartitionById(len(cuts) + 1, F.col("part")).select("block").mapInArrow(read, schema).sortWithinPartitions("term", "doc_id")
