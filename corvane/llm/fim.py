"""Fill-in-middle transformation by a scan for sparse events.

Units are runs of ASCII letters and single other code points. A text is coded to
one symbol a code point (letters, the letters and brackets of sentinels, the
rest), so offsets stay those of the text. One Aho-Corasick automaton over these
symbols finds the pairs at which the class changes and the sentinels. Between two
events nothing has to be looked at: a gap of letters is one unit, any other gap
has as many units as code points. The sums over the events therefore give the
number of units and, by a binary search, the offset of any unit.

Whether a text is cut, where and in which form follows from the SHA-256 of
``seed:doc_id``, so a document is treated alike on every run and in every task.
Texts that hold a sentinel stay plain, hence :func:`restore` is exact.

Defined results: a null text counts as empty and is plain; a null doc_id is
hashed as an empty string; equal rows have equal results; other columns are
ignored by :func:`transform` and kept by :func:`rewrite`. A long text is scanned
in slices, and its events take some 16 bytes a word.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowio import map_arrow, map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in per cent: documents that are cut, and of these the ones with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
_LETTERS, _OTHERS = "aPSM", " <>"
_SLICE = 1 << 20
_CHANGE, _SENTINEL = 0, 1


def _symbols() -> bytes:
    """byte -> symbol of its class; sentinels' own characters stand for themselves."""
    own = {ord(c) for c in PREFIX + SUFFIX + MIDDLE}
    return bytes(b if b in own else ord("a") if chr(b).isalpha() and b < 128 else ord(" ") for b in range(256))


_CODE = _symbols()


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for a in _LETTERS:
        for b in _OTHERS:
            automaton.add_word(a + b, _CHANGE)
            automaton.add_word(b + a, _CHANGE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        automaton.add_word(mark, _SENTINEL)
    automaton.make_automaton()
    return automaton


class Units:
    """The units of a text, by the places at which the class of characters changes."""

    def __init__(self, text: str, automaton: ahocorasick.Automaton) -> None:
        coded = text.encode("ascii", "replace").translate(_CODE).decode("ascii")
        self.sentinel = False
        parts = []
        for at in range(0, len(coded), _SLICE):
            changes = []
            # two symbols of the slice before, for events on the border
            for end, kind in automaton.iter(coded, max(0, at - 2), min(at + _SLICE, len(coded))):
                if kind:
                    self.sentinel = True
                elif end >= at:
                    changes.append(end)
            parts.append(np.array(changes, np.int64))
        first = [0] if coded[:1] in _LETTERS and coded else []
        events = np.concatenate([np.array(first, np.int64), *parts])
        if len(events) % 2:
            events = np.append(events, len(coded))
        starts, ends = events[0::2], events[1::2]
        #: code points that the first i runs hold beyond their unit
        self.extra = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts - 1)))
        self.rank = starts - self.extra[:-1]
        self.count = len(text) - int(self.extra[-1])

    def offset(self, units: int) -> int:
        """Code points in the first ``units`` units."""
        return units + int(self.extra[np.searchsorted(self.rank, units)])


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(doc_id: int | None, text: str | None, automaton: ahocorasick.Automaton, seed: int = 1, cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(units, form, code points of the prefix and of the middle, output)."""
    text = text or ""
    units = Units(text, automaton)
    n = units.count
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or units.sentinel or h3 % 100 >= cut_share:
        return n, "plain", None, None, text
    a, b = sorted((units.offset(h1 % (n + 1)), units.offset(h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(documents: DataFrame, seed: int = 1, cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every row."""

    def make():
        automaton = build_automaton()
        return lambda row: [(row[0], *cut(*row, automaton, seed, cut_share, suffix_first))]

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), make, schema, limit=1 << 20, weight=lambda r: len(r[-1]) + 2000)


def rewrite(documents: DataFrame, seed: int = 1, cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents, all their columns, with the output in place of the text; a null text stays null."""
    ids, texts = documents.columns.index("doc_id"), documents.columns.index("text")

    def run(batches):
        automaton = build_automaton()
        for batch in batches:
            pairs = zip(batch.column(ids).to_pylist(), batch.column(texts).to_pylist(), strict=True)
            new = [None if t is None else cut(i, t, automaton, seed, cut_share, suffix_first)[-1] for i, t in pairs]
            columns = batch.columns
            columns[texts] = pa.array(new, batch.schema.field(texts).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(documents, run, documents.schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; no text that was cut holds a sentinel."""
    after = lambda c, mark: F.substring(c, F.locate(mark, c) + len(mark), F.length(c))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    out = transform(documents)
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def sql() -> str:
    return r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), c AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM c
"""
