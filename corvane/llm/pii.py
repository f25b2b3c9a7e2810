"""Personal data: base detectors and information-theoretic sanitisation.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip``,
``card`` (16 to 19 digits that pass the Luhn check) and ``phone`` (8 to 15
digits). The values found are the protected entities.

A term that goes with an entity can give it away even when the entity itself is
masked. Terms are the words outside of base spans; a document is a context, with
or without an entity, and equal texts count once, so copies of a text are no
evidence. With N texts in the corpus, n(t) of them with the term, n(e) with the
entity and n(e,t) with both,

    PMI(e; t) = log2(n(e,t) N / (n(e) n(t))),   IC(e) = log2(N / n(e)),

and a term discloses e if it occurs with e in ``support`` texts or more and
PMI(e; t) >= ``disclosure`` * IC(e). Its occurrences in texts with e become spans
of kind ``term``; :func:`sanitise` generalises base spans to their kind and
removes terms. As n(e,t) <= n(e), only terms with n(t) <= N (n(e) / N)**disclosure
can disclose e, so no others are paired with it.

Defined results: null text is empty; every row gives one row, repeated rows and
repeated or null doc_ids included; a corpus without entities has no terms.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize, release
from . import bloom
from .arrowio import batched, map_arrow, rows_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each local part reaches back from its @ as far as the last match allows."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            free = m.end()
            out.append((start, free))
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """kind -> [(start, end)] in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte_part, m[0].split(".")))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def entity_value(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind == 'email' else text if kind == 'ip' else _digits(text)}"


def show(kind: str, spans: list[tuple[int, int]]) -> list[str]:
    return [f"{kind}:{a}:{b}" for a, b in spans]


def entities(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[str]:
    return sorted({entity_value(kind, text[a:b]) for kind, v in spans.items() for a, b in v})


def words_outside(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """The words that overlap no base span, with their offsets."""
    taken = sorted(x for v in spans.values() for x in v)
    out, at, reached = [], 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            reached = max(reached, taken[at][1])
            at += 1
        if reached <= a:
            out.append({"term": m[0].lower(), "start": a, "end": b})
    return out


#: A row of the documents, or (``row`` is null) the number of a task's texts that hold a term.
_ROW = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, digest string, "
    "entities array<string>, words array<struct<term:string,start:int,end:int>>, terms array<string>, term string, n_t long"
)


def scan(documents: DataFrame, most_terms: int = 100_000) -> DataFrame:
    """Base spans of every row, the words of rows with an entity, and counts of terms.

    ``row`` numbers the rows. Terms are counted in the task, ``most_terms`` at a
    time; texts that may have copies are left out of that and give their terms.
    """
    spark = documents.sparkSession
    digest, h = F.md5(F.col("text").cast("binary")), F.xxhash64("text")
    groups = documents.where("text <> ''").groupBy(digest.alias("digest"), h.alias("h")).agg(F.count("*").alias("n"))
    copies = materialize(groups.where("n > 1").select("h"), "pii-copies")
    shared = spark.sparkContext.broadcast(bloom.build(copies, "h"))
    release(copies)
    schema = StructType.fromDDL(_ROW)
    arrow = to_arrow_schema(schema)

    def rows(batches):
        held: Counter[str] = Counter()
        import numpy as np

        for doc_id, text, row, digest, h in rows_of(batches):
            found = base_spans(text)
            base = ",".join(x for k in KINDS for x in show(k, found[k]))
            words = words_outside(text, found) if base else None
            terms = None
            if text:
                terms = {w["term"] for w in words} if base else {w.lower() for w in set(_WORD.findall(text))}
                if not shared.value.contains(np.array([h], np.int64))[0]:
                    held.update(terms)
                    terms = None
            yield (doc_id, row, *(len(found[k]) for k in KINDS), base, digest if text else None, entities(text, found) if base else None, words, terms and sorted(terms), None, None)
            if len(held) > most_terms:
                yield from ((*[None] * 11, *x) for x in held.items())
                held.clear()
        yield from ((*[None] * 11, *x) for x in held.items())

    numbered = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), digest.alias("digest"), h.alias("h"))
    return map_arrow(numbered, lambda batches: batched(rows(batches), arrow, 500), schema)


def term_counts(scanned: DataFrame) -> DataFrame:
    """term and n_t: the number of different texts that hold it."""
    again = scanned.where("terms is not null")
    once = again.groupBy("digest").agg(F.min("row").alias("row")).select("row")
    ones = again.select("row", "terms").join(once, "row").select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n_t"))
    return scanned.where("term is not null").select("term", "n_t").unionAll(ones).groupBy("term").agg(F.sum("n_t").alias("n_t"))


def entity_classes(texts: DataFrame) -> DataFrame:
    """row, entity and n_e: of the entities that occur in the same texts the smallest one; n_e is the number of texts.

    What a term tells about an entity follows from the texts of both, so one
    entity speaks for its class: a text's entities that occur nowhere else, say
    the addresses of a log, are one. Sets of texts are compared by their size
    and two sums of 64-bit hashes.
    """
    held = texts.select("row", F.explode("entities").alias("entity"))
    sums = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    sets = held.groupBy("entity").agg(F.count("*").alias("n_e"), *sums)
    classes = materialize(sets.groupBy("n_e", "s0", "s1").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "pii-classes")
    known = materialize(held.join(classes, "entity").select("row", "entity", "n_e"), "pii-entities")
    release(classes)
    return known


def rare_pairs(texts: DataFrame, counts: DataFrame, n: int, disclosure: float) -> DataFrame:
    """row, entity (of its class), term, n_e and n_t of the terms that are rare enough to disclose the entity."""

    def most(n_e: Column) -> Column:
        return F.pow(n_e / n, F.lit(disclosure)) * (n * (1 + 1e-9))

    known = entity_classes(texts)
    bounds = known.groupBy("row").agg(most(F.max("n_e")).alias("most"))
    terms = texts.select("row", F.explode(F.array_distinct("words.term")).alias("term")).join(bounds, "row")
    rare = materialize(terms.join(counts, "term").where("n_t <= most").select("row", "term", "n_t"), "pii-rare")
    out = materialize(rare.join(known, "row").where(F.col("n_t") <= most(F.col("n_e"))).select("row", "entity", "term", "n_e", "n_t"), "pii-pairs")
    for table in (known, rare):
        release(table)
    return out


def disclosing_terms(pairs: DataFrame, n: int, support: int = 1, disclosure: float = 0.8) -> DataFrame:
    """entity, term, pmi, ic of the terms over the threshold."""
    joint = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    total = F.lit(float(n))
    scored = joint.select("entity", "term", F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t"))).alias("pmi"), F.log2(total / F.col("n_e")).alias("ic"))
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= disclosure * F.col("ic") - 1e-9))


def all_spans(documents: DataFrame, support: int = 1, disclosure: float = 0.8) -> DataFrame:
    """doc_id, the counts, base (string) and term_spans of every row.

    The scan is written to a scratch table, so its row numbers stay as they are.
    """
    scanned = materialize(scan(documents), "pii-scan")
    rows = scanned.where("row is not null")
    n = rows.where("digest is not null").select("digest").distinct().count()
    near = rows.where("size(entities) > 0")
    once = near.groupBy("digest").agg(F.min("row").alias("row")).select("row")
    texts = materialize(near.select("row", "digest", "entities", "words").join(once, "row"), "pii-texts")
    pairs = rare_pairs(texts, term_counts(scanned), n, disclosure)
    told = disclosing_terms(pairs, n, support, disclosure).select("entity", "term")
    hits = pairs.join(told, ["entity", "term"]).select("row", "term").distinct()
    words = texts.select("row", "digest", F.explode("words").alias("w")).select("row", "digest", "w.term", "w.start", "w.end")
    of_text = words.join(hits, ["row", "term"]).groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("term_spans"))
    of_row = near.select("row", "digest").join(of_text, "digest").select("row", "term_spans")
    base = rows.select("doc_id", "row", *[f"n_{k}" for k in KINDS], "base")
    return base.join(of_row, "row", "left").withColumn("term_spans", F.coalesce("term_spans", F.array().cast("array<struct<start:int,end:int>>")))


def report(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = all_spans(documents, **options)
    terms = F.transform("term_spans", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    both = F.filter(F.concat(F.array("base"), terms), lambda s: s != "")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.array_join(both, ",").alias("spans"))


def mask(text: str | None, spans: str) -> str | None:
    """``text`` with base spans generalised to ``[KIND]`` and terms removed."""
    if text is None:
        return None
    parts = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    out, at = [], 0
    for a, b, kind in sorted(parts, key=lambda p: (p[0], -p[1])):
        if a < at:
            continue
        out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with masked texts; doc_id must be a key, rows without one keep their base masks only."""
    spans = report(documents, **options).where("doc_id is not null").select("doc_id", "spans").dropDuplicates(["doc_id"])
    columns = documents.columns
    rows = documents.select("doc_id", F.struct(*columns).alias("row"))  # whatever the other columns are called
    joined = rows.join(spans, "doc_id", "left")
    masked = F.udf(lambda t, s: mask(t, s if s is not None else ",".join(x for k in KINDS for x in show(k, base_spans(t)[k]))), "string", useArrow=True)
    return joined.select(*[masked(F.col("row")["text"], F.col("spans")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])
