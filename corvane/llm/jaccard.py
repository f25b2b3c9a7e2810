"""N-gram Jaccard join: a size-aware heavy-light join, and its components.

A text's set holds the 64-bit hashes of its distinct ``width``-word shingles.
Two sets link when ``den * |A and B| >= num * |A or B|``. Sets that are equal
are one node from the start, so copies cost one node.

* **Light sets** (up to ``boundary`` shingles) enumerate their subsets of each
  size c that a partner may share, i.e. all sets left after taking out up to
  15 % of the shingles. Two sets that share a subset of size c overlap in c at
  least, so within a subset all that can link also link to its smallest set:
  one star per subset is exact.
* **Heavy sets** are found through inverted lists. Shingles are ordered from
  rare to frequent, and two sets that link meet in the list of one of their
  first ``n - ceil(t n) + 1`` shingles; a few more are listed, which makes the
  bounds below sharper. Light sets big enough to link to a heavy one are in the
  lists too.
* The **boundary** is chosen by cost: for each candidate, the subsets that the
  sets up to it enumerate and the list entries (each to be shuffled, joined
  and verified) that the sets above it make, from the histogram of sizes.

Lists are not turned into all pairs. A shingle early in a set's order that no
other set lists is lost to the overlap with any set that can link (see
:func:`_safe_places`), which rules out most sets of a large group but those near its
centre. A list's leader is the set with the smallest share of lost shingles,
the centre of such a group. In ``leader_rounds`` rounds every set that meets a
leader is verified against the one that it meets in most lists, which joins
groups of near copies into components; then the pairs of different components
that can still link are counted over all lists, and those that meet often
enough are verified. Two sets of one component need no verification, so the
components are those of all links.

The frequency order comes from counts of all shingles of all documents in a
table of hash buckets whose size follows the input up to ``2**MOST_BITS``
(16 MB). A task counts a bucket up to 255 and hands its table on compressed, a
byte a bucket, to one of ``PARTS`` reducers. The order only decides which lists
are short, never which pairs are found.

Defined results: null and empty texts have empty sets and link with nothing;
rows with a null doc_id link with nothing and have a null component; rows that
share a doc_id are one node of the components.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, plan_bytes, release, tidy
from . import bloom
from .arrowio import batched, map_arrow, map_texts, rows_of, text_groups
from .graph import components
from .words import mix, shingle_sets, words_of

MOST_BITS, LEAST_BITS, PARTS = 24, 14, 256
#: Sizes up to which light sets are considered at all; beyond, subsets outgrow any list.
MOST_LIGHT = 24
#: Relative cost of a list entry against an enumerated subset.
ENTRY_COST = 3.0


@dataclass(frozen=True)
class Rule:
    """Shingle width and the threshold num/den."""

    width: int = 4
    num: int = 85
    den: int = 100

    def least_overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def least_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least_partner(n) + 1 + n // 32 + 2)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, d) for d in range(n - self.least_partner(n) + 1))


def set_digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def sets_of(texts: list[str | None], rule: Rule) -> list[np.ndarray]:
    return shingle_sets(words_of(texts, lower=True), rule.width)


def _sets(documents: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """doc_id, n, d of every row; and bucket counts in rows with a part number."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, n long, d long, part int, counts binary")
    arrow = to_arrow_schema(schema)

    def scan(batches):
        counts = np.zeros(1 << bits, np.uint32)
        mask = np.uint64((1 << bits) - 1)
        for rows in text_groups(batches, 1):
            sets = sets_of([r[1] for r in rows], rule)
            np.add.at(counts, (np.concatenate(sets) & mask).astype(np.int64), 1)
            for (doc_id, _), tokens in zip(rows, sets, strict=True):
                yield doc_id, len(tokens), set_digest(tokens) if len(tokens) else None, None, None
        for part, piece in enumerate(np.split(counts, PARTS)):
            if piece.any():
                yield None, None, None, part, zlib.compress(np.minimum(piece, 255).astype(np.uint8).tobytes(), 1)

    return map_arrow(documents.select("doc_id", "text"), lambda batches: batched(scan(batches), arrow), schema)


def _order(scanned: DataFrame, bits: int) -> np.ndarray:
    """Frequency class of each bucket, from rare to frequent: 8 for each doubling."""
    size = (1 << bits) // PARTS

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for part, counts in rows_of(batches, 16):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint8).astype(np.uint64)
        for part, total in sums.items():
            classes = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["part", "classes"])

    parts = scanned.where("part is not null").select("part", "counts").repartitionById(PARTS, F.col("part"))
    out = np.zeros(1 << bits, np.uint8)
    for part, classes in parts.mapInArrow(add, "part int, classes binary").collect():
        out[part * size : (part + 1) * size] = np.frombuffer(classes, np.uint8)
    return out


def boundary_by_cost(histogram: dict[int, int], rule: Rule) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists.

    ``histogram`` has the number of sets of each size up to MOST_LIGHT; larger
    sets are heavy whatever the boundary.
    """
    cost = lambda b: sum(
        k * ((rule.subsets(n) if n <= b else 0) + (ENTRY_COST * rule.prefix(n) if n >= rule.least_partner(b + 1) else 0)) for n, k in histogram.items()
    )
    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _subset_signatures(tokens: np.ndarray, rule: Rule) -> list[dict]:
    """Size and hash of each subset that a linked set can share."""
    n = len(tokens)
    spread = mix(tokens)
    total = int(spread.sum(dtype=np.uint64))
    out = []
    for gone in range(n - rule.least_partner(n) + 1):
        for left in combinations(spread.tolist(), gone):
            out.append({"c": n - gone, "s": ((total - sum(left)) & ((1 << 64) - 1)) - (1 << 63)})
    return out


def _keys(documents: DataFrame, rule: Rule, boundary: int, classes: np.ndarray) -> DataFrame:
    """d, n, toks (the first shingles of the order) and subs, once a set and task."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    listed = rule.least_partner(boundary + 1)
    mask = np.uint64(len(classes) - 1)

    def make():
        met = set()

        def each(rows):
            for tokens in sets_of([r[0] for r in rows], rule):
                n = len(tokens)
                if not n or (d := set_digest(tokens)) in met:
                    continue
                met.add(d)
                toks = np.empty(0, np.uint64)
                if n >= listed:
                    # tokens are sorted, so a stable sort breaks ties of a class by hash
                    rank = np.argsort(shared.value[(tokens & mask).astype(np.int64)], kind="stable")
                    toks = tokens[rank[: rule.prefix(n)]]
                yield d, n, toks.view(np.int64), _subset_signatures(tokens, rule) if n <= boundary else []

        return each

    return map_texts(documents.where("doc_id is not null").select("text"), 0, make, "d long, n int, toks array<long>, subs array<struct<c:int,s:long>>", limit=200)


def _links(rule: Rule, overlap, n, m):
    return overlap * rule.den >= rule.num * (n + m - overlap)


def _bands(n):
    """Sizes of partners, from the own one to the largest, for which losses are kept."""
    return lambda rule: (n, n + F.floor(n / 32) + 1, n + F.floor(n / 12) + 1, F.floor(n * rule.den / F.lit(rule.num)))


def _loss(rule: Rule, u, n, m):
    """The loss of a set of n shingles against a partner of m, from its packed losses."""
    sizes = _bands(n)(rule)
    band = F.when(m <= sizes[0], 0).when(m <= sizes[1], 16).when(m <= sizes[2], 32).otherwise(48)
    return F.call_function("shiftright", u, band).bitwiseAND(F.lit(0x7FFF))


def _fitting(rule: Rule, n, u, m, w):
    """Whether sets of n and m shingles with the packed losses u and w can link at all."""
    return F.least(n - _loss(rule, u, n, m), m - _loss(rule, w, m, n)) * (rule.num + rule.den) >= rule.num * (n + m)


def _safe_places(rule: Rule) -> list[Column]:
    """For each band of partners the place below which unlisted shingles are lost.

    Let the shingle at place i of X be listed by no other set. If Y has it, it
    comes after Y's first p(Y), so at most i + |Y| - p(Y) shingles are shared:
    too few to link while i < overlap - |Y| + p(Y). Below that place such
    shingles of X are in no Y that links. The place falls as Y grows, so that of
    a band's largest Y holds for the band; 2 are taken off for rounding.
    """
    n, p = F.col("n"), F.col("p")
    overlap = lambda m: F.ceil(rule.num * (n + m) / F.lit(rule.num + rule.den))
    prefix = lambda m: F.least(m, m - F.ceil(rule.num * m / F.lit(rule.den)) + 1 + F.floor(m / 32) + 2)
    return [F.greatest(F.lit(0), F.least(p, overlap(m) - m + prefix(m) - 2)).cast("int") for m in _bands(n)(rule)]


def _subset_links(keys: DataFrame, rule: Rule) -> DataFrame:
    """a, b, na, nb of light sets and the smallest set that shares a subset."""
    subs = keys.where("size(subs) > 0").select("d", "n", F.explode("subs").alias("x")).select("d", "n", "x.c", "x.s")
    low = subs.groupBy("c", "s").agg(F.min(F.struct("n", "d")).alias("low"), F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 < d1").select("c", "s", "low")
    met = subs.join(low, ["c", "s"]).where("d <> low.d").where(_links(rule, F.col("c"), F.col("n"), F.col("low.n")))
    return met.select(F.col("low.d").alias("a"), F.col("d").alias("b"), F.col("low.n").alias("na"), F.col("n").alias("nb")).distinct()


def verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, na, nb) that link, by their whole sets; a scratch table of u, v.

    The sets come from one document each, found through a Bloom filter on
    doc_id, so the other texts are not shuffled.
    """
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("d")).unionAll(pairs.select("b")).distinct()
    homes = materialize(nodes.join(reps, "d").select("d", "rep"), "homes")
    shared = documents.sparkSession.sparkContext.broadcast(bloom.build(homes, "rep"))

    def make():
        met = set()

        def each(rows):
            ok = shared.value.contains(np.array([r[0] for r in rows], np.int64))
            for tokens in sets_of([r[1] for r, may in zip(rows, ok, strict=True) if may], rule):
                if len(tokens) and (d := set_digest(tokens)) not in met:
                    met.add(d)
                    yield d, tokens.view(np.int64)

        return each

    # what the filter lets through by mistake is a set that no pair names, or a set twice
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    sets = materialize(map_texts(rows, 1, make, "d long, toks array<long>", limit=100), "sets")
    one = sets.select(F.col("d").alias("a"), F.col("toks").alias("ta"))
    two = sets.select(F.col("d").alias("b"), F.col("toks").alias("tb"))
    both = pairs.join(two, "b").join(one, "a").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    out = materialize(both.where(_links(rule, F.col("o"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    for table in (pairs, homes, sets):
        release(table)
    return out


def _with_component(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return entries.withColumn("c", F.col("d"))
    known = found.select(F.col("node").alias("d"), "component")
    return entries.join(known, "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")


def _list_entries(keys: DataFrame, rule: Rule) -> DataFrame:
    """d, n, p, u, i and t: the sets in the lists of more than one set, once each.

    u packs the set's losses against the four bands of partners, 16 bits each.
    """
    entries = keys.where("size(toks) > 0").select("d", "n", F.size("toks").alias("p"), F.posexplode("toks").alias("i", "t"))
    shared = entries.groupBy("t").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("t")
    met = materialize(entries.join(shared, "t"), "shingle-entries")
    below = [(F.col("i") < place).cast("long") for place in _safe_places(rule)]
    listed = met.select("d", "n", "p", "i", "t", *[c.alias(f"b{k}") for k, c in enumerate(below)]).distinct()
    counted = listed.groupBy("d", "n", "p").agg(*[F.sum(f"b{k}").alias(f"s{k}") for k in range(4)])
    packed = F.lit(0).cast("long")
    for k, place in enumerate(_safe_places(rule)):
        packed = packed.bitwiseOR(F.shiftleft(F.least(F.greatest(place - F.col(f"s{k}"), F.lit(0)), F.lit(0x7FFF)).cast("long"), 16 * k))
    losses = counted.select("d", packed.alias("u"))
    out = materialize(listed.select("d", "n", "p", "i", "t").join(losses, "d"), "shingle-lists")
    release(met)
    return out


def _leader_pairs(entries: DataFrame, rule: Rule, turn: int) -> DataFrame:
    """For each set the leader that it meets in most lists, of another component."""
    loss = F.col("u").bitwiseAND(F.lit(0x7FFF))
    share = F.floor(loss * (8 if turn else 1000) / F.col("p"))  # the centre first, then any set near it
    lead = entries.groupBy("t").agg(F.min(F.struct(share.alias("k"), F.xxhash64("d", F.lit(turn)).alias("h"), "d", "n", "u", "c")).alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    lead = lead.select("t", "lead.d", "lead.n", "lead.u", "lead.c").toDF("t", "a", "na", "ua", "ca")
    met = entries.join(lead, "t").where("c <> ca").where(_fitting(rule, F.col("n"), F.col("u"), F.col("na"), F.col("ua")))
    counted = met.groupBy("d", "n", "a", "na").agg(F.count("*").alias("k"))
    best = counted.groupBy("d", "n").agg(F.max(F.struct("k", "a", "na")).alias("m"))
    # sets that meet in few lists are hardly near copies; the last step looks at them
    return best.where("3 * m.k >= n - ceil(n * 0.92)").select("m.a", F.col("d").alias("b"), "m.na", F.col("n").alias("nb"))


def _cross_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that share enough of their first shingles to link.

    A pair that links in ``overlap`` shingles shares one of the first
    n - overlap + 1 of either set, so only these entries are joined. What is
    left is checked on all that both sets list: if a set's order ends first, at
    most n - p shared shingles come later, so overlap - (n - p) are shared before.
    """
    open_ = materialize(entries.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t"), "open-lists")
    least = F.ceil((F.col("na") + F.col("nb")) * rule.num / (rule.num + rule.den))
    # nobody's partner has less than t n shingles, so n - ceil(t n) is the last place of use
    left = entries.where(F.col("i") <= F.col("n") - F.ceil(rule.num * F.col("n") / F.lit(rule.den))).join(open_, "t").select("t", "d", "n", "p", "u", "c", "i")
    a, b = left.toDF("t", "a", "na", "pa", "ua", "ca", "ia"), left.toDF("t", "b", "nb", "pb", "ub", "cb", "ib")
    met = a.join(b, "t").where("a < b and ca <> cb").where((F.col("ia") <= F.col("na") - least) & (F.col("ib") <= F.col("nb") - least))
    met = met.where(_fitting(rule, F.col("na"), F.col("ua"), F.col("nb"), F.col("ub")))
    pairs = materialize(met.select("a", "b", "na", "nb", "pa", "pb").distinct(), "cross-pairs")
    nodes = pairs.select(F.col("a").alias("d")).unionAll(pairs.select("b")).distinct()
    firsts = materialize(entries.join(nodes, "d", "left_semi").groupBy("d").agg(F.collect_list("t").alias("ts")), "first-shingles")
    both = pairs.join(firsts.toDF("b", "tb"), "b").join(firsts.toDF("a", "ta"), "a").withColumn("k", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("k") >= F.least(least - F.col("na") + F.col("pa"), least - F.col("nb") + F.col("pb"))).select("a", "b", "na", "nb")


def linked(documents: DataFrame, rule: Rule | None = None, leader_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``."""
    rule = rule or Rule()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(1, plan_bytes(docs) / 256)))))
    scanned = materialize(_sets(docs, rule, bits), "shingle-sets")
    classes = _order(scanned, bits)
    rows = scanned.where("part is null").select("doc_id", "n", "d")
    nodes = rows.where("d is not null and doc_id is not null")
    histogram = dict(nodes.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect())
    boundary = boundary_by_cost(histogram, rule)
    reps = nodes.groupBy("d").agg(F.min("doc_id").alias("rep"))

    keys = materialize(_keys(docs, rule, boundary, classes), "shingle-keys")
    lists = _list_entries(keys, rule)
    edges = materialize(_subset_links(keys, rule).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    release(keys)
    found = None
    for turn in range(leader_rounds):
        edges = edges.unionAll(verified(_leader_pairs(_with_component(lists, found), rule, turn), docs, reps, rule))
        found = components(edges)
        tidy(documents.sparkSession)
    last = verified(_cross_pairs(_with_component(lists, found), rule), docs, reps, rule)
    release(lists)
    found = components(edges.unionAll(last))

    labelled = reps.join(found.select(F.col("node").alias("d"), "component"), "d", "left").select("d", "rep", F.coalesce("component", "d").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = labelled.join(smallest, "label").select("d", "component_id")
    alone = rows.where("d is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return nodes.join(of_set, "d").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(alone)


def one_of_each(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``documents`` without the rows whose component has a smaller doc_id."""
    gone = materialize(linked(documents, rule).where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    may, other = bloom.split(documents, "doc_id", gone, "doc_id")
    return may.join(gone, "doc_id", "left_anti").select(documents.columns).unionAll(other.select(documents.columns))
