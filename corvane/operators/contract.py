"""Contracts of curated datasets: row rules, corpus rules, composition, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..session import materialize
from ..sources.schemas import ABSTENTION_REASONS, CHAT_ROLES, NEGATIVE_TYPES, PARTITIONS, TARGETS, TASK_FAMILIES


def _blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")) == ""


def _claims() -> Column:
    return F.coalesce(F.col("claims"), F.filter(F.array(F.lit(None)), lambda _: F.lit(False)).cast("array<struct<text:string,cited_bibcode:string,support_span:string,supported:boolean>>"))


def _first_index(condition) -> Column:
    """Position (from 0) of the first claim for which ``condition`` holds."""
    flags = F.transform(_claims(), lambda c, i: F.when(condition(c), i))
    return F.array_min(flags)


def rule_message() -> Column:
    """The message of the first rule that a gold row breaks; null for a valid row."""
    family, partition, negative = F.col("task_family"), F.col("partition"), F.coalesce(F.col("is_negative"), F.lit(False))
    abstains = family == "abstention"
    unsupported = F.exists(_claims(), lambda c: ~F.coalesce(c["supported"], F.lit(True)))
    uncited = F.exists(_claims(), lambda c: F.coalesce(c["cited_bibcode"], F.lit("")) == "")
    blank_claim = _first_index(lambda c: _blank(c["text"]))
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c}: field required")) for c in ("example_id", "task_family", "partition", "query", "answer")]
    domain = [
        F.when(~F.coalesce(F.col(c), F.lit(v[0])).isin(*v), F.lit(f"{c}: must be one of {', '.join(v)}"))
        for c, v in (("task_family", TASK_FAMILIES), ("partition", PARTITIONS), ("abstention_reason", ABSTENTION_REASONS), ("negative_type", NEGATIVE_TYPES))
    ]
    rules = [
        (_blank(F.col("answer")), F.lit("answer must not be empty")),
        (blank_claim.isNotNull(), F.concat(F.lit("claim["), blank_claim.cast("string"), F.lit("].text must not be empty"))),
        (abstains & F.col("abstention_reason").isNull(), F.lit("abstention task_family requires abstention_reason")),
        (~abstains & F.col("abstention_reason").isNotNull(), F.lit("abstention_reason is only valid for the abstention task_family")),
        (~abstains & ((F.size(_claims()) == 0) | uncited), F.concat(F.lit("every "), family, F.lit(" claim must cite a bibcode"))),
        (negative & (partition != "calibration"), F.lit("negatives must be in the calibration partition")),
        (negative & F.col("negative_type").isNull(), F.lit("is_negative requires a negative_type")),
        (negative & ~unsupported, F.lit("a negative must have at least one claim with supported=False")),
        (~negative & F.col("negative_type").isNotNull(), F.lit("negative_type is only valid when is_negative=True")),
        (~negative & unsupported, F.lit("a non-negative example must have all claims supported")),
        ((partition == "eval") & negative, F.lit("eval partition must not contain negatives")),
    ]
    return F.coalesce(*missing, *domain, *[F.when(cond, msg) for cond, msg in rules])


def structural_errors(gold: DataFrame) -> DataFrame:
    """example_id and message of the rows that break a rule."""
    return gold.select("example_id", rule_message().alias("message")).where("message is not null")


def corpus_findings(gold: DataFrame, corpus: DataFrame, key: str = "bibcode") -> DataFrame:
    """example_id, level (error or warning) and message against a corpus of ids.

    Ids are looked up by one anti-join over all that the rows name, so the
    corpus is never gathered.
    """
    claims = gold.select("example_id", "retrieved_context.bibcode", "is_negative", "negative_type", F.posexplode("claims").alias("i", "c")).withColumnRenamed("bibcode", "pool")
    ids = corpus.select(F.col(key).cast("string").alias("id")).distinct()
    named = gold.select("example_id", F.explode("retrieved_context.bibcode").alias("id"))
    absent = named.join(ids, "id", "left_anti").groupBy("example_id").agg(F.collect_list("id").alias("ids"))
    lost = absent.select(
        "example_id", F.lit("error").alias("level"), F.concat(F.size("ids").cast("string"), F.lit(" retrieved bibcode(s) absent from corpus snapshot: "), shortened(F.col("ids"))).alias("message")
    )
    cited = claims.where("c.cited_bibcode is not null").select("example_id", "i", "pool", "is_negative", "negative_type", F.col("c.cited_bibcode").alias("id"))
    known = ids.withColumn("known", F.lit(True))
    met = cited.join(known, "id", "left")
    start = F.concat(F.lit("claim["), F.col("i").cast("string"), F.lit("] "))
    outside = ~F.coalesce(F.array_contains("pool", F.col("id")), F.lit(False))
    deliberate = F.coalesce(F.col("is_negative"), F.lit(False)) & (F.coalesce("negative_type", F.lit("")) == "wrong_paper")
    wrong = met.where(F.col("known").isNull() | outside).select(
        "example_id",
        F.when(F.col("known").isNotNull() & deliberate, "warning").otherwise("error").alias("level"),
        F.concat(start, F.lit("cites "), F.col("id"), F.when(F.col("known").isNull(), ", absent from corpus snapshot").otherwise(", not in this query's retrieved_context")).alias("message"),
    )
    bare = claims.where("c.cited_bibcode is not null and coalesce(c.supported, false) and coalesce(c.support_span, '') = ''").select(
        "example_id", F.lit("warning").alias("level"), F.concat(start, F.lit("is supported but has no support_span")).alias("message")
    )
    return lost.unionAll(wrong).unionAll(bare)


def findings(gold: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """All findings; without a corpus its rules are skipped."""
    broken = structural_errors(gold).select("example_id", F.lit("error").alias("level"), "message")
    if corpus is None:
        return broken
    sound = gold.where(rule_message().isNull())
    return broken.unionAll(corpus_findings(sound, corpus))


def chat_errors(chats: DataFrame) -> DataFrame:
    """Chat records (id, messages, metadata optional): id and message of the first broken rule."""
    roles = F.forall("messages", lambda m: F.coalesce(m["role"], F.lit("")).isin(*CHAT_ROLES))
    rule = F.coalesce(
        F.when(F.col("messages").isNull(), F.lit("messages: field required")),
        F.when(F.size("messages") < 2, F.lit("messages: at least 2")),
        F.when(~roles, F.lit("messages: unknown role")),
        F.when(~F.exists("messages", lambda m: m["role"] == "assistant"), F.lit("messages: no assistant turn")),
    )
    return chats.select("id", rule.alias("message")).where("message is not null")


def grounded(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """Claims (span, source text): verbatim, overlap of words, and whether grounded."""
    from ..functions.text import document_tokens

    words = claims.withColumns({"_a": document_tokens(F.col("span")), "_b": document_tokens(F.col("source"))})
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("_a", "_b")).cast("double"), F.size(F.array_distinct("_a"))), F.lit(0.0))
    verbatim = F.contains(F.col("source"), F.col("span"))
    return words.withColumns({"verbatim": verbatim, "overlap": share}).drop("_a", "_b").withColumn("grounded", F.col("verbatim") | (F.col("overlap") >= least))


# ---------------------------------------------------------------- accounting


def disjointness(gold: DataFrame) -> DataFrame:
    """Queries that occur in both partitions."""
    of = lambda p: gold.where(F.col("partition") == p).select("query")
    return of("calibration").intersect(of("eval"))


def composition(gold: DataFrame) -> DataFrame:
    """dimension, value and n: totals, partitions, families, negatives, abstention
    reasons and negative types, with zeros for values that don't occur."""
    negative = F.coalesce("is_negative", F.lit(False))
    domain = [("total", "all")]
    domain += [("partition", p) for p in PARTITIONS] + [("task_family", f) for f in TASK_FAMILIES]
    domain += [("calibration", "positive"), ("calibration", "negative")] + [("eval", f) for f in TASK_FAMILIES]
    domain += [("abstention_reason", r) for r in ABSTENTION_REASONS] + [("negative_type", t) for t in NEGATIVE_TYPES]
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    marks = F.array(
        pair("total", F.lit("all")),
        pair("partition", F.col("partition")),
        pair("task_family", F.col("task_family")),
        pair("calibration", F.when(F.col("partition") == "calibration", F.when(negative, "negative").otherwise("positive"))),
        pair("eval", F.when(F.col("partition") == "eval", F.col("task_family"))),
        pair("abstention_reason", F.col("abstention_reason")),
        pair("negative_type", F.col("negative_type")),
    )
    counted = gold.select(F.explode(marks).alias("m")).where("m.value is not null").groupBy("m.dimension", "m.value").agg(F.count("*").alias("n"))
    base = gold.sparkSession.createDataFrame(domain, "dimension string, value string")
    return F.broadcast(base).join(counted, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def mode_coverage(counts: DataFrame) -> DataFrame:
    """One row: negative types that occur, and whether all do."""
    modes = counts.where("dimension = 'negative_type'")
    return modes.agg(F.count_if(F.col("n") > 0).alias("covered"), (F.count_if(F.col("n") > 0) == len(NEGATIVE_TYPES)).alias("all_covered"))


def target_progress(counts: DataFrame) -> DataFrame:
    """group, n, least, most and status (under, met, over) of every target."""
    targets = counts.sparkSession.createDataFrame(list(TARGETS), "group string, least long, most long")
    group = F.when(F.col("dimension") == "total", "total").otherwise(F.concat_ws("/", "dimension", "value"))
    got = counts.select(group.alias("group"), "n")
    status = F.when(F.col("n") < F.col("least"), "under").when(F.col("n") > F.col("most"), "over").otherwise("met")
    return F.broadcast(targets).join(got, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"), "least", "most").withColumn("status", status)


def hash_consistency(gold: DataFrame, corpus_hash: str) -> DataFrame:
    """One row: all_match and the other hashes, a missing one as ``(none)``."""
    h = F.coalesce(F.try_element_at("provenance", F.lit("corpus_hash")), F.lit("(none)"))
    return gold.agg(
        F.coalesce(F.bool_and(h == corpus_hash), F.lit(True)).alias("all_match"), F.array_join(F.array_sort(F.collect_set(F.when(h != corpus_hash, h))), ",").alias("mismatched")
    )


def manifest(gold: DataFrame, corpus: DataFrame, corpus_hash: str, retriever: dict, read_errors: DataFrame | None = None) -> DataFrame:
    """One row: validity, counts, targets, disjointness and hash consistency.

    An invalid dataset has a manifest too, with ``valid`` false. shared_queries
    are the first 100 of n_shared_queries; :func:`disjointness` has the whole set.
    """
    found = findings(gold, corpus)
    n_errors = found.where("level = 'error'").count() + (read_errors.count() if read_errors is not None else 0)
    shared = materialize(disjointness(gold).select("query"), "shared-queries")
    n_shared = shared.count()
    overlap = [r["query"] for r in shared.orderBy("query").limit(100).collect()]
    same = hash_consistency(gold, corpus_hash).first()
    counts = materialize(composition(gold), "composition")
    row = F.struct("dimension", "value", "n")
    out = counts.agg(F.array_sort(F.collect_list(row)).alias("counts"))
    return out.select(
        F.lit(n_errors == 0 and not n_shared and same["all_match"]).alias("valid"),
        F.lit(n_errors).alias("n_errors"),
        F.lit(corpus_hash).alias("corpus_hash"),
        F.lit(not n_shared).alias("disjoint"),
        F.lit(n_shared).cast("long").alias("n_shared_queries"),
        F.array(*[F.lit(q) for q in overlap]).cast("array<string>").alias("shared_queries"),
        F.lit(same["all_match"]).alias("hashes_match"),
        F.lit(same["mismatched"]).alias("mismatched"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(retriever.items())])).alias("retriever"),
        "counts",
    )
