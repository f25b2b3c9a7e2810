"""Registered queries over models learnt from the tables, aligned claims, TeX sources and snapshots, with their SQL.

Models learn from documents whose crc32(doc_id) mod 3 is not 1 and are judged by
the others. TeX sources and the second snapshot are derived from documents and
orders by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tex import tex_text
from ..operators import curate, grounding, languages, ranking, snapshots, topics
from ..session import scratch_path
from .retrieval import K, PLACES, docs_of, items_of
from .tables import table

TOPICS, ROUNDS = 8, 6


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_accuracy(spark, sf_dir):
    """n held-out rows, and the shares of them that profiles and stop words get right."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = docs.where(_held_out())
    profiles = languages.learn(docs.where(~_held_out()))
    each = [languages.accuracy(g, held) for g in (languages.guess(held, profiles), curate.guess_language(held))]
    return each[0].join(each[1].toDF("n2", "votes_accuracy")).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("votes_accuracy", 6).alias("votes_accuracy"))


def topic_perplexity(spark, sf_dir):
    """Held-out words and their perplexity under the topics and under one distribution of words."""
    docs = docs_of(spark, sf_dir)
    known, held = (topics.pack(topics.term_counts(docs.where(c))) for c in (~_held_out(), _held_out()))
    mixture = topics.perplexity(held, *topics.fit(known, TOPICS, ROUNDS))
    one = topics.perplexity(held, *topics.fit(known, 1, 0)).toDF("n2", "unigram")
    return mixture.join(one).select("n_words", F.round("perplexity", 2).alias("perplexity"), F.round("unigram", 2).alias("unigram"))


def learnt_topics(spark, sf_dir):
    """doc_id and topic of every document with words."""
    counts = topics.pack(topics.term_counts(docs_of(spark, sf_dir)))
    return topics.assign(counts, *topics.fit(counts, TOPICS, ROUNDS)).select("doc_id", "topic")


def claim_alignment(spark, sf_dir):
    """Alignment of every item with the documents that rank highest for it."""
    items, docs = items_of(spark, sf_dir), docs_of(spark, sf_dir)
    near = ranking.lexical_topk(items, docs, K, decimals=PLACES).select("query_id", "doc_id")
    pairs = near.join(items, "query_id").join(docs, "doc_id").select("query_id", "doc_id", F.col("query").alias("claim"), "text")
    return grounding.ground(pairs).select("query_id", "doc_id", "alignment.score", "alignment.first", "alignment.last", F.round("alignment.share", 6).alias("share"))


def as_tex(docs: DataFrame) -> DataFrame:
    """doc_id and tex: texts as TeX, with escapes, macros of their own, nested groups, comments, math and a figure."""
    sign = r"([\\{}$&#_%~^'`\-\[\]])"
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), sign, r"\\sign{$1}")
    for char, name in (("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("$", r"\$"), ("&", r"\&"), ("#", r"\#"), ("_", r"\_"), ("%", r"\%"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        plain = F.replace(plain, F.lit(rf"\sign{{{char}}}"), F.lit(name))
    marked = F.regexp_replace(plain, r"(?<=^| )(\p{L}+) (\p{L}+)(?= |$)", r"\\pair{\\emph{$1}}{{$2}} % \\pair{x}" + "\n" + r"\$\\frac{$1}{2}\$\\label{a}")
    head = r"\documentclass[a4paper]{article}\newcommand{\sign}[1]{{#1}}\newcommand{\pair}[2]{\textbf{#1} #2}\begin{document}"
    figure = r"\begin{figure}[t]\begin{center}\includegraphics[width=3cm]{x}\end{center}\caption{gone}\end{figure}"
    return docs.select("doc_id", F.concat(F.lit(head), marked, F.lit("\n\n" + figure + r"\end{document} tail")).alias("tex"))


def tex_sources(spark, sf_dir):
    """n_chars and digest of the text of every document's TeX source: the document with single blanks."""
    text = F.trim(F.regexp_replace(tex_text(F.col("tex")), r"\s+", " "))
    return as_tex(docs_of(spark, sf_dir)).select("doc_id", text.alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def snapshot_diff(spark, sf_dir):
    """Keys that differ between orders and a later state of them: some gone, some changed, some new."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = orders.where(key % 97 != 3).withColumn("o_totalprice", F.when(key % 101 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    fresh = orders.where(key % 89 == 7).withColumn("o_orderkey", key + 1_000_000_000)
    one = snapshots.build(orders, "o_orderkey", scratch_path(spark, "tree"))
    other = snapshots.build(kept.unionAll(fresh), "o_orderkey", scratch_path(spark, "tree"), one.state()["facts"]["depth"])
    return snapshots.difference(one, other)


QUERIES = {f.__name__: f for f in (language_accuracy, topic_perplexity, learnt_topics, claim_alignment, tex_sources, snapshot_diff)}

ORACLE = {
    "tex_sources": r"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)",
    "snapshot_diff": """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 97 = 3 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 97 = 3 OR o_orderkey % 101 = 5
UNION ALL SELECT CAST(o_orderkey + 1000000000 AS VARCHAR), 'added' FROM orders WHERE o_orderkey % 89 = 7""",
}
