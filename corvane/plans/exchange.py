"""Registered queries that write tables to the shared folder and read them back, and those over single operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import curate, ingest, ireval, ranking, stats
from ..session import scratch_path
from ..sources import readers, writers
from . import corpus, retrieval
from .authoring import render_context
from .retrieval import K, PLACES, docs_of, items_of
from .tables import table


def _records(spark, sf_dir):
    """Documents as papers."""
    return table(spark, sf_dir, "documents").select(
        F.format_string("b%d", "doc_id").alias("bibcode"), F.col("source").alias("title"), (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"),
        F.array("lang", "source").alias("authors"), F.col("text").alias("abstract"),
    )


def jsonl_round_trip(spark, sf_dir):
    """Papers as JSON lines, read back under the guards of a snapshot."""
    path = scratch_path(spark, "papers")
    writers.write_jsonl(_records(spark, sf_dir), path)
    back = readers.load_snapshot(spark, path)
    return back.select("bibcode", "title", "year", F.array_join("authors", ",").alias("authors"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


def gold_lines(spark, sf_dir):
    """Items as gold records, one a line, every seventh cut off: line, id and answer of the records, or the error."""
    record = F.to_json(F.struct(F.format_string("e%03d", "item_id").alias("example_id"), F.lit("lit_qa").alias("task_family"), F.col("text").alias("answer")))
    lines = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.when(F.col("item_id") % 7 == 3, F.substring(record, 1, 40)).otherwise(record).alias("value"))
    path = scratch_path(spark, "gold")
    lines.coalesce(1).write.text(path)
    rows, errors = readers.load_gold(spark, path)
    good = rows.select("line_no", "example_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.lit(None).cast("string").alias("message"))
    none = F.lit(None).cast("string")
    return good.unionAll(errors.select("line_no", none, none, "message"))


def tsv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    writers.write_tsv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), path)
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").option("sep", "\t").csv(path)


def package_splits(spark, sf_dir):
    """Rows by split as the package holds them, beside what its manifest says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "package")
    manifest = writers.write_package(curate.split_by_key(docs, F.col("doc_id").cast("string")), path)
    said = spark.createDataFrame([(s["split"], s["n"]) for s in manifest["splits"]], "split string, n_said long")
    held = spark.read.schema("doc_id long, lang string, text string, split string").json(path + "/split=*").select("*", F.regexp_extract(F.input_file_name(), "split=([a-z]+)", 1).alias("part"))
    counted = held.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return counted.join(said, counted["part"] == said["split"]).select("split", "n", "n_said", "ids")


def eval_results_log(spark, sf_dir):
    """Results of two runs, appended: mean quality by source and language, then by source alone."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    path = scratch_path(spark, "results")
    writers.write_eval_results(d.groupBy(F.col("source").alias("model"), F.col("lang").alias("benchmark")).agg(F.round(F.avg("quality"), 3).alias("score")), path)
    writers.write_eval_results(d.groupBy(F.col("source").alias("model")).agg(F.round(F.avg("quality"), 3).alias("score")).withColumn("benchmark", F.lit("all")), path)
    return spark.read.parquet(path).select("model", "benchmark", F.col("score").cast("double").alias("score"), F.col("run_at").isNotNull().alias("dated"))


def append_once(spark, sf_dir):
    """Documents appended in two overlapping parts: which part each came from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = scratch_path(spark, "appended")
    writers.append_new(docs.where("lang <> 'en'").withColumn("part", F.lit(1)), path, "doc_id")
    writers.append_new(docs.withColumn("part", F.lit(2)), path, "doc_id")
    return spark.read.schema("doc_id long, lang string, part int").json(path)


def prefiltered(spark, sf_dir):
    docs = _records(spark, sf_dir).withColumn("source", F.col("title"))
    return ranking.prefilter(docs, (2005, 2019), source=["src0", "src3", "src7"]).select("bibcode", "year", "source")


def section_weights(spark, sf_dir):
    """Items ranked by the better of title (twice) and body."""
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    docs = docs_of(spark, sf_dir).select("doc_id", title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("body"))
    # a document among the first K by its better section is among the first K by that section
    parts = [ranking.lexical_topk(items_of(spark, sf_dir), docs, K, f, PLACES).select("query_id", "doc_id", F.lit(f).alias("section"), (-F.col("score")).alias("score")) for f in ("title", "body")]
    return ranking.weigh_sections(parts[0].unionAll(parts[1]), {"title": 2.0}, K).withColumn("score", F.round("score", 6))


def class_balance(spark, sf_dir):
    out = curate.balance(table(spark, sf_dir, "documents"), "lang", {"en": 0.4, "de": 0.3, "xx": 0.1}, 0.1)
    return out.select("label", "n", F.round("share", 6).alias("share"), "target", "balanced")


def refusal_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = ireval.refusals(d, F.col("quality") == 1, F.col("n_chars") < 200)
    return out.select("n", F.round("false_refusal_rate", 6).alias("false_refusal_rate"), "within_cap")


def scoring_account(spark, sf_dir):
    """Items scored against documents that hold them, by kind, and those without."""
    gold = retrieval.gold_of(spark, sf_dir, retrieval.corpus_of(spark, sf_dir)[0])
    out = ireval.accounting(items_of(spark, sf_dir), gold, retrieval.kind())
    return out.select("n_scored", F.array_join("skipped", ",").alias("skipped"), F.array_join(F.transform(F.array_sort(F.map_entries("n_by_label")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_label"))


def length_buckets(spark, sf_dir):
    return curate.length_groups(table(spark, sf_dir, "documents"), F.col("n_chars"), 500).groupBy("length_group").agg(F.count("*").alias("n"))


def markup_residue(spark, sf_dir):
    """Pages with markup before and after cleaning."""
    html = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return html.select("page_id", curate.residue(F.col("html")).alias("before"), curate.residue(curate.strip_markup(F.col("html"))).alias("after"))


def alias_names(spark, sf_dir):
    """Nations under spellings of their names."""
    nation = table(spark, sf_dir, "nation")
    names = nation.select("n_nationkey", F.concat(F.lower(F.substring("n_name", 1, 3)), F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise(" "), F.substring("n_name", 4, 40)).alias("name"))
    aliases = nation.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("alias"), F.initcap("n_name").alias("canonical"))
    return curate.resolve_aliases(names, aliases)


def chunk_papers(spark, sf_dir):
    papers = _records(spark, sf_dir)
    out = ingest.chunks_with_papers(ingest.chunks(papers), papers.where("year > 2003"))
    return out.select("chunk_id", "bibcode", "title", "year", "token_count")


def unit_vectors(spark, sf_dir):
    """Length and first value of every vector at unit length, and as 64 dimensions."""
    unit = V.normalise(V.assert_dimension(F.col("embedding"), 64))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(V.norm(F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("x0"))


def prefixed_queries(spark, sf_dir):
    return items_of(spark, sf_dir).select("query_id", F.md5(T.with_query_prefix(F.col("query")).cast("binary")).alias("md5"))


def event_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("stamp"))


def rendered_contexts(spark, sf_dir):
    """The first three documents of each item, as a text."""
    top = ranking.lexical_topk(items_of(spark, sf_dir), docs_of(spark, sf_dir), 3, decimals=PLACES).select("query_id", F.format_string("b%d", "doc_id").alias("bibcode"), "rank")
    return render_context(top, _records(spark, sf_dir), 3).select("query_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def underpowered_groups(spark, sf_dir):
    """Sources with too few documents, or too wide an interval of their mean quality (by its standard error)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    half = 1.96 * F.stddev_pop("quality") / F.sqrt(F.count("*"))
    ci = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality") - half, 6).alias("lo"), F.round(F.avg("quality") + half, 6).alias("hi"))
    return stats.underpowered(ci)


def frozen_numbers(spark, sf_dir):
    """Languages whose mean length isn't what the shorter half of sources says."""
    d = table(spark, sf_dir, "documents")
    mean = lambda df: df.groupBy("lang").agg(F.avg("n_chars").alias("mean"))
    out = ireval.frozen_gate(mean(d), mean(d.where("n_chars < 2000")), ["lang"], "mean", 300.0)
    return out.select("lang", F.round("want", 6).alias("want"), F.round("got", 6).alias("got"))


def committed_slices(spark, sf_dir):
    """Items with their committed slice, and whether their gold list has changed since."""
    items = items_of(spark, sf_dir).select("query_id")
    ids = lambda n: F.transform(F.sequence(F.lit(0), F.col("query_id") % n), lambda x: x.cast("string"))
    committed = items.select("query_id", F.when(F.col("query_id") % 2 == 0, "known_item").otherwise("broad_entity").alias("slice"), ids(3).alias("gold"))
    changed = ireval.diverging(committed, items.select("query_id", ids(4).alias("gold")), "known_item").withColumn("changed", F.lit(True))
    return ireval.partitioned(items, committed).join(changed, "query_id", "left").select("query_id", "slice", F.coalesce("changed", F.lit(False)).alias("changed"))


def section_chunks(spark, sf_dir):
    """Windows of 40 words that don't cross lines' sections, counted by document."""
    out = curate.section_windows(docs_of(spark, sf_dir), 40, 5)
    return out.groupBy("doc_id").agg(F.countDistinct("section_index").alias("n_sections"), F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.max("chunk_index").alias("last_chunk"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_round_trip, gold_lines, tsv_round_trip, package_splits, eval_results_log, append_once, prefiltered, section_weights, class_balance, refusal_rate, scoring_account, length_buckets, markup_residue,
        alias_names, chunk_papers, unit_vectors, prefixed_queries, event_stamps, rendered_contexts, underpowered_groups, frozen_numbers, committed_slices, section_chunks,
    )
}

_REC = "rec AS (SELECT 'b' || doc_id AS bibcode, source AS title, CAST(2000 + doc_id % 25 AS INTEGER) AS year, lang || ',' || source AS authors, text AS abstract FROM documents)"
_LABELLED = "d AS (SELECT * FROM documents JOIN labels USING (doc_id))"

ORACLE = {
    "jsonl_round_trip": f"WITH {_REC} SELECT bibcode, title, year, authors, md5(abstract) AS abstract_md5 FROM rec",
    "gold_lines": "SELECT line_no, CASE WHEN item_id % 7 <> 3 THEN printf('e%03d', item_id) END AS example_id, CASE WHEN item_id % 7 <> 3 THEN md5(text) END AS answer_md5, CASE WHEN item_id % 7 = 3 THEN 'line ' || line_no || ': invalid JSON' END AS message FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS line_no FROM benchmark)",
    "tsv_round_trip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "package_splits": "SELECT split, count(*) AS n, count(*) AS n_said, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 95 THEN 'train' ELSE 'eval' END AS split FROM documents) GROUP BY split",
    "eval_results_log": f"WITH {_LABELLED} SELECT source AS model, lang AS benchmark, round(avg(quality), 3) AS score, true AS dated FROM d GROUP BY ALL UNION ALL SELECT source, 'all', round(avg(quality), 3), true FROM d GROUP BY source",
    "append_once": "SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN 1 ELSE 2 END AS part FROM documents",
    "prefiltered": f"WITH {_REC} SELECT bibcode, year, title AS source FROM rec WHERE year BETWEEN 2005 AND 2019 AND title IN ('src0', 'src3', 'src7')",
    "section_weights": f"WITH {retrieval._DOCS}, {retrieval._bm25_sql('bt', 'title')}, {retrieval._bm25_sql('bb', 'body')} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(s) AS score FROM (SELECT query_id, doc_id, -round(raw, 9) * 2 AS s FROM bt UNION ALL SELECT query_id, doc_id, -round(raw, 9) FROM bb) GROUP BY 1, 2)) WHERE rank <= {K}",
    "class_balance": "WITH h AS (SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT * FROM (VALUES ('en', 0.4), ('de', 0.3), ('xx', 0.1)) AS w(label, target)), m AS (SELECT coalesce(l, label) AS label, coalesce(n, 0) AS n, CAST(coalesce(target, 0) AS DOUBLE) AS target FROM h FULL JOIN w ON l = label) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, target, abs(n / sum(n) OVER () - target) <= 0.1 AS balanced FROM m",
    "refusal_rate": f"WITH {_LABELLED} SELECT count(*) AS n, round(avg(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END), 6) AS false_refusal_rate, avg(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) <= 0.1 AS within_cap FROM d WHERE quality = 1",
    "scoring_account": f"WITH {retrieval._GOLD}, s AS (SELECT item_id, CASE WHEN item_id <= 18 THEN 'named' ELSE 'broad' END AS kind, item_id IN (SELECT query_id FROM gold) AS scored FROM benchmark), k AS (SELECT kind || '=' || count(*) AS e FROM s WHERE scored GROUP BY kind) SELECT count(*) FILTER (scored) AS n_scored, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) FILTER (NOT scored), '') AS skipped, (SELECT string_agg(e, ',' ORDER BY e) FROM k) AS by_label FROM s",
    "length_buckets": "SELECT CAST(floor(n_chars / 500) AS INTEGER) AS length_group, count(*) AS n FROM documents GROUP BY 1",
    "markup_residue": rf"SELECT page_id, regexp_matches(coalesce(html, ''), '\\[A-Za-z]+|</?[A-Za-z][^>]*>') AS before, residue AS after FROM pages JOIN ({corpus.ORACLE['clean_markup']}) USING (page_id)",
    "alias_names": "SELECT n_nationkey, lower(substr(n_name, 1, 3)) || CASE WHEN n_nationkey % 3 = 0 THEN '-' ELSE ' ' END || substr(n_name, 4) AS name, CASE WHEN n_nationkey % 5 <> 4 THEN array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS canonical FROM nation",
    "chunk_papers": f"WITH {_REC}, x AS (SELECT *, regexp_replace(regexp_replace(title || '. ' || regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g'), '^[. ]+|[. ]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM rec WHERE year > 2003) SELECT bibcode || ':abstract:0' AS chunk_id, bibcode, title, year, CAST(len([w FOR w IN regexp_split_to_array(t, '\\s+') IF w <> '']) AS BIGINT) AS token_count FROM x",
    "unit_vectors": "SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 6) AS x0 FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)",
    "prefixed_queries": f"SELECT item_id AS query_id, md5('{T.QUERY_PREFIX}' || text) AS md5 FROM benchmark",
    "event_stamps": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events",
    "rendered_contexts": f"WITH {retrieval._LEX}, {_REC} SELECT query_id, md5(string_agg('[' || rank || '] ' || bibcode || '  ' || title || chr(10) || abstract, chr(10) || chr(10) ORDER BY rank)) AS text_md5 FROM lex JOIN rec ON bibcode = 'b' || doc_id WHERE rank <= 3 GROUP BY query_id",
    "underpowered_groups": f"WITH {_LABELLED}, c AS (SELECT source, count(*) AS n, round(avg(quality) - 1.96 * stddev_pop(quality) / sqrt(count(*)), 6) AS lo, round(avg(quality) + 1.96 * stddev_pop(quality) / sqrt(count(*)), 6) AS hi FROM d GROUP BY source) SELECT *, n < 40 OR (hi - lo) / 2 > 0.05 AS underpowered FROM c",
    "frozen_numbers": "SELECT lang, round(want, 6) AS want, round(got, 6) AS got FROM (SELECT lang, avg(n_chars) FILTER (n_chars < 2000) AS want, avg(n_chars) AS got FROM documents GROUP BY lang) WHERE abs(got - want) > 300",
    "committed_slices": "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'known_item' ELSE 'broad_entity' END AS slice, item_id % 2 = 0 AND item_id % 3 <> item_id % 4 AS changed FROM benchmark",
}
