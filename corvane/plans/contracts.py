"""Registered queries: dataset contracts and accounting over derived gold records, with their SQL.

There is no table of gold records, so one is derived from every document by
fixed rules on its doc_id that break each contract rule somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract
from ..sources.schemas import ABSTENTION_REASONS, NEGATIVE_TYPES, TASK_FAMILIES
from .tables import table


def _pick(values, c):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    family = _pick(TASK_FAMILIES, i % 3)
    negative = i % 5 == 0

    def claim(j: int):
        cited = F.when(i % 43 == 0, F.lit("")).when(family == "abstention", F.lit(None).cast("string")).otherwise((i + 7 * j * (i % 4)).cast("string"))
        return F.struct(
            F.when((i % 41 == 0) & F.lit(j == 1), F.lit(" ")).otherwise(F.lit("claim")).alias("text"),
            cited.alias("cited_bibcode"),
            F.when(i % 13 != 0, F.lit("span")).alias("support_span"),
            (~(negative & F.lit(j == 0)) & (i % 47 != 0)).alias("supported"),
        )

    pool = lambda k: F.struct((i + k).cast("string").alias("bibcode"), F.concat((i + k).cast("string"), F.lit(":abstract:0")).alias("chunk_id"), F.lit(1.0).alias("retrieval_score"))
    one, two = F.array(claim(0)), F.array(claim(0), claim(1))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("ex-"), i.cast("string")).alias("example_id"),
        family.alias("task_family"),
        F.when(i % 5 <= 1, "calibration").otherwise("eval").alias("partition"),
        F.concat(F.lit("question "), (i % 401).cast("string")).alias("query"),
        F.array(pool(0), pool(1), pool(7)).alias("retrieved_context"),
        F.when(i % 29 == 0, "  ").otherwise("answer").alias("answer"),
        F.when(i % 17 == 0, F.slice(one, 1, 0)).when(i % 2 == 0, one).otherwise(two).alias("claims"),
        F.when(family == "abstention", F.when(i % 12 != 2, _pick(ABSTENTION_REASONS, i % 4))).otherwise(F.when(i % 37 == 0, F.lit("thin"))).alias("abstention_reason"),
        negative.alias("is_negative"),
        F.when(negative, F.when(i % 35 != 0, _pick(NEGATIVE_TYPES, i % 4))).otherwise(F.when(i % 31 == 0, F.lit("wrong_paper"))).alias("negative_type"),
        F.create_map(F.lit("corpus_hash"), F.when(i % 211 == 0, "h2").otherwise("h1")).alias("provenance"),
    )


def corpus_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("bibcode"))


def contract_errors(spark, sf_dir):
    return contract.structural_errors(gold_of(spark, sf_dir))


def contract_corpus(spark, sf_dir):
    return contract.corpus_findings(gold_of(spark, sf_dir), corpus_of(spark, sf_dir))


def contract_chat(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    chats = t.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: F.struct(m["role"].alias("role"))).alias("messages"))
    return contract.chat_errors(chats)


def composition(spark, sf_dir):
    return contract.composition(gold_of(spark, sf_dir))


def target_progress(spark, sf_dir):
    return contract.target_progress(contract.composition(gold_of(spark, sf_dir)))


def mode_coverage(spark, sf_dir):
    return contract.mode_coverage(contract.composition(gold_of(spark, sf_dir)))


def disjointness(spark, sf_dir):
    return contract.disjointness(gold_of(spark, sf_dir))


def hash_consistency(spark, sf_dir):
    return contract.hash_consistency(gold_of(spark, sf_dir), "h1")


def manifest(spark, sf_dir):
    m = contract.manifest(gold_of(spark, sf_dir), corpus_of(spark, sf_dir), "h1", {"arm": "hybrid", "k": 100, "pool": 100})
    return m.select("valid", F.col("n_errors").cast("long").alias("n_errors"), "corpus_hash", "disjoint", "hashes_match", "mismatched", "retriever")


def claim_grounding(spark, sf_dir):
    """Each benchmark item as a claim on the documents that share a 13-gram with it."""
    from .corpus import contamination

    pairs = contamination(spark, sf_dir).select("item_id", "doc_id")
    claims = pairs.join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span")), "item_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")), "doc_id")
    return contract.grounded(claims).select("item_id", "doc_id", "verbatim", F.round("overlap", 6).alias("overlap"), "grounded")


QUERIES = {f.__name__: f for f in (contract_errors, contract_corpus, contract_chat, composition, target_progress, mode_coverage, disjointness, hash_consistency, manifest, claim_grounding)}

_G = """g AS (SELECT doc_id AS i, 'ex-' || doc_id AS example_id, ['lit_qa', 'summarization', 'abstention'][1 + doc_id % 3] AS family, CASE WHEN doc_id % 5 <= 1 THEN 'calibration' ELSE 'eval' END AS part, 'question ' || (doc_id % 401) AS query,
  doc_id % 5 = 0 AS neg, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1 + doc_id % 2 END AS nc,
  CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 12 <> 2 THEN ['thin', 'contradictory', 'off_topic', 'absent'][1 + doc_id % 4] END WHEN doc_id % 37 = 0 THEN 'thin' END AS reason,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 35 <> 0 THEN ['claim_not_supported', 'contradicts', 'wrong_paper', 'overgeneralization'][1 + doc_id % 4] END WHEN doc_id % 31 = 0 THEN 'wrong_paper' END AS ntype FROM documents)"""
_MSG = """CASE WHEN i % 29 = 0 THEN 'answer must not be empty' WHEN i % 41 = 0 AND nc = 2 THEN 'claim[1].text must not be empty'
  WHEN family = 'abstention' AND reason IS NULL THEN 'abstention task_family requires abstention_reason'
  WHEN family <> 'abstention' AND reason IS NOT NULL THEN 'abstention_reason is only valid for the abstention task_family'
  WHEN family <> 'abstention' AND (nc = 0 OR i % 43 = 0) THEN 'every ' || family || ' claim must cite a bibcode'
  WHEN neg AND part <> 'calibration' THEN 'negatives must be in the calibration partition' WHEN neg AND ntype IS NULL THEN 'is_negative requires a negative_type'
  WHEN neg AND nc = 0 THEN 'a negative must have at least one claim with supported=False' WHEN NOT neg AND ntype IS NOT NULL THEN 'negative_type is only valid when is_negative=True'
  WHEN NOT neg AND nc > 0 AND i % 47 = 0 THEN 'a non-negative example must have all claims supported' END"""
_CLAIMS = """c AS (SELECT *, CASE WHEN i % 43 = 0 THEN '' WHEN family = 'abstention' THEN NULL ELSE CAST(i + 7 * j * (i % 4) AS VARCHAR) END AS cited, NOT (neg AND j = 0) AND i % 47 <> 0 AS sup FROM g, unnest(range(0, nc)) AS r(j)),
f AS (SELECT * FROM (SELECT c.*, EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = cited) AS known, cited IN (CAST(i AS VARCHAR), CAST(i + 1 AS VARCHAR), CAST(i + 7 AS VARCHAR)) AS inpool FROM c) WHERE cited IS NOT NULL),
lost AS (SELECT example_id, 'error' AS level, count(*) || ' retrieved bibcode(s) absent from corpus snapshot: ' || string_agg(id, ', ' ORDER BY id) AS message FROM (SELECT example_id, CAST(i + k AS VARCHAR) AS id FROM g, (VALUES (0), (1), (7)) AS v(k) WHERE i + k NOT IN (SELECT doc_id FROM documents)) GROUP BY example_id),
corpus AS (SELECT * FROM lost UNION ALL
  SELECT example_id, CASE WHEN known AND neg AND ntype = 'wrong_paper' THEN 'warning' ELSE 'error' END, 'claim[' || j || '] cites ' || cited || CASE WHEN NOT known THEN ', absent from corpus snapshot' ELSE ', not in this query''s retrieved_context' END FROM f WHERE NOT known OR NOT inpool UNION ALL
  SELECT example_id, 'warning', 'claim[' || j || '] is supported but has no support_span' FROM f WHERE sup AND i % 13 = 0)"""
_COMP = """m AS (SELECT 'total' AS dimension, 'all' AS value FROM g UNION ALL SELECT 'partition', part FROM g UNION ALL SELECT 'task_family', family FROM g UNION ALL SELECT 'calibration', CASE WHEN neg THEN 'negative' ELSE 'positive' END FROM g WHERE part = 'calibration'
  UNION ALL SELECT 'eval', family FROM g WHERE part = 'eval' UNION ALL SELECT 'abstention_reason', reason FROM g WHERE reason IS NOT NULL UNION ALL SELECT 'negative_type', ntype FROM g WHERE ntype IS NOT NULL),
dom AS (SELECT * FROM (VALUES ('total', 'all'), ('partition', 'calibration'), ('partition', 'eval'), ('task_family', 'lit_qa'), ('task_family', 'summarization'), ('task_family', 'abstention'), ('calibration', 'positive'), ('calibration', 'negative'), ('eval', 'lit_qa'), ('eval', 'summarization'), ('eval', 'abstention'),
  ('abstention_reason', 'thin'), ('abstention_reason', 'contradictory'), ('abstention_reason', 'off_topic'), ('abstention_reason', 'absent'), ('negative_type', 'claim_not_supported'), ('negative_type', 'contradicts'), ('negative_type', 'wrong_paper'), ('negative_type', 'overgeneralization')) AS t(dimension, value)),
comp AS (SELECT dimension, value, count(m.value) AS n FROM dom LEFT JOIN m USING (dimension, value) GROUP BY 1, 2)"""
ORACLE = {
    "contract_errors": f"WITH {_G} SELECT example_id, message FROM (SELECT example_id, {_MSG} AS message FROM g) WHERE message IS NOT NULL",
    "contract_corpus": f"WITH {_G}, {_CLAIMS} SELECT * FROM corpus",
    "contract_chat": "SELECT id, message FROM (SELECT conv_id AS id, CASE WHEN count(*) < 2 THEN 'messages: at least 2' WHEN count(*) FILTER (role IN ('system', 'user', 'assistant', 'tool')) < count(*) THEN 'messages: unknown role' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'messages: no assistant turn' END AS message FROM conversations GROUP BY 1) WHERE message IS NOT NULL",
    "composition": f"WITH {_G}, {_COMP} SELECT * FROM comp",
    "target_progress": f"""WITH {_G}, {_COMP} SELECT grp AS "group", coalesce(n, 0) AS n, least AS "least", most, CASE WHEN coalesce(n, 0) < least THEN 'under' WHEN coalesce(n, 0) > most THEN 'over' ELSE 'met' END AS status
FROM (VALUES ('calibration/positive', 40::BIGINT, NULL::BIGINT), ('calibration/negative', 40, 60), ('eval/lit_qa', 40, NULL), ('eval/summarization', 30, NULL), ('eval/abstention', 25, NULL), ('total', 170, 230)) AS t(grp, least, most) LEFT JOIN comp ON CASE WHEN dimension = 'total' THEN 'total' ELSE dimension || '/' || value END = grp""",
    "mode_coverage": f"WITH {_G}, {_COMP} SELECT count(*) FILTER (n > 0) AS covered, count(*) FILTER (n > 0) = 4 AS all_covered FROM comp WHERE dimension = 'negative_type'",
    "disjointness": f"WITH {_G} SELECT query FROM g WHERE part = 'calibration' INTERSECT SELECT query FROM g WHERE part = 'eval'",
    "hash_consistency": "SELECT count(*) FILTER (doc_id % 211 = 0) = 0 AS all_match, coalesce(max(CASE WHEN doc_id % 211 = 0 THEN 'h2' END), '') AS mismatched FROM documents",
    "manifest": f"""WITH {_G}, {_CLAIMS}, msgs AS (SELECT example_id, {_MSG} AS message FROM g), e AS (SELECT (SELECT count(*) FROM msgs WHERE message IS NOT NULL) + (SELECT count(*) FROM corpus WHERE level = 'error' AND example_id IN (SELECT example_id FROM msgs WHERE message IS NULL)) AS n,
(SELECT count(*) FROM (SELECT query FROM g WHERE part = 'calibration' INTERSECT SELECT query FROM g WHERE part = 'eval')) = 0 AS disjoint, (SELECT count(*) FROM documents WHERE doc_id % 211 = 0) = 0 AS ok)
SELECT n = 0 AND disjoint AND ok AS valid, n AS n_errors, 'h1' AS corpus_hash, disjoint, ok AS hashes_match, CASE WHEN ok THEN '' ELSE 'h2' END AS mismatched, '{{"arm":"hybrid","k":100,"pool":100}}' AS retriever FROM e""",
}


def _grounding_sql() -> str:
    from .corpus import FOLD
    from .corpus import ORACLE as CORPUS

    toks = "list_distinct(regexp_extract_all(" + FOLD.format("{0}") + ", '[\\p{{L}}\\p{{N}}]+'))"
    return f"""WITH pairs AS ({CORPUS['contamination']}), t AS (SELECT item_id, doc_id, contains(d.text, b.text) AS verbatim, {toks.format('b.text')} AS a, {toks.format('d.text')} AS w FROM pairs JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, verbatim, round(len(list_intersect(a, w)) / len(a), 6) AS overlap, verbatim OR len(list_intersect(a, w)) / len(a) >= 0.5 AS grounded FROM t"""


ORACLE["claim_grounding"] = _grounding_sql()
