"""Mixing sources to target weights by iterative proportional fitting.

The documents are counted into cells of (source, lang, topic) with their
tokens. Raking scales the probability p of each cell so that the expected tokens
of one margin after the other meet their targets, ``rounds`` times. p never
exceeds 1: where a class falls short, its cells at 1 are taken out and the rest
of its target is raked over the others, so the targets hold for what is drawn
and not only for weights before a cap. The draw is a hash of doc_id, so it can be
repeated.

``budget`` is the share of all tokens to draw, and a target is a class's share of
them. ``targets`` gives the shares of a margin's classes (normalised; classes not
named get none). A margin without targets gets tempered shares, share**alpha of
its tokens; a class that would need more tokens than it has gets all it has, and
the others share what is left. Given targets that can't be met raise an error
that names the margin and the class: before raking where a class has too few
tokens, after it where the margins contradict one another, that is where a class
is off by more than ``tolerance`` of the drawn tokens.

Empty and null values are classes like any other; documents without tokens are
drawn by the probability of their cell, which starts at ``budget``. Everything
runs as DataFrame operations: cells are pre-aggregated before their shuffle,
rounds are windows over the cells, and the cells are joined back to the
documents. Up to ``ONE_TASK`` cells are kept in one partition, where a window
needs no shuffle; more are shuffled by class, with the same result.

The topic of a document is a column or an expression that the caller names; by
default it is the form of its text (:func:`form`), which needs no model.

Defined results: an empty table gives an empty table; null text has no tokens;
rows that repeat a doc_id are drawn alike, rows without one are drawn by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release

MARGINS = ("m_source", "m_lang", "m_topic")
#: Exponents of the target shares: below 1 small classes gain.
ALPHA = {"m_source": 0.5, "m_lang": 0.7, "m_topic": 0.8}
ONE_TASK = 200_000
#: Steps in which the budget of classes without enough tokens goes to the others.
FILLS = 4
#: From here on a probability counts as 1, whatever the order of its sums.
FULL = 1 - 1e-9


def form(text: Column) -> Column:
    """A text's form: noise marks, shouting, cells of a table, list of lines, or prose."""
    return (
        F.when(text.rlike(r"[*#$%&]{3}"), "noise")
        .when(text.contains("!!"), "shout")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words between single ASCII blanks and line ends; 0 for null or empty text."""
    return F.coalesce(F.when(F.length(text) > 0, F.length(text) - F.length(F.translate(text, " \n", "")) + 1), F.lit(0)).cast("long")


def keyed(documents: DataFrame, topic: Column | str | None = None, extra: str | None = None) -> DataFrame:
    """doc_id with the margins, tokens and draw of every document."""
    text = F.col("text")
    null = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    seed = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    if topic is None:
        topic = form(F.coalesce(text, F.lit("")))
    elif isinstance(topic, str):
        topic = F.col(topic)
    return documents.select(
        "doc_id",
        null(F.col("source")).alias("m_source"),
        null(F.col("lang")).alias("m_lang"),
        null(topic).alias("m_topic"),
        tokens(text).alias("n_tokens"),
        (F.conv(F.substring(F.md5(seed.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))).alias("draw"),
        *([extra] if extra else []),
    )


def wanted_tokens(cells: DataFrame, margin: str, budget: float, alpha: float, given: dict[str, float] | None) -> DataFrame:
    """``margin`` and ``t_margin``, the tokens that a class is to have, of classes with tokens."""
    have = cells.groupBy(margin).agg(F.sum("n_tokens").cast("double").alias("have")).where("have > 0")
    all_ = Window.partitionBy(F.lit(0))
    whole = F.sum("have").over(all_)
    if given is None:
        raw = F.pow(F.col("have") / whole, F.lit(alpha))
    else:
        raw = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(margin)), F.lit(0.0))
    out = have.select(margin, "have", raw.alias("raw"), (whole * F.lit(budget)).alias("b")).withColumn("scale", F.lit(0.0))
    for _ in range(FILLS if given is None else 1):
        full = F.col("raw") * F.col("scale") >= F.col("have")
        rest = F.sum(F.when(~full, F.col("raw"))).over(all_)
        spent = F.coalesce(F.sum(F.when(full, F.col("have"))).over(all_), F.lit(0.0))
        out = out.withColumn("scale", F.when(rest > 0, F.greatest("scale", (F.col("b") - spent) / rest)).otherwise(F.col("scale")))
    need = F.col("raw") * F.col("scale")
    if given is not None:
        out = materialize(out, "targets")
        short = out.where(need > F.col("have") * (1 + 1e-9)).orderBy(margin).first()
        missing = sorted(k for k, v in given.items() if v > 0 and out.where(F.col(margin) == k).limit(1).count() == 0)
        if short or missing:
            name = short[margin] if short else missing[0]
            raise ValueError(f"target of {margin[2:]} {name!r} can't be reached: it has too few tokens for a budget of {budget}")
    return out.select(margin, F.least(need, F.col("have")).alias(f"t_{margin}"))


def rake(cells: DataFrame, rounds: int) -> DataFrame:
    """Cells (margins, n_docs, n_tokens, targets, p) after ``rounds`` of raking."""
    out = cells
    for r in range(rounds):
        for m in MARGINS:
            class_ = Window.partitionBy(m)
            t, p, n = F.col(f"t_{m}"), F.col("p"), F.col("n_tokens")
            sums = out.withColumns({"have": F.sum(p * n).over(class_), "full": F.sum(F.when(p >= FULL, n.cast("double")).otherwise(0.0)).over(class_)})
            have, full = F.col("have"), F.col("full")
            scaled = (
                F.when((have <= 0) | t.isNull(), p)
                .when(have >= t, p * t / have)
                .when(p >= FULL, p)
                .when(have > full, F.least(F.lit(1.0), p * (t - full) / (have - full)))
                .otherwise(p)
            )
            out = sums.withColumn("p", scaled).drop("have", "full")
        if r % 4 == 3:  # plans of four rounds at most
            old, out = out, materialize(_gathered(out, cells), "cells")
            if old is not cells:
                release(old)
    return out


def _gathered(out: DataFrame, cells: DataFrame) -> DataFrame:
    return out.coalesce(1) if getattr(cells, "_one_task", False) else out


def residual(cells: DataFrame, margin: str) -> tuple[float, str | None]:
    """The largest share of the drawn tokens by which a class misses its target, and the class."""
    off = cells.groupBy(margin).agg(F.sum(F.col("p") * F.col("n_tokens")).alias("have"), F.first(f"t_{margin}").alias("t")).where("t is not null")
    worst = off.select(margin, F.abs(F.col("have") - F.col("t")).alias("off"), F.sum("t").over(Window.partitionBy(F.lit(0))).alias("whole")).orderBy(F.desc("off"), margin).first()
    return (0.0, None) if worst is None or not worst["whole"] else (worst["off"] / worst["whole"], worst[margin])


def weights(
    documents: DataFrame, budget: float = 0.5, alpha: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, topic: Column | str | None = None, rounds: int = 8, tolerance: float = 0.01
) -> DataFrame:
    """The cells with n_docs, n_tokens, p and the wanted tokens of their classes.

    ``targets`` has shares by ``source``, ``lang`` and ``topic``, of any of them.
    """
    alpha, targets = ALPHA | (alpha or {}), {f"m_{k}": v for k, v in (targets or {}).items()}
    if not 0 < budget <= 1 or targets.keys() - set(MARGINS):
        raise ValueError("budget is a share of the tokens; targets go by source, lang and topic")
    counted = keyed(documents, topic).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    counted = materialize(counted, "cells")
    cells = counted.withColumn("p", F.lit(float(budget)))
    for m in MARGINS:
        cells = cells.join(wanted_tokens(counted, m, budget, alpha[m], targets.get(m)), m, "left")
    few = counted.count() <= ONE_TASK
    cells = materialize(cells.coalesce(1) if few else cells, "cells")
    cells._one_task = few
    raked = rake(cells, rounds)
    release(counted)
    for m in targets:
        off, name = residual(raked, m)
        if off > tolerance:
            raise ValueError(f"target of {m[2:]} {name!r} can't be reached beside those of the other margins: off by {off:.4f} of the drawn tokens")
    return raked


def chosen(documents: DataFrame, topic: Column | str | None = None, **options) -> DataFrame:
    """doc_id, margins, n_tokens, p (shown to six places) and kept of every document."""
    cells = weights(documents, topic=topic, **options).select(*MARGINS, "p")
    met = keyed(documents, topic).join(cells, list(MARGINS))
    return met.select("doc_id", *MARGINS, "n_tokens", F.round("p", 6).alias("p"), (F.col("draw") < F.col("p")).alias("kept"))


def sample(documents: DataFrame, topic: Column | str | None = None, **options) -> DataFrame:
    """The documents drawn, with their own columns."""
    cells = weights(documents, topic=topic, **options).select(*MARGINS, "p")
    if isinstance(topic, str):
        topic = F.col(topic)
    row = F.struct(*documents.columns)
    with_keys = keyed(documents.withColumn("_row", row), topic, extra="_row")
    return with_keys.join(cells, list(MARGINS)).where(F.col("draw") < F.col("p")).select("_row.*")


def sql(table: str = "documents", budget: float = 0.5, alpha: dict[str, float] | None = None, rounds: int = 8) -> str:
    """DuckDB SQL for :func:`chosen` with tempered targets, the rounds written out."""
    alpha = ALPHA | (alpha or {})
    parts = [
        f"""keyed AS MATERIALIZED (SELECT doc_id, coalesce(source, '(null)') AS m_source, coalesce(lang, '(null)') AS m_lang,
  CASE WHEN regexp_matches(coalesce(text, ''), '[*#$%&]{{3}}') THEN 'noise' WHEN contains(coalesce(text, ''), '!!') THEN 'shout'
       WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 400 THEN 'note' ELSE 'prose' END AS m_topic,
  CAST(CASE WHEN length(text) > 0 THEN length(text) - length(translate(text, chr(10) || ' ', '')) + 1 ELSE 0 END AS BIGINT) AS n_tokens,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)} AS draw FROM {table})""",
        f"counted AS MATERIALIZED (SELECT m_source, m_lang, m_topic, CAST(sum(n_tokens) AS DOUBLE) AS n, {float(budget)}::DOUBLE AS p FROM keyed GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"a0_{m} AS (SELECT {m}, have, pow(have / sum(have) OVER (), {alpha[m]}) AS raw, sum(have) OVER () * {budget} AS b, 0.0::DOUBLE AS scale FROM (SELECT {m}, sum(n) AS have FROM counted GROUP BY 1 HAVING sum(n) > 0))")
        for k in range(FILLS):
            rest, spent = "sum(CASE WHEN raw * scale < have THEN raw END) OVER ()", "coalesce(sum(CASE WHEN raw * scale >= have THEN have END) OVER (), 0)"
            parts.append(f"a{k + 1}_{m} AS MATERIALIZED (SELECT {m}, have, raw, b, CASE WHEN {rest} > 0 THEN greatest(scale, (b - {spent}) / {rest}) ELSE scale END AS scale FROM a{k}_{m})")
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, least(raw * scale, have) AS t_{m} FROM a{FILLS}_{m})")
    parts.append("cells AS MATERIALIZED (SELECT c.*, t_m_source, t_m_lang, t_m_topic FROM counted c LEFT JOIN t_m_source USING (m_source) LEFT JOIN t_m_lang USING (m_lang) LEFT JOIN t_m_topic USING (m_topic))")
    last = "cells"
    for r in range(rounds):
        for m in MARGINS:
            t, now = f"t_{m}", f"c{r}_{m}"
            scaled = f"CASE WHEN h <= 0 OR {t} IS NULL THEN p WHEN h >= {t} THEN p * {t} / h WHEN p >= {FULL!r} THEN p WHEN h > f THEN least(1.0, p * ({t} - f) / (h - f)) ELSE p END"
            sums = f"SELECT *, sum(p * n) OVER (PARTITION BY {m}) AS h, sum(CASE WHEN p >= {FULL!r} THEN n ELSE 0 END) OVER (PARTITION BY {m}) AS f FROM {last}"
            parts.append(f"{now} AS MATERIALIZED (SELECT m_source, m_lang, m_topic, n, t_m_source, t_m_lang, t_m_topic, {scaled} AS p FROM ({sums}))")
            last = now
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, m_source, m_lang, m_topic, n_tokens, round(p, 6) AS p, draw < p AS kept FROM keyed JOIN {last} USING (m_source, m_lang, m_topic)"
