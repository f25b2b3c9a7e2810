"""Languages by profiles of character n-grams, learnt from rows whose language is known.

A profile is the ``size`` most frequent n-grams of one to three letters (words
padded with blanks, lower case), by rank. A text's own n-grams are ranked in the
same way, and the language with the smallest sum of differences in rank wins;
n-grams that a profile lacks count ``size``. Counts are made in the task, by Arrow
batch, and summed by language and n-gram, so the shuffle has one row a different
n-gram, batch and language, whatever the length of texts. Profiles are ``size`` rows a language:
they are read to the driver and sent to the tasks with the languages counted first.

Defined results: null and empty texts, and texts without letters, are ``und``; rows
without text or language teach nothing; equal counts are ranked by n-gram, equal
distances go to the smaller language code.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import import_path, spread

SIZE, MOST_LANGUAGES = 400, 2000
_LETTERS = re.compile(r"[^\W\d_]+")


def ngrams(text: str) -> Counter:
    """How often each n-gram of one to three letters occurs; words are padded."""
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower())).items():
        padded = f" {word} "
        for width in (1, 2, 3):
            for at in range(len(padded) - width + 1):
                gram = padded[at : at + width]
                if gram != " ":
                    out[gram] += n
    return out


def top(counts: Counter, size: int) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def learn(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """lang, gram and rank (from 0) from rows of text and lang."""
    import_path(docs.sparkSession)

    def count(batches):
        for batch in batches:
            held: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(ngrams(text))
            rows = [(lang, g, n) for lang, counts in held.items() for g, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    known = spread(docs.select("text", "lang").where("text is not null and lang is not null"))
    counts = known.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < size)


def out_of_place(grams: list[str], profile: dict[str, int], size: int) -> int:
    """Sum of the differences between places; ``size`` for what the profile lacks."""
    get = profile.get
    return sum(abs(i - get(g, i + size)) for i, g in enumerate(grams))


def guess(docs: DataFrame, profiles: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, guess and distance (a share of the largest possible one) of every row."""
    spark = docs.sparkSession
    import_path(spark)
    n = profiles.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known: dict[str, dict[str, int]] = {}
    for r in profiles.collect():  # size rows a language
        known.setdefault(r.lang, {})[r.gram] = r["rank"]
    shared = spark.sparkContext.broadcast(sorted(known.items()))

    @F.pandas_udf("guess string, distance double")
    def nearest(texts):
        import pandas as pd

        out = []
        for text in texts:
            grams = top(ngrams(text), size) if text else []
            sums = [(out_of_place(grams, p, size), lang) for lang, p in shared.value] if grams else []
            best = min(sums) if sums else (None, "und")
            out.append((best[1], best[0] / (size * len(grams)) if sums else None))
        return pd.DataFrame(out, columns=["guess", "distance"])

    return spread(docs.select("doc_id", "text")).select("doc_id", nearest("text").alias("g")).select("doc_id", "g.*")


def accuracy(guesses: DataFrame, truth: DataFrame, on: Column | str = "doc_id") -> DataFrame:
    """n and accuracy of guesses (doc_id, guess) against doc_id and lang; rows without a lang don't count."""
    met = truth.where("lang is not null").join(guesses, on)
    return met.agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col("lang")).cast("double")).alias("accuracy"))
