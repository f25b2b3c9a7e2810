"""Column expressions over text: normalisation, tokens, keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a diacritic and the letters that they are folded to.
FOLD_FROM = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōřśšťùúûüūůýÿžźż"
FOLD_TO = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"
#: Defaults of the retrieval protocol.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
RRF_K = 60


def strip(c: Column) -> Column:
    """White space off both ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def indexed_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as one text, periods and blanks taken off both ends."""
    joined = F.concat(strip(title), F.lit(". "), strip(abstract))
    return strip(F.regexp_replace(joined, r"^[. ]+|[. ]+$", ""))


def whitespace_tokens(c: Column) -> Column:
    """The number of runs of non-white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def query_tokens(c: Column) -> Column:
    """ASCII letters and digits of a query, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def document_tokens(c: Column) -> Column:
    """Letters and digits of any script, lower-cased, diacritics folded."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def document_words(c: Column) -> Column:
    """:func:`document_tokens` before they are folded, joined by blanks; a blank may stand at either end.

    Every letter that is folded becomes a letter, so words are the same before and after.
    """
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def with_query_prefix(c: Column, prefix: str = QUERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), c)


def chunk_id(key: Column, section: str = "abstract", index: int = 0) -> Column:
    return F.concat_ws(":", key.cast("string"), F.lit(section), F.lit(str(index)))


def kind_of(query_id: Column, last_named: int = 18) -> Column:
    """``named`` for ids whose digits are at most ``last_named``, else ``broad``."""
    digits = F.regexp_replace(query_id.cast("string"), "[^0-9]", "")
    return F.when(F.try_to_number(digits, F.lit("9" * 18)) <= last_named, "named").otherwise("broad")


def query_slug(c: Column) -> Column:
    return F.substring(F.sha1(strip(c).cast("binary")), 1, 8)


def default_example_id(family: Column, partition: Column, query: Column, negative: Column) -> Column:
    return F.concat(F.concat_ws("-", family, partition, query_slug(query)), F.when(negative, "-neg").otherwise(""))


def shortened(ids: Column, most: int = 5) -> Column:
    """The first ``most`` of the sorted ids, and an ellipsis where there are more."""
    some = F.array_join(F.slice(F.sort_array(ids), 1, most), ", ")
    return F.concat(some, F.when(F.size(ids) > most, " …").otherwise(""))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by a blank; fewer tokens have none.

    ``tokens`` is named once for each run, so it has to be a plain column.
    """
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Runs of ``n`` characters of the lower-cased text between two blanks and one."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def config_fingerprint(config: dict) -> str:
    """First 8 hex digits of the SHA-256 of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def run_id(config: dict, corpus_hash: str, stamp: str) -> str:
    return f"rrf-pool{config['pool']}-{corpus_hash.rpartition(':')[2][:8]}-{config_fingerprint(config)}-{stamp}"


def utc_stamp(c: Column) -> Column:
    """A timestamp as yyyyMMddTHHmmssZ; the session's time zone has to be UTC."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def connection_label(url: str) -> str:
    """host:port/database of a connection URL, without user and password."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    return f"{parts.hostname or 'localhost'}:{parts.port or 5432}{parts.path or '/'}"
