"""Quality rules with verdicts on hosts, by DataFrame functions alone.

Every document gets its counts in one pass without a shuffle. Rule failures are then summed by host (partial sums before
the shuffle, so one hot host is a few rows a task), each host's rate is shrunk towards all hosts' by a beta prior fitted
to them by the method of moments, and the verdict joins back to the documents' digests.

Defined results: a null text has no words; a null host counts with the empty host; repeated rows are judged row by row;
an empty table gives an empty result; other columns of the input are ignored, whatever their names; a text that isn't a
URL has no host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, staged

RULES = ("short", "repetitive", "symbols", "dup_lines")


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Of the characters in words, and of the lines with a word; a document beyond goes whatever its host.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    #: A host goes when its shrunk rate of failures of any rule is above this.
    max_host_rate: float = 0.6
    #: Prior strength where hosts are too few or too alike to fit one.
    default_strength: float = 20.0


def repeat_words(words: str) -> list:
    """Steps (name, column) that end in ``n_repeat_words``: words inside 3-word windows that occur twice or more.

    Windows are told apart by a 64-bit hash of their words. Sorted hashes show whether any occurs twice; only texts with
    such a window sort (hash, place) pairs to find the places.
    """
    at = lambda i: F.get(words, i)
    steps = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(steps, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    prev = lambda k: F.get("_sorted", k - 1)
    twice = F.exists(F.sequence(F.lit(1), F.size("_sorted") - 1), lambda k: F.get("_sorted", k) == prev(k))
    pairs = F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda e, k: F.coalesce(F.get("_pairs", k)["x"] == e["x"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_pairs", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    spans = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3))))
    return [
        ("_hashes", hashes),
        ("_sorted", F.sort_array("_hashes")),
        ("_pairs", F.when((F.size("_sorted") >= 2) & twice, pairs)),
        ("_places", F.when(F.col("_pairs").isNotNull(), places)),
        ("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).cast("bigint")),
    ]


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without a leading ``www.``; null where there is none. For ``host_col``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source") -> DataFrame:
    """Id, host and counts of each document."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    packed = F.regexp_replace("_text", SPACES, "")
    df = df.select(
        "doc_id",
        "host",
        F.filter(F.split("_text", SPACES), lambda w: w != "").alias("_words"),
        F.length(packed).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.select(
        "doc_id",
        "host",
        "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    for name, column in repeat_words("_words"):
        df = df.withColumn(name, column)
    return df.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def failures(p: HostRules) -> dict[str, Column]:
    """Each rule's failure, on the columns of a digest."""
    c = F.col
    return {
        "short": c("n_words") < p.min_words,
        "repetitive": 100 * c("n_repeat_words") > p.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > p.max_symbol_percent * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > p.max_dup_line_percent * c("n_lines"),
    }


def host_rates(digests: DataFrame, p: HostRules) -> DataFrame:
    """Per host: documents, and each rule's shrunk failure rate.

    With rates r over k hosts of mean m and variance v, a beta prior has strength s = m(1-m)/v - 1 and weight m*s on
    failure; the shrunk rate is (failures + m*s) / (documents + s). The moments are one row, read by the driver.
    """
    fails = failures(p)
    hosts = digests.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(fails[r].cast("bigint")).alias(f"f_{r}") for r in RULES])
    hosts = staged(hosts, "hosts")
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    moments = hosts.agg(F.count("*").alias("k"), *[F.avg(rate[r]).alias(f"m_{r}") for r in RULES], *[F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES]).first()
    out = [F.col("host").alias("host"), F.col("n_docs")]
    for r in RULES:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        s = p.default_strength
        if moments["k"] >= 2 and v > 0 and m * (1 - m) > v:
            s = m * (1 - m) / v - 1
        out.append(((F.col(f"f_{r}") + m * s) / (F.col("n_docs") + s)).alias(f"rate_{r}"))
    return hosts.select(*out)


def apply_rules(docs: DataFrame, p: HostRules | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source") -> DataFrame:
    """Digest, ``base_failed``, ``host_rate`` (the worst rule's) and ``kept`` for every document."""
    p = p or HostRules()
    digests = staged(digest(docs, id_col, text_col, host_col), "digests")
    rates = host_rates(digests, p)
    hosts = rates.select("host", F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("host_rate"))
    fails = failures(p)
    base = fails["short"] | fails["repetitive"]
    out = digests.join(hosts, "host", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~fails["symbols"] & ~fails["dup_lines"] & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= p.max_host_rate)).alias("kept"),
        "host", "host_rate",
    )
