"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Unigrams and bigrams of words are hashed into a fixed number of buckets. Two multinomials over the buckets
are counted: one over the trusted documents, one over the whole corpus. A document's score is the mean of
``log p_target - log p_raw`` over its n-grams, and a document is kept if no base rule fails and the score
reaches a fixed threshold, so the same document always gets the same verdict.

The bucket weights are whole micro-nats, hence scores are sums of integers: they do not depend on the order
of addition or on the number of partitions. The driver sees one weight per bucket, whatever the input size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE, WORD, words

BUCKETS = 10_000
#: trusted documents that the target is counted over, at most: those with the smallest hash of their id
TARGET_ROWS = 20_000
#: mean log-likelihood ratio in nats; measured in README
THRESHOLD = -0.08
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
WINDOW = 8
MICRO = 1_000_000


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def paired(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one that is ``apart`` places later: runs of twice the length."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def ngram_buckets(hashes: Column, pairs: Column, buckets: int) -> Column:
    """Bucket of each unigram, then of each bigram, from the hashes of a document's words and word pairs."""
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids of documents that every label calls good, chosen by a hash of the id."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def clean_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """``trusted_ids`` without documents that any label calls toxic."""
    toxic = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("quality"))
    return trusted_ids(toxic.filter("t = 0"), rows)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Micro-nats per bucket; ``trusted`` has at most ``TARGET_ROWS`` rows, so it is broadcast.

    Both multinomials get one pseudo-count per bucket. Without any trusted document all weights are zero.
    """
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("__target"))), "doc_id", "left"
    )
    grams = flagged.select("__target", word_hashes(words(F.col("text"))).alias("__h"))
    grams = grams.select("__target", F.explode(ngram_buckets(F.col("__h"), paired(F.col("__h"), 1), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__target").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    n_raw, n_target = sum(raw), sum(target)
    if n_target == buckets:
        return [0] * buckets
    return [round(MICRO * (math.log(t / n_target) - math.log(r / n_raw))) for r, t in zip(raw, target)]


def _literal(weights: list[int]) -> Column:
    """One constant array, folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")


def repeated_words(pairs: str) -> tuple[dict[str, Column], Column]:
    """Helper columns, to be added in order, and the count of words inside windows that occur twice or more.

    Windows of eight words are compared by hash: pairs make fours, fours make eights. Sorting happens only for
    texts that repeat a window.
    """
    window, fours, grams = WINDOW, paired(F.col(pairs), 2), paired(F.col("__fours"), 4)
    sorted_grams = F.when(
        F.size(F.array_distinct("__grams")) < F.size("__grams"),
        F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))

    def beside(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(F.col("__sorted"), k)["g"] == x["g"], F.lit(False))

    found = F.transform("__sorted", lambda x, k: F.when(beside(x, k - 1) | beside(x, k + 1), x["i"]))
    twice = F.filter(found, lambda i: i.isNotNull())
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("covered"))
    covered = F.aggregate(
        F.array_sort("__twice"),
        zero,
        lambda a, i: F.struct(
            (i + window).alias("end"), (a["covered"] + (i + window) - F.greatest(i, a["end"])).alias("covered")
        ),
        lambda a: a["covered"],
    )
    return {"__fours": fours, "__grams": grams, "__sorted": sorted_grams, "__twice": twice}, covered


def quality_rules(
    docs: DataFrame, weights: list[int], threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """Add the struct ``__quality`` of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed, kept`` to each row.

    NULL and empty texts have no words and fail the base rules. Repeated rows are judged alike, row by row. Other
    columns pass through, also if they are named like a fact; names that begin with ``__`` are reserved.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    helpers, repeated = repeated_words("__pairs")
    out = docs.withColumn("__h", word_hashes(words(F.col("text")))).withColumn("__pairs", paired(F.col("__h"), 1))
    out = out.withColumn("__b", ngram_buckets(F.col("__h"), F.col("__pairs"), buckets)).withColumn("__lines", lines)
    for name, column in helpers.items():
        out = out.withColumn(name, column)
    weight = _literal(weights)
    total = F.aggregate("__b", F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(weight, b + 1))
    facts = F.struct(
        F.size("__h").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.when(F.size("__b") > 0, total / F.size("__b") / MICRO).otherwise(F.lit(0.0)).alias("score"),
    )
    # a filter on a generated column is not pushed below it, where it would compute all facts again
    measured = out.select(*docs.columns, F.explode(F.array(facts)).alias("__facts"))
    failed = (F.col("__facts.n_words") < MIN_WORDS) | (
        100 * F.col("__facts.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__facts.n_words")
    )
    kept = ~failed & (F.col("__facts.score") >= threshold)
    judged = F.struct("__facts.*", failed.alias("base_failed"), kept.alias("kept"))
    return measured.withColumn("__quality", judged).drop("__facts")
