"""URL filters: explicit rules, and empirical-Bayes host reputation for every other page.

Labelled page outcomes are good or bad. A host's rate of good pages is shrunk through beta-binomial priors:
from the corpus to the public suffix, from the suffix to the registered domain, from the domain to the host.
The strength of each prior is estimated from the data by the method of moments: with mean ``m`` of the parent
and ``k`` good of ``n`` pages of a child, the overdispersion ``rho`` solves
``sum (k - n m)^2 = sum n m (1 - m) (1 + (n - 1) rho)``, and the prior counts as ``1 / rho - 1`` pages. A host
passes if the lower bound ``mean - Z * deviation`` of its posterior reaches ``MIN_GOOD``.

Three numbers per level reach the driver. Everything else is aggregation and joins by host, domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: (verdict, host, path): fixed values
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: suffixes of two labels under which domains are registered: fixed values
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
Z, MIN_GOOD = 1.645, 0.5
MIN_RHO, MAX_RHO = 0.001, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    after = F.locate("://", url)
    rest = F.when(after > 0, F.substr(url, after + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; NULL if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, site, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        rule = F.when(fits, site + start).otherwise(rule)
        verdict = F.when(fits, action).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address is its own domain under the suffix ``ip``."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)
    address = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, name).otherwise(domain), F.when(address, F.lit("ip")).otherwise(suffix)


def _strength(rows: DataFrame) -> float:
    """Pages that the parent's mean counts for, from rows ``n, k, parent``."""
    spread = F.col("parent") * (1 - F.col("parent"))
    sums = rows.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("parent"), 2)),
        F.sum(F.col("n") * spread),
        F.sum(F.col("n") * (F.col("n") - 1) * spread),
    ).first()
    rho = (sums[0] - sums[1]) / sums[2] if sums[2] else 0.0
    # sums of doubles may differ in their last digits from run to run; the rounded value does not
    return round(1 / min(max(rho, MIN_RHO), MAX_RHO) - 1, 6)


def _posterior(rows: DataFrame, strength: float) -> Column:
    return (F.col("k") + strength * F.col("parent")) / (F.col("n") + strength)


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, k, mean, lower`` for every host of ``pages (page_id, host)``.

    ``outcomes`` has ``page_id, good BOOLEAN``; a page with several outcomes is good if all are, NULL outcomes
    and NULL ids are skipped. Pages without a host share the empty host. Without any outcome every host gets
    the mean of a uniform prior. Rows of ``pages`` that repeat an id are counted as often as they come.
    """
    known = outcomes.filter("page_id is not null and good is not null").groupBy("page_id")
    known = known.agg(F.min(F.col("good").cast("int")).alias("good"))
    domain, suffix = registered_domain(F.col("host"))
    counts = pages.join(known, "page_id", "left").groupBy("host")
    counts = counts.agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    counts = materialize(counts.select("*", domain.alias("domain"), suffix.alias("suffix")), "host-counts")

    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rows = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rows = rows.withColumn("parent", F.lit((total[1] + 1) / (total[0] + 2)))
    suffixes = rows.select("suffix", _posterior(rows, _strength(rows)).alias("parent"))
    rows = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains = rows.select("domain", "suffix", _posterior(rows, _strength(rows)).alias("parent"))
    rows = counts.join(domains, ["domain", "suffix"])
    strength = _strength(rows)
    a = F.col("k") + strength * F.col("parent")
    b = F.col("n") - F.col("k") + strength * (1 - F.col("parent"))
    mean, deviation = a / (a + b), F.sqrt(a * b / (a + b + 1)) / (a + b)
    return rows.select("host", "n", "k", mean.alias("mean"), (mean - Z * deviation).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages (page_id, url)``.

    A fitting rule decides; any other page gets its host's verdict: allow if the posterior bound reaches
    ``min_good``. NULL urls and urls without ``://`` have an empty host and path, to which no rule fits.
    """
    host, path = url_parts(F.coalesce(F.col("url"), F.lit("")))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(parts, outcomes).select(
        "host", F.when(F.round("lower", 9) >= min_good, "allow").otherwise("block").alias("reputation")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = parts.join(known, "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation").alias("verdict"))
