"""URL filter: rules first, then the reputation of hosts by empirical Bayes.

Labelled pages give each host a number of good outcomes. Its rate is shrunk towards the
rate of its registered domain, that towards the rate of its public suffix, that towards the
rate of all pages: each level is a beta prior for the one below, and the strength of each
prior is estimated from how much the rates of that level differ beyond chance. A page is
allowed if the lower bound of its host's posterior is high enough.

Everything is built-in SQL functions. What is shuffled is one row per host of each task,
and the URLs once when they meet the hosts' bounds; a hot host is salted there.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_names, lower_ascii, spread_join, stored

#: Second-level suffixes under which names are registered; a parameter of ``judge``.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
MIN_GOOD = 0.5
Z = 1.645
SALTS = 32


class Rule(NamedTuple):
    verdict: str
    where: str  # host and path, like example.com/en/


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that holds for the host or a domain above it and for the path; or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.where)):
        name, slash, rest = rule.where.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule.where)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: one of ``suffixes`` or else the last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes) & (host != two), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    labels = F.length(suffix) - F.length(F.replace(suffix, F.lit("."), F.lit(""))) + 2
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _strength(children: DataFrame, k: str, n: str, prior: str) -> Column:
    """Pseudo-counts of a beta prior by the method of moments over the children's rates."""
    rate = F.greatest(F.least(F.col(prior), F.lit(1 - 1e-6)), F.lit(1e-6))
    gap = F.col(k) / F.col(n) - rate
    excess = F.sum(F.col(n) * gap * gap / (rate * (1 - rate))) - F.count("*")
    scale = F.sum(n) - F.count("*")
    rho = F.when(scale > 0, excess / scale).otherwise(F.lit(0.5))
    rho = F.greatest(F.least(rho, F.lit(0.99)), F.lit(0.001))
    return F.coalesce(1 / rho - 1, F.lit(1.0))


def reputations(
    pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, z: float = Z
) -> DataFrame:
    """One row per host of ``pages``: host, domain, suffix, n, k, mean, bound.

    ``pages`` has (page_id, url), ``outcomes`` (page_id, good BOOLEAN; null and unknown pages
    do not count; of repeated rows of a page one bad one makes it bad). Hosts without an
    outcome have their domain's posterior, and so on up; with no outcome at all the
    prior mean is one half.
    """
    host, _ = parts(F.col("url"))
    seen = outcomes.where("good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    counted = pages.select("page_id", host.alias("host")).join(seen, "page_id", "left")
    hosts = counted.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k")
    )
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    top = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()  # two numbers
    overall = ((top["k"] or 0) + 1.0) / ((top["n"] or 0) + 2.0)

    def totals(level: DataFrame, *by: str) -> DataFrame:
        return level.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrunk(level: DataFrame, prior: str) -> DataFrame:
        """Adds a (good) and b (bad) of the posterior and its mean; the strength is one number."""
        s = level.where("n > 0").agg(_strength(level, "k", "n", prior).alias("s")).first()["s"]
        a, b = F.col("k") + s * F.col(prior), F.col("n") - F.col("k") + s * (1 - F.col(prior))
        return level.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    domains = totals(hosts, "domain", "suffix")
    suffix_rows = shrunk(totals(domains, "suffix").withColumn("prior", F.lit(overall)), "prior")
    above = suffix_rows.select("suffix", F.col("mean").alias("prior"))
    domain_rows = shrunk(domains.join(above, "suffix"), "prior")
    above = domain_rows.select("domain", F.col("mean").alias("prior"))
    host_rows = shrunk(hosts.join(above, "domain"), "prior")
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return host_rows.select(
        "host", "domain", "suffix", "n", "k", "mean", F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("bound")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    min_good: float = MIN_GOOD,
    suffixes: Sequence[str] = SUFFIXES,
    z: float = Z,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and the host's bound.

    Every row is kept, repeated ones too. A null url or one without ``://`` has an empty host
    and path; pages without a host are one host of their own. The verdict is the longest
    fitting rule's, else allow if the bound is at least ``min_good``. New columns whose names
    are taken get underscores behind them. An empty table gives an empty result.
    """
    verdicts = {r.where: r.verdict for r in rules}
    host, path = parts(F.col("url"))
    names = free_names(pages, "host", "path", "rule", "verdict", "bound")
    h, p, r, v, b = names
    named = pages.withColumn(h, host).withColumn(p, path)
    named = named.withColumn(r, fitting_rule(F.col(h), F.col(p), rules))
    bounds = reputations(pages, outcomes, suffixes, z).select(F.col("host").alias(h), F.col("bound").alias(b))
    joined = spread_join(named, bounds, [h], SALTS, F.struct("page_id", "url"))
    by_rule = F.lit(None).cast("string")
    for where, verdict in verdicts.items():
        by_rule = F.when(F.col(r) == where, F.lit(verdict)).otherwise(by_rule)
    by_method = F.when(F.col(b) >= min_good, F.lit("allow")).otherwise(F.lit("block"))
    return joined.withColumn(v, F.coalesce(by_rule, by_method)).select(*pages.columns, *names)
