"""URL filtering by rules and, where none fits, by empirical-Bayes host reputation (DataFrame functions only).

Pages that a rule decides are the labelled outcomes. A host's share of allowed pages is shrunk towards
its registered domain's, that towards its suffix's, and that towards the overall share, each through
a beta-binomial prior whose strength is fitted to the spread of the groups one level down. A page
without a rule is blocked if the lower bound of its host's posterior is under a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import ascii_lower, cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def label(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. For rule lists of up to a few hundred."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.label), r.label)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.label).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """The last two labels; a host without a dot is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def strength(groups: DataFrame, good: str = "good", n: str = "n") -> float:
    """Prior pseudo-counts by the method of moments, from 1 to 1000: groups that differ much give a weak prior. One row reaches the driver."""
    p, n = F.col(good) / F.col(n), F.col(n)
    m = groups.where(n > 0).agg(F.sum(n).alias("n"), F.sum(good).alias("good"), F.count("*").alias("groups"), F.sum(n * p * p).alias("square")).first()
    if not m["n"] or m["groups"] < 2:
        return 1.0
    mean = m["good"] / m["n"]
    within = mean * (1 - mean)
    between = (m["square"] - m["n"] * mean * mean - within * (m["groups"] - 1)) / m["n"]
    return float(min(1000.0, max(1.0, within / between - 1))) if between > 0 and within > 0 else 1.0 if between > 0 else 1000.0


def reputations(judged: DataFrame, z: float = 1.0) -> DataFrame:
    """host, reputation (posterior mean) and bound for every host of judged (host, verdict or null)."""
    hosts = judged.groupBy("host").agg(F.count("verdict").alias("n"), F.count_if(F.col("verdict") == "allow").alias("good")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = cut(hosts, "hosts")  # the pages are read once for all that follows
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    c_suffix, c_domain, c_host = strength(suffixes), strength(domains), strength(hosts)
    shrunk = lambda prior, c: (F.col("good") + c * prior) / (F.col("n") + c)
    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), c_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), c_domain).alias("domain_mean"))
    mean, size = shrunk(F.col("domain_mean"), c_host), F.col("n") + c_host
    return hosts.join(domains, "domain").select("host", mean.alias("reputation"), (mean - z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.25, z: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict and bound for each row of pages.

    A url that is null or has no :// has an empty host and path, which no rule fits; the empty host has a reputation
    like any other. A very long url is one row like others. Without any labelled page the overall share is one half. Repeated rows and ids give a row each;
    an empty table gives an empty result; columns other than page_id and url are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("fit", fitting(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", "fit.rule", "fit.verdict")
    known = reputations(parts.select("host", "verdict"), z).withColumnRenamed("host", "of_host")
    joined = parts.join(known, F.col("host") == F.col("of_host"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bound") < threshold, "block").otherwise("allow")).alias("verdict"), "bound")
