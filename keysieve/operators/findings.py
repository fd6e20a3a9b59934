"""From hits to findings: one row for each secret, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions import scalars
from keysieve.plans.rules import RULES, SEVERITIES, Rule, env_rule, rules_table

LOCATION = "struct<agent:string,file:string,line:int,json_path:string,session:string,project:string,timestamp:string,origin:string>"
#: Origins in order of display, and what they say.
ORIGINS = (
    ("prompt", "pasted into a prompt"),
    ("tool-output", "printed by a tool"),
    ("assistant", "repeated by the model in an answer"),
    ("file-snapshot", "in a file backup that the agent keeps"),
    ("history", "in the prompt history"),
    ("config", "saved in an agent's settings"),
    ("other", "session metadata"),
)


def location(**columns: Column) -> Column:
    """A location struct; what isn't given is empty."""
    empty = {"line": F.lit(0)}
    names = ("agent", "file", "line", "json_path", "session", "project", "timestamp", "origin")
    return F.struct(*(F.coalesce(columns.get(n, empty.get(n, F.lit(""))), empty.get(n, F.lit(""))).cast("int" if n == "line" else "string").alias(n) for n in names))


def merge(hits: DataFrame, rules: list[Rule] | None = None, locations: bool = True) -> DataFrame:
    """One finding for each fingerprint of hits (ord, rule_id, severity_rank, secret, location).

    The rule with the smallest ord names it; equal locations count once, ordered by timestamp (none last), file and line.
    Partial aggregation keeps one row for each fingerprint and location before the shuffle. rules: those the hits are of,
    if there are custom ones among them. Without locations nothing is gathered in a row: counts only, for secrets that
    occur without bound.
    """
    spots = hits.groupBy(scalars.fingerprint(F.col("secret")).alias("fingerprint"), "location").agg(F.min(F.struct("ord", "rule_id", "severity_rank", "secret")).alias("rule"))
    order = F.struct(F.coalesce(F.nullif(F.col("location.timestamp"), F.lit("")), F.lit("~")).alias("t"), F.col("location.file").alias("f"), F.col("location.line").alias("l"), F.col("location"))
    named = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(f"location.{c}"), F.lit(""))))
    listed = [F.transform(F.array_sort(F.collect_list(order)), lambda x: x["location"]).alias("locations")] if locations else []
    grouped = spots.groupBy("fingerprint").agg(
        F.min("rule").alias("rule"),
        F.count("*").alias("occurrences"),
        *listed,
        named("agent").alias("agents"),
        named("origin").alias("origins"),
        F.count_distinct(F.nullif(F.col("location.session"), F.lit(""))).alias("sessions"),
        F.min(F.nullif(F.col("location.timestamp"), F.lit(""))).alias("first_seen"),
        F.max(F.nullif(F.col("location.timestamp"), F.lit(""))).alias("last_seen"),
    )
    own = [r for r in rules or () if r not in RULES]
    named_rules = rules_table(hits.sparkSession, [*RULES, env_rule(), *own]).select("rule_id", "rule_name", "provider", "rotate_url")
    found = grouped.select("rule.rule_id", "rule.severity_rank", "rule.secret", "fingerprint", "agents", "origins", "sessions", "occurrences", "first_seen", "last_seen", *(["locations"] if locations else []))
    return found.join(F.broadcast(named_rules), "rule_id", "left").withColumn("severity", scalars.severity_label(F.col("severity_rank"))).withColumn("masked", scalars.mask(F.col("secret")))


def without_ignored(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    return findings.join(ignored.select("fingerprint").distinct(), "fingerprint", "left_anti")


def ignored_count(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    return findings.join(ignored.select("fingerprint").distinct(), "fingerprint", "left_semi").agg(F.count_distinct("fingerprint").alias("ignored"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Applied after merging, as a finding's severity is that of its first rule."""
    return findings.where(F.col("severity_rank") >= SEVERITIES[severity])


def ordered(findings: DataFrame) -> DataFrame:
    """Worst first, then in most sessions, in most places, by rule and fingerprint."""
    return findings.orderBy(F.desc("severity_rank"), F.desc("sessions"), F.desc("occurrences"), "rule_id", "fingerprint")


def by_severity(findings: DataFrame) -> DataFrame:
    """Count for each severity, zeros included."""
    all_ranks = findings.sparkSession.createDataFrame([(v, k) for k, v in SEVERITIES.items()], "severity_rank int, severity string")
    counts = findings.groupBy("severity_rank").agg(F.count("*").alias("n"))
    return F.broadcast(all_ranks).join(counts, "severity_rank", "left").select("severity_rank", "severity", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def by_origin(findings: DataFrame) -> DataFrame:
    """In how many findings each origin is, and that as a share of the largest."""
    dim = findings.sparkSession.createDataFrame([(i, o, d) for i, (o, d) in enumerate(ORIGINS)], "rank int, origin string, description string")
    counts = findings.select(F.explode("origins").alias("origin")).groupBy("origin").agg(F.count("*").alias("findings"))
    most = counts.agg(F.max("findings").alias("most"))
    return counts.join(F.broadcast(dim), "origin", "left").join(F.broadcast(most)).select("origin", "rank", "description", "findings", (F.col("findings") / F.col("most")).alias("share"))


def timeline(findings: DataFrame) -> DataFrame:
    """Findings by day first seen, with the size of a dot for each; timestamps that aren't dates are left out."""
    day = F.to_date(F.try_to_timestamp("first_seen"))
    return findings.withColumn("day", day).where("day is not null").groupBy("day").agg(F.count("*").alias("findings"), F.sum("occurrences").alias("occurrences")).withColumn("radius", 5 + F.least(F.lit(9.0), 2 * F.sqrt("occurrences")))


def scrub_plan(findings: DataFrame) -> DataFrame:
    """For each file the fingerprints to remove from it."""
    return findings.select("fingerprint", F.explode("locations").alias("l")).groupBy(F.col("l.file").alias("file")).agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))


def summary(findings: DataFrame, files: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row: findings by severity, the worst, and files and bytes read."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    out = findings.agg(F.count("*").alias("findings"), *counts, scalars.severity_label(F.max("severity_rank")).alias("worst"))
    if files is not None:
        out = out.join(F.broadcast(files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))))
    if errors is not None:
        out = out.join(F.broadcast(errors.agg(F.count("*").alias("errors"))))
    return out


def public(findings: DataFrame) -> DataFrame:
    """Without the secret itself."""
    return findings.drop("secret")
