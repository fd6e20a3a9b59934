"""Redaction: secrets replaced by markers, without breaking the records they stand in."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions import scalars

#: Shortest secret that is hidden wherever it occurs.
HIDE_FROM = 12


def splice(text: Column, found: Column) -> Column:
    """text with each of found (array of struct(start, end, marker), apart from each other) replaced by its marker."""
    step = lambda acc, m: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["marker"]).alias("out"), m["end"].alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(F.array_sort(found), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(rows: DataFrame, matches: DataFrame, key: list[str], text: str = "text", targets: DataFrame | None = None) -> DataFrame:
    """rows with their matches (key, rule_id, secret, start, end) replaced in text, and replacements, their number.

    With targets (fingerprint) only those secrets are replaced. Matches are gathered by row; a row holds its own only.
    """
    found = matches.withColumn("fingerprint", scalars.fingerprint(F.col("secret")))
    if targets is not None:
        found = found.join(targets.select("fingerprint").distinct(), "fingerprint", "left_semi")
    spot = F.struct("start", "end", scalars.marker(F.col("rule_id"), F.col("secret")).alias("marker"))
    gathered = found.groupBy(*key).agg(F.collect_list(spot).alias("spots"))
    joined = rows.join(gathered, key, "left")
    return joined.withColumn(text, F.when(F.col("spots").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("spots")))).withColumn("replacements", F.greatest(F.size("spots"), F.lit(0))).drop("spots")


def hide(text: Column, secrets: list[str]) -> Column:
    """Every full secret, as it is or as JSON writes it, replaced by a marker in one pass, longest first. For reports: secrets are few."""
    forms = {f: s for s in secrets if len(s) >= HIDE_FROM for f in (s, json.dumps(s)[1:-1], json.dumps(s, ensure_ascii=False)[1:-1])}
    if not forms:
        return text
    pattern = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    back = F.create_map(*(F.lit(x) for f, s in forms.items() for x in (f, s)))
    markers = F.transform(values, lambda v: F.concat(F.lit("[REDACTED:"), scalars.fingerprint(back[v]), F.lit("]")))
    pieces = F.zip_with(gaps, markers, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.array_join(pieces, "")


def in_signed_block(json_path: Column) -> Column:
    """Model thinking is signed; a changed block would be refused, so it is left and counted."""
    return json_path.rlike(r"(\.thinking|\.redacted_thinking)$|\.thinking\[")


def still_valid(old: Column, new: Column) -> Column:
    """A record that was valid JSON must stay so."""
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return ~valid(old) | valid(new)


def scrub_status(files: DataFrame, active_seconds: int = 60) -> DataFrame:
    """files (file, is_db, scrubbable, modified, now, changed, replacements) with status: what would happen to each.

    Databases fail, settings and files in use are skipped, files changed since they were read fail.
    """
    age = F.unix_timestamp("now") - F.unix_timestamp("modified")
    status = F.when(F.col("is_db"), "failed: database").when(~F.col("scrubbable"), "settings").when(age < active_seconds, "active").when(F.col("changed"), "failed: changed since the scan").when(F.col("replacements") == 0, "not found again").otherwise("redacted")
    return files.withColumn("status", status)
