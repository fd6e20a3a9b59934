"""A project's own secrets: names and values in .env files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions import scalars

#: Most values that are looked for, least length and entropy of one.
MOST, LEAST_LENGTH, LEAST_ENTROPY = 2000, 10, 3.0
#: Endings of templates, and folders that are left out.
TEMPLATES, SKIPPED_FOLDERS = ("example", "sample", "template", "dist", "defaults"), ("node_modules", "venv", "dist", "build")
LINE = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(.*?)\s*$"


def value_of(raw: Column) -> Column:
    """What is in quotes, or else up to a comment."""
    quoted = F.regexp_extract(raw, r"""^(["'])(.*?)\1""", 2)
    return F.when(raw.rlike("""^["']"""), quoted).otherwise(F.trim(F.regexp_replace(raw, r"\s+#.*$", "")))


def is_env_file(name: Column) -> Column:
    return (name.rlike(r"^\.env(\..+)?$") | name.endswith(".env")) & ~name.rlike(rf"\.({'|'.join(TEMPLATES)})$")


def parse(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to (file, line_no, name, value) of names that mean a secret, with values that can be one.

    Comments, short values, placeholders, key blocks and URLs without a password are left out.
    """
    found = lines.where(~F.col("line").rlike(r"^\s*#") & F.col("line").rlike(LINE)).select("file", "line_no", F.regexp_extract("line", LINE, 1).alias("name"), value_of(F.regexp_extract("line", LINE, 2)).alias("value"))
    v = F.col("value")
    fine = (F.length(v) >= LEAST_LENGTH) & ~scalars.is_placeholder(v) & (scalars.entropy(v) >= LEAST_ENTROPY) & ~v.startswith("-----") & ~(v.rlike("^[a-z][a-z0-9+.-]*://") & ~v.contains("@"))
    return found.where(scalars.is_secret_name(F.col("name")) & fine)


def values(parsed: DataFrame) -> DataFrame:
    """value and label: of a name given twice in a file the last value counts, of a value given twice the first name; at most 2000."""
    last = parsed.groupBy("file", "name").agg(F.max_by("value", "line_no").alias("value"), F.max("line_no").alias("line_no"))
    return last.groupBy("value").agg(F.min(F.struct("file", "line_no", "name")).alias("first")).select("value", F.col("first.name").alias("label"), "first.file", "first.line_no").orderBy("file", "line_no").limit(MOST).select("value", "label")


def known_value_hits(runs: DataFrame, known: DataFrame) -> DataFrame:
    """runs (.., run) that are known values: an equi-join, for values made of token characters."""
    return runs.join(known, runs["run"] == known["value"]).drop("value")


def local_values(folder: str) -> dict[str, str]:
    """value and label of the .env files in a folder of this machine and one level below, by the same rules: for hooks, which start no session."""
    from pathlib import Path

    from keysieve.operators.kernel import entropy, is_placeholder

    found: dict[str, str] = {}
    for path in sorted([*Path(folder).glob("*"), *Path(folder).glob("*/*")]):
        if not re.fullmatch(r"\.env(\..+)?|.*\.env", path.name) or path.suffix[1:] in TEMPLATES or path.parent.name in SKIPPED_FOLDERS or not path.is_file():
            continue
        last = {}
        for line in path.read_text("utf-8", "replace").split("\n"):
            if (m := re.match(LINE, line)) and not line.lstrip().startswith("#"):
                quoted = re.match(r"""(["'])(.*?)\1""", m[2])
                last[m[1]] = quoted[2] if quoted else re.sub(r"\s+#.*$", "", m[2]).strip()
        for name, value in last.items():
            words = {*re.split(r"[_.\-]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).upper())}
            secret = words & {*scalars.SECRET_WORDS} and not words & {*scalars.PUBLIC_WORDS} or name.upper() in scalars.URL_NAMES
            plain_url = re.match("[a-z][a-z0-9+.-]*://", value) and "@" not in value
            if secret and len(value) >= LEAST_LENGTH and entropy(value) >= LEAST_ENTROPY and not is_placeholder(value) and not value.startswith("-----") and not plain_url:
                found.setdefault(value, name)
    return dict([*found.items()][:MOST])
