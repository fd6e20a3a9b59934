"""Detection over DataFrames.

`matches` gives exact spans: a JVM-side test leaves only rows that can hold a credential, and those alone
reach Python, in Arrow batches. `token_runs` and `token_run_hits` stay in expressions throughout: one
regular expression divides texts into runs, and runs meet the broadcast rules by an equi-join on how they begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.functions import scalars
from keysieve.plans.rules import RULES, Rule, rules_table

#: Every credential has sixteen such characters in a row, is a URL with a password or a key block.
LONG = r"[A-Za-z0-9_+/=.!@#$%^&*~:\-]{16}"
FOUND = "ord double, rule_id string, severity_rank int, secret string, start int, end int"


def may_hold_secret(text: Column) -> Column:
    return text.rlike(LONG) | text.contains("PRIVATE KEY") | text.contains("://")


def has_keyword(text: Column, rules: list[Rule] | None = None) -> Column:
    """Whether any keyword of the rules occurs; pushed down to Parquet as StringContains."""
    out = F.lit(False)
    for word in sorted({k for r in rules or RULES for k in r.keywords}):
        out = out | text.contains(word)
    return out


def matches(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """One row for each match in each row of df: df's other columns, then ord, rule_id, severity_rank, secret, start, end.

    Null and empty texts have none. start and end count code points from 0. With `values` (value to label, at most a few
    thousand) a project's own environment values are found too. Values and custom rules may be short, so with them rows
    aren't left out by the first test. Rules, checks of one's own among them, are sent to the workers as they are.
    """
    keep = [c for c in df.columns if c != text]
    chosen, known = None if rules is None else tuple(rules), tuple(sorted((values or {}).items()))
    every = bool(known) or bool({*(chosen or ())} - {*RULES})
    rows = df.where(F.col(text).isNotNull() if every else may_hold_secret(F.col(text))).select(text, *keep)
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(FOUND).fields])

    def run(batches):
        import pyarrow as pa

        from keysieve.operators.kernel import detector

        find = detector(chosen, known).find
        for batch in batches:
            index, found = [], []
            for i, value in enumerate(batch.column(0).cast(pa.binary())):
                for m in find(value.as_py().decode("utf-8", "replace")):
                    index.append(i)
                    found.append(m)
            columns = [pa.array([m.rule.order for m in found], pa.float64()), pa.array([m.rule.rule_id for m in found], pa.string()), pa.array([m.rank for m in found], pa.int32()), pa.array([m.secret for m in found], pa.string()), pa.array([m.start for m in found], pa.int32()), pa.array([m.end for m in found], pa.int32())]
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j + 1).take(take) for j in range(len(keep))), *columns], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def token_runs(df: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """df's other columns and `run` for each maximal run of token characters, of `least` or more; and what is left of a run after an escaped n, t or r."""
    keep = [c for c in df.columns if c != text]
    pattern = rf"(\\?[A-Za-z0-9_\-]{{{least},}})"
    found = df.where(F.col(text).rlike(rf"[A-Za-z0-9_\-]{{{least}}}")).select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("raw"))
    whole = F.when(F.col("raw").startswith("\\"), F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))
    rest = F.when(F.col("raw").rlike(r"^\\[ntr]"), F.substring("raw", 3, 1 << 30))
    return found.select(*keep, F.explode(F.filter(F.array(whole, rest), lambda r: F.length(r) >= least)).alias("run"))


def token_run_hits(runs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """runs that are credentials: the columns of runs, then ord, rule_id, rule_name, provider, severity_rank. The first rule of several wins; equal rows count once.

    Rules are joined on a run's first two characters, with which all their matches begin. Checksums and validators are
    expressions.
    """
    spark = runs.sparkSession
    chosen = [r for r in rules or RULES if r.is_token_run]
    pairs = [(r.order, "sk" if r.rule_id == "openai-api-key" else k[:2]) for r in chosen for k in r.keywords]
    heads = spark.createDataFrame(sorted({*pairs}), "ord double, head string")
    table = rules_table(spark, chosen).select("ord", "rule_id", "rule_name", "provider", "severity_rank", "min_entropy", "shape").join(heads, "ord")
    near = runs.withColumn("head", F.substring("run", 1, 2)).join(F.broadcast(table), "head").where(F.expr("run rlike concat('^(?:', shape, ')$')"))
    run, rule = F.col("run"), F.col("rule_id")
    fine = (F.col("min_entropy") == 0) | (scalars.entropy(run) >= F.col("min_entropy"))
    fine = fine & F.when(rule == "github-token", F.when(F.length(run) == 40, scalars.github_checksum_ok(run)).otherwise(scalars.entropy(run) >= 4.0)).when(rule == "aws-access-key-id", ~run.contains("EXAMPLE")).when(rule == "brave-search-api-key", F.substring("run", 4, 99).rlike("(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")).otherwise(F.lit(True))
    rank = F.when(rule == "stripe-secret-key", F.when(run.contains("_live_"), 4).otherwise(1)).otherwise(F.col("severity_rank"))
    own = F.struct("ord", "rule_id", "rule_name", "provider", rank.cast("int").alias("severity_rank"))
    keys = runs.columns
    return near.where(fine).groupBy(*keys).agg(F.min(own).alias("rule")).select(*keys, "rule.*")


def claim(candidates: Column) -> Column:
    """Of an array of struct(ord, seq, start, end, ...) those that overlap no earlier claimed one, by priority."""
    take = lambda acc, m: F.when(F.exists(acc, lambda t: (m["start"] < t["end"]) & (t["start"] < m["end"])), acc).otherwise(F.concat(acc, F.array(m)))
    return F.aggregate(F.sort_array(candidates), F.slice(candidates, 1, 0), take)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<value, start, end>> of a pattern's matches, with offsets by what lies between them."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(values, i))).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.get(values, i).alias("value"), (acc["at"] + F.length(F.get(gaps, i))).alias("start"), (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(values, i))).alias("end")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<value:string,start:int,end:int>>)").alias("out"))
    steps = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def span_rows(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """df's other columns, nth (from 0), start and end of each match of a plain pattern, in texts of any length: prefix sums over what lies between matches, in linear time."""
    gaps, keep = F.split(text, pattern, -1), [c for c in df.columns if c != text]
    rows = df.select(*keep, F.monotonically_increasing_id().alias("_row"), F.transform(gaps, F.length).alias("_gaps"))
    found = rows.select(*keep, "_row", F.posexplode(F.slice("_gaps", F.lit(1), F.size("_gaps") - 1)).alias("nth", "_gap"))
    start = (F.sum("_gap").over(Window.partitionBy("_row").orderBy("nth")) + len(pattern) * F.col("nth")).cast("int")
    return found.select(*keep, "nth", start.alias("start"), (start + len(pattern)).alias("end"))
