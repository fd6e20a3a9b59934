"""Whole runs: files of agents, paths or a repository to findings and redacted copies."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions import scalars
from keysieve.operators import classify, context, detect, environment, findings
from keysieve.plans.rules import RULES, Rule
from keysieve.sources import files as sources
from keysieve.sources.sqlite import SqliteRows


@dataclass
class ScanResult:
    """findings, and what they came from; all lazy."""

    findings: DataFrame
    files: DataFrame
    documents: DataFrame
    hits: DataFrame
    errors: DataFrame
    ignored_findings: DataFrame | None = None

    @property
    def ignored(self) -> int:
        """How many findings an ignore list left out."""
        return 0 if self.ignored_findings is None else self.ignored_findings.first()["ignored"]

    def summary(self) -> DataFrame:
        return findings.summary(self.findings, self.files, self.errors)

    def per_agent(self) -> DataFrame:
        """Files and bytes of every agent, zeros included."""
        got = self.files.groupBy("agent").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
        return sources.agents_table(self.files.sparkSession).join(got, "agent", "left").select("agent", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("b", F.lit(0)).alias("bytes"))


def database_rows(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """Records of the databases among files, each with the table it is in. Their paths come to the driver: a home folder has a few."""
    found = files.where("is_db").select("agent", "file").collect()
    if not found:
        return None
    spark.dataSource.register(SqliteRows)
    agents = spark.createDataFrame([(r["file"], r["agent"]) for r in found], "file string, agent string")
    rows = spark.read.format("sqlite_rows").option("paths", json.dumps([r["file"] for r in found])).load()
    return rows.join(F.broadcast(agents), "file").select("agent", "file", F.lit("jsonl").alias("kind"), F.col("table").alias("part"), "unit_no", "text")


def locate_records(docs: DataFrame, rules: list[Rule] | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """Hits with location of records (agent, file, kind, part, unit_no, text, first_line): found in raw text, decoded, and placed in their record."""
    found = detect.matches(docs.withColumn("line", F.col("text")), "text", rules, values)
    json_kind = F.col("kind") != "text"
    found = found.withColumn("secret", F.when(json_kind, scalars.json_fragment(F.col("secret"))).otherwise(F.col("secret")))
    located = context.locate(found)
    agent, line, first, file = F.col("agent"), F.col("line"), F.coalesce("first_line", "line"), F.col("file")
    number = F.when(F.col("kind") == "jsonl", F.col("unit_no")).otherwise(scalars.line_of(line, F.col("start")))
    place = findings.location(agent=agent, file=file, line=number, json_path=F.col("json_path"), session=context.session_of(agent, line, first, file), project=context.project_of(agent, line, first, file), timestamp=F.col("timestamp"), origin=F.col("origin"))
    return located.select("ord", "rule_id", "severity_rank", "secret", "start", "end", "file", "part", "unit_no", "unsure", place.alias("location"))


def locate_hits(docs: DataFrame, rules: list[Rule] | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """Hits with location of documents (agent, file, kind, part, unit_no, text). Only records that can hold a secret are joined with their file's first."""
    chosen = docs if values or {*(rules or ())} - {*RULES} else docs.where(detect.may_hold_secret(F.col("text")))
    return locate_records(chosen.join(sources.first_lines(docs), "file", "left"), rules, values)


def scan(spark: SparkSession, home: str | None = None, agents: list[str] | None = None, paths: list[str] | None = None, rules: list[Rule] | None = None, min_severity: str = "low", ignored: DataFrame | None = None, since: str | None = None, env: list[str] | None = None, roots: dict[str, list[str]] | None = None) -> ScanResult:
    """Everything under a home folder, or some paths; env: project folders whose .env values are looked for too; roots: further folders of agents."""
    parts = [sources.read_binary(spark, p, since=since) for p in paths or ()]
    if home:
        parts.append(sources.discover(spark, home, agents, since, None, roots))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p.join(files.select("file"), "file", "left_anti").select(*p.columns))
    values = {}
    for project in env or ():
        values |= {r["value"]: r["label"] for r in environment.values(environment.parse(sources.env_files(spark, project))).collect()}
    docs = sources.documents(files)
    if (rows := database_rows(spark, files)) is not None:
        docs = docs.unionByName(rows)
    return _result(files, docs, locate_hits(docs, rules, values or None), min_severity, ignored, rules)


def _result(files: DataFrame, docs: DataFrame, hits: DataFrame, min_severity: str, ignored: DataFrame | None, rules: list[Rule] | None = None) -> ScanResult:
    found = findings.at_least(findings.merge(hits, rules), min_severity)
    left_out = None
    if ignored is not None:
        left_out, found = findings.ignored_count(found, ignored), findings.without_ignored(found, ignored)
    return ScanResult(found, files, docs, hits, sources.errors(files), left_out)


def scan_repo(spark: SparkSession, folder: str, all_files: bool = False, min_severity: str = "low", ignored: DataFrame | None = None, files: list[str] | None = None) -> tuple[ScanResult, DataFrame]:
    """Transcripts and settings that git tracks (with all_files everything; with files, relative paths, only those), and (relpath, agent) of the transcripts."""
    got = subprocess.run(["git", "-C", folder, "ls-files", "-z"], capture_output=True, timeout=120)
    if got.returncode:
        raise ValueError(got.stderr.decode(errors="replace").strip())
    tracked = [n for n in got.stdout.decode("utf-8", "replace").split("\0") if n and (files is None or n in files)]
    names = spark.createDataFrame([(n,) for n in tracked], "relpath string")
    agent = F.coalesce(classify.transcript_agent(F.col("relpath")), F.when(classify.is_settings(F.col("relpath")), "config"), F.when(F.lit(all_files), "path"))
    chosen = names.withColumn("agent", agent).where("agent is not null")
    transcripts = chosen.where(~F.col("agent").isin("config", "path"))
    paths: dict[str, list[str]] = {}
    for r in chosen.toLocalIterator():
        paths.setdefault(r["agent"], []).append(f"{folder}/{r['relpath']}")
    read = spark.createDataFrame([], sources.FILES)
    for agent_name, own in sorted(paths.items()):
        read = read.unionByName(sources.read_binary(spark, own, agent_name))
    docs = sources.documents(read)
    return _result(read, docs, locate_hits(docs), min_severity, ignored), transcripts
