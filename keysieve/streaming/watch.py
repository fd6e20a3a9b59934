"""Watching logs as a stream: texts arrive in micro-batches, and each new secret is reported once."""

from __future__ import annotations

import glob
import json
import os
import platform
import shutil
import subprocess
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.functions import scalars
from keysieve.operators import detect
from keysieve.sources.files import AGENTS, IN_PROJECTS, NOT_WATCHED
from keysieve.streaming.tail import SEARCH_EVERY, AgentLogs, is_database


def new_secrets(texts: DataFrame, text: str = "text", baseline: DataFrame | None = None, rules=None) -> DataFrame:
    """A stream (or table) of texts to its secrets that are in no baseline (fingerprint), each once for the run.

    The state is one fingerprint for each secret reported, as long as the query runs.
    """
    found = detect.matches(texts, text, rules).withColumn("fingerprint", scalars.fingerprint(F.col("secret"))).withColumn("masked", scalars.mask(F.col("secret"))).drop("secret")
    if baseline is not None:
        found = found.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return found.dropDuplicates(["fingerprint"])


def start(spark: SparkSession, texts: DataFrame, report: Callable[[DataFrame], None], checkpoint: str, interval: str = "2 seconds", **options):
    """A running query that gives each batch of new secrets to `report`."""

    def batch(df: DataFrame, _: int) -> None:
        if df.take(1):
            report(df)

    return new_secrets(texts, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(batch).start()


def new_secrets_once(spark: SparkSession, path: str, text: str = "text", baseline: DataFrame | None = None) -> DataFrame:
    """All files there are, read as a stream to its end: fingerprint, rule_id and masked value of each secret."""
    from keysieve.sources.files import shared_dir

    root = f"{shared_dir(spark)}/keysieve-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    # A table is a folder of files or one file of a folder; the stream source takes folders.
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).limit(1).collect()
    single = not files or os.path.basename(files[0]["f"]) == name
    texts = stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)
    out = new_secrets(texts.select(text), text, baseline).select("fingerprint", "rule_id", "masked")
    out.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("fingerprint string, rule_id string, masked string").parquet(f"{root}/out")


def places(home: str, agents: list[str] | None = None, projects: list[str] | None = None, roots: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Patterns of the agents' files under a home folder, in further roots and in projects; of agents that copy their logs into databases, not these."""
    out = {}
    for agent in agents or AGENTS:
        folders, patterns = AGENTS[agent]
        under = [f"{home.rstrip('/')}/{f}".rstrip("/") for f in folders] + [*(roots or {}).get(agent, ())] + ([*(projects or ())] if agent in IN_PROJECTS else [])
        out[agent] = [f"{glob.escape(r)}/{p}" for r in under for p in patterns if not (agent in NOT_WATCHED and is_database(p))]
    return out


def agent_logs(spark: SparkSession, where: dict[str, list[str]], since: str = "latest", search_seconds: float = SEARCH_EVERY) -> DataFrame:
    """The stream of what agents write: lines appended to line files, other files and databases whenever they change."""
    spark.dataSource.register(AgentLogs)
    return spark.readStream.format("agent_logs").options(places=json.dumps(where), search_seconds=str(search_seconds), tasks=str(2 * spark.sparkContext.defaultParallelism), **{"from": since}).load()


def new_findings(logs: DataFrame, baseline: DataFrame | None = None, rules=None, ignored: DataFrame | None = None) -> DataFrame:
    """A stream of agent_logs to its new secrets with their places, each once: fingerprint, rule_id, severity_rank, masked, location."""
    from keysieve.plans.scan import locate_records

    found = locate_records(logs, rules).withColumn("fingerprint", scalars.fingerprint(F.col("secret"))).withColumn("masked", scalars.mask(F.col("secret"))).drop("secret")
    for known in (baseline, ignored):
        if known is not None:
            found = found.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return found.dropDuplicates(["fingerprint"]).select("fingerprint", "rule_id", "severity_rank", "masked", "location")


class Quiet:
    """Files that got a new secret and wait until they have been still for some seconds; then they are redacted in place."""

    def __init__(self, seconds: float, ignored: tuple[str, ...] = (), clock=time.time):
        self.seconds, self.ignored, self.clock, self.waiting = seconds, ignored, clock, {}

    def add(self, files: dict[str, str]) -> None:
        """files: path to agent."""
        now = self.clock()
        self.waiting |= {f: (a, now) for f, a in files.items()}

    def due(self) -> list[tuple[str, str, int]]:
        """(file, status, replacements) of those whose time has come."""
        from keysieve.plans.scrub import scrub_file

        out = []
        for path, (agent, hit) in [*self.waiting.items()]:
            changed = os.stat(path).st_mtime if os.path.exists(path) else 0.0
            if self.clock() - max(hit, changed) >= self.seconds:
                del self.waiting[path]
                status, count, _ = scrub_file(path, None, self.ignored, agent=agent, in_place=True)
                out.append((path, status, count))
        return out


def notify(title: str, message: str) -> bool:
    """A desktop notification, where the system has a command for one; nothing of the texts is run as code."""
    commands = {"Darwin": ["osascript", "-e", "on run argv", "-e", "display notification (item 2 of argv) with title (item 1 of argv)", "-e", "end run"], "Linux": ["notify-send", "--urgency=critical", "--"]}
    command = commands.get(platform.system())
    if not command or not shutil.which(command[0]):
        return False
    try:
        return subprocess.run([*command, title, message], capture_output=True, timeout=5).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def quiet_files(last_hits: DataFrame, now, quiet_seconds: int = 90) -> DataFrame:
    """Files (file, last_hit, modified) that have been still long enough to be redacted."""
    return last_hits.where(F.unix_timestamp(now) - F.unix_timestamp(F.greatest("last_hit", "modified")) >= quiet_seconds)
