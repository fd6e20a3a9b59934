"""What a scan and the machine say together: logs, leaks, settings, hooks, .env values, who may read, how long it is kept, the repository.

Each check is a row: check, state (ok, info or todo), text and what to do.
"""

from __future__ import annotations

import stat
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.operators import hooks
from keysieve.operators.environment import local_values
from keysieve.plans.scan import ScanResult, scan_repo
from keysieve.plans.rules import SEVERITIES
from keysieve.functions import scalars

SCHEMA = "check string, state string, text string, advice string"
#: Fixed value: days that Claude keeps transcripts if its settings don't say.
KEPT_DAYS = 30


def of_scan(result: ScanResult) -> DataFrame:
    """The checks that follow from findings and files, each one aggregation."""
    f, files = result.findings, result.files
    settings_only = F.col("origins") == F.array(F.lit("config"))
    number = F.col("n").cast("string")

    def row(name: str, counted: DataFrame, bad: str, todo, fine: str, advice: str) -> DataFrame:
        some = F.col("n") > 0
        return counted.select(F.lit(name).alias("check"), F.when(some, bad).otherwise("ok" if bad == "todo" else "info").alias("state"), F.when(some, todo).otherwise(fine).alias("text"), F.when(some, advice).otherwise("").alias("advice"))

    logs = files.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("agent")), ", ").alias("agents"))
    leaks = f.where(~settings_only).agg(F.count("*").alias("n"), F.max("severity_rank").alias("rank"), F.count_if(F.col("severity_rank") >= SEVERITIES["high"]).alias("bad"))
    kept = f.where(F.array_contains("origins", "config")).agg(F.count("*").alias("n"))
    prompts = f.where(F.array_contains("origins", "prompt")).agg(F.count("*").alias("n"))
    spread = f.where("sessions > 1").agg(F.count("*").alias("n"))
    checks = [
        row("logs", logs, "ok", F.concat(number, F.lit(" files from "), "agents"), "no agent logs here", ""),
        row("leaks", leaks, "todo", F.concat(number, F.lit(" secrets in the logs, "), F.col("bad").cast("string"), F.lit(" of them high or critical, the worst "), scalars.severity_label(F.col("rank"))), "no secrets in the logs", "rotate them, then: scrub"),
        row("settings", kept, "todo", F.concat(number, F.lit(" keys in plain text in agents' settings")), "no keys in agents' settings", "move them into environment variables"),
        row("prompts", prompts, "todo", F.concat(number, F.lit(" secrets were pasted into prompts")), "no secrets in prompts", "guard install"),
        row("spread", spread, "todo", F.concat(number, F.lit(" secrets are in more than one session")), "no secret is in more than one session", "scrub"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def of_hooks(home: str) -> tuple[str, str, str, str]:
    agents, off, broken = hooks.present(home), [], []
    for agent in agents:
        try:
            if not all(hooks.status(hooks.settings_path(agent, home), agent).values()):
                off.append(agent)
        except ValueError:
            broken.append(agent)
    if broken:
        return "guard", "todo", f"settings of {', '.join(broken)} can't be read", "guard status"
    if off:
        return "guard", "todo", f"hooks are off for {', '.join(off)}", "guard install"
    return ("guard", "ok", f"hooks are on for {', '.join(agents)}", "") if agents else ("guard", "info", "no agent with hooks is installed", "")


def of_environment(folders: list[str]) -> tuple[str, str, str, str]:
    n = len({v for f in folders if Path(f).is_dir() for v in local_values(f)})
    return ("env", "ok", f"{n} values of .env files can be looked for", "") if n else ("env", "info", "no secret values in .env files", "")


def open_to_all(path: Path, home: Path, mode=None) -> bool:
    """Whether every user may read a file: its own read bit and the search bit of every folder up to the home folder, that one included."""
    mode = mode or (lambda p: p.stat().st_mode)
    folders = [p for p in path.parents if p == home or home in p.parents]
    try:
        return bool(mode(path) & stat.S_IROTH) and all(mode(p) & stat.S_IXOTH for p in folders)
    except OSError:
        return False


def of_permissions(files: DataFrame, home: str) -> tuple[str, str, str, str]:
    """Over the files of a scan, by their modes on this machine."""
    root, mode = Path(home), lru_cache(None)(lambda p: p.stat().st_mode)
    exposed = [p for r in files.where("agent <> 'config'").select("file").toLocalIterator() if open_to_all(p := Path(r["file"]), root, mode)]
    if not exposed:
        return "perms", "ok", "only you can read the logs", ""
    folders = sorted({str(Path(home, *p.relative_to(root).parts[:1])) if root in p.parents else str(p.parent) for p in exposed})
    return "perms", "todo", f"{len(exposed)} log files can be read by other users", "chmod -R go-rwx " + " ".join(f'"{f}"' if " " in f else f for f in folders)


def of_retention(home: str) -> tuple[str, str, str, str] | None:
    if not Path(home, ".claude").is_dir():
        return None
    try:
        days = hooks.load(hooks.settings_path("claude", home)).get("cleanupPeriodDays")
    except ValueError:
        days = None
    known = isinstance(days, int) and not isinstance(days, bool) and days >= 0
    kept = days if known else KEPT_DAYS
    text = f"Claude keeps transcripts for {kept} days" + ("" if known else ", as its settings don't say")
    return "retention", "ok" if known and kept <= KEPT_DAYS else "info", text, "" if known and kept <= KEPT_DAYS else "set cleanupPeriodDays to keep them for less"


def of_repository(spark: SparkSession, folder: str) -> tuple[str, str, str, str] | None:
    if not Path(folder, ".git").exists():
        return None
    try:
        result, transcripts = scan_repo(spark, folder)
    except ValueError:
        return None
    secrets, committed = result.findings.count(), transcripts.count()
    if secrets:
        return "repo", "todo", f"{secrets} secrets are committed in this repository", "repo"
    if committed:
        return "repo", "todo", f"{committed} transcripts are committed in this repository", "take them out of git and ignore them"
    return "repo", "ok", "no transcripts are committed in this repository", ""


def doctor(result: ScanResult, home: str | None = None, folder: str | None = None) -> DataFrame:
    """check, state, text, advice; with a home folder and a working folder of this machine what they say too."""
    out, spark = of_scan(result), result.files.sparkSession
    local = [of_hooks(home), of_environment([folder or home]), of_permissions(result.files, home), of_retention(home)] if home else []
    local += [of_repository(spark, folder)] if folder else []
    rows = [r for r in local if r]
    return out.unionByName(spark.createDataFrame(rows, SCHEMA)) if rows else out
