"""Secrets taken out of logs: as redacted copies in a table, or in the files themselves.

Copies come from the documents of a scan, joined with its hits by file, part and record. Files are rewritten
one by one where they are, by the worker that has the file at hand (a folder that executors share, or local mode),
with the bytes that hold no secret left as they are.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.functions import scalars
from keysieve.functions.plain import fingerprint
from keysieve.operators import redact
from keysieve.operators.context import places
from keysieve.operators.origins import text_origin
from keysieve.plans.rules import Rule
from keysieve.plans.scan import ScanResult
from keysieve.sources.files import NOT_SCRUBBABLE

#: Files changed this many seconds ago or less are in use.
ACTIVE_SECONDS = 60
KEY = ["file", "part", "unit_no"]
STATUS = "agent string, file string, status string, replacements int, signed int"


def wanted_hits(result: ScanResult, only: DataFrame | None) -> DataFrame:
    """Hits to be replaced: with only (fingerprint) those; in settings only what is in an old prompt history."""
    hits = result.hits
    if only is not None:
        hits = hits.join(only.select("fingerprint").distinct(), scalars.fingerprint(F.col("secret")) == F.col("fingerprint"), "left_semi")
    return hits.where(~F.col("location.agent").isin(*NOT_SCRUBBABLE) | (F.col("location.origin") == "history"))


def scrub(result: ScanResult, only: DataFrame | None = None, include_active: bool = False) -> tuple[DataFrame, DataFrame]:
    """(agent, file, kind, part, unit_no, text, replacements) with secrets replaced where a record stays valid, and for each file with a hit agent, file, status, replacements and signed.

    Databases are refused, settings and files in use left alone (their texts are given unchanged). Signed model thinking
    stays and is counted. Files are not changed: see `scrub_in_place`.
    """
    hits = wanted_hits(result, only)
    signed = redact.in_signed_block(F.col("location.json_path")) | F.exists("unsure", redact.in_signed_block)
    files = result.files.select("file", "is_db", "modified")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modified")
    idle = files.where(~F.col("is_db") & (F.lit(include_active) | (age >= ACTIVE_SECONDS))).select("file")
    open_hits = hits.where(~signed).join(F.broadcast(idle) if include_active else idle, "file", "left_semi")
    out = redact.redact(result.documents.withColumn("old", F.col("text")), open_hits.select(*KEY, "rule_id", "secret", "start", "end"), KEY)
    # Decided on the new text, once, before the old one may take its place.
    out = out.withColumn("fine", (F.col("kind") == "text") | (F.col("replacements") == 0) | redact.still_valid(F.col("old"), F.col("text")))
    out = out.select("agent", "file", "kind", "part", "unit_no", F.when(F.col("fine"), F.col("text")).otherwise(F.col("old")).alias("text"), F.when(F.col("fine"), F.col("replacements")).otherwise(0).alias("replacements"), "fine")
    done = out.groupBy("file").agg(F.sum("replacements").cast("int").alias("replacements"), F.count_if(~F.col("fine")).alias("broken"))
    found = result.hits.groupBy("file").agg(F.first("location.agent").alias("agent")).join(hits.where(signed).groupBy("file").agg(F.count("*").cast("int").alias("signed")), "file", "left")
    rows = found.join(files, "file").join(done, "file", "left").select("agent", "file", "is_db", (~F.col("agent").isin(*NOT_SCRUBBABLE) | (F.coalesce("replacements", F.lit(0)) > 0)).alias("scrubbable"), "modified", F.current_timestamp().alias("now"), F.lit(False).alias("changed"), F.coalesce("replacements", F.lit(0)).alias("replacements"), F.coalesce("signed", F.lit(0)).alias("signed"), F.coalesce("broken", F.lit(0)).alias("broken"))
    status = redact.scrub_status(rows, -(1 << 40) if include_active else ACTIVE_SECONDS)
    said = F.when((F.col("status") == "not found again") & (F.col("signed") > 0), "signed").when((F.col("status") == "not found again") & (F.col("broken") > 0), "failed: no longer valid JSON").otherwise(F.col("status"))
    return out.drop("fine"), status.select("agent", "file", said.alias("status"), "replacements", "signed")


# ---- files ----------------------------------------------------------------------------------------


def read_exact(path: str) -> str:
    """A file's text; bytes that are no UTF-8 come back as they were when it is written."""
    with open(path, "rb") as file:
        return file.read().decode("utf-8", "surrogateescape")


def rewrite(path: str, text: str, in_place: bool = False) -> None:
    """Puts text in a file's place at once, mode and times kept; in_place writes into the same file, for one that a program holds open."""
    path = os.path.realpath(path)
    before, data = os.stat(path), text.encode("utf-8", "surrogateescape")
    if in_place:
        with open(path, "r+b") as file:
            file.write(data)
            file.truncate()
        os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))
        return
    handle, other = tempfile.mkstemp(prefix=".keysieve-", dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        shutil.copymode(path, other)
        os.utime(other, ns=(before.st_atime_ns, before.st_mtime_ns))
        os.replace(other, path)
    except BaseException:
        if os.path.exists(other):
            os.unlink(other)
        raise


def kind_of(path: str) -> str:
    low = path.lower()
    return "jsonl" if low.endswith(".jsonl") or ".jsonl.superseded-" in low else "json" if low.endswith(".json") else "text"


def is_signed(json_path: str) -> bool:
    return json_path.endswith((".thinking", ".redacted_thinking")) or ".thinking[" in json_path


def decoded(secret: str) -> str:
    """A part of a JSON string as what it says."""
    try:
        return json.loads(f'"{secret}"')
    except ValueError:
        return secret


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


@dataclass
class Outcome:
    text: str
    replacements: int = 0
    signed: int = 0
    broken: int = 0


def redacted(text: str, find: Callable, chosen: Callable[[str], bool], kind: str, agent: str = "", file: str = "") -> Outcome:
    """One record (or a whole text) without its chosen secrets; what a scan leaves out stays, and a record that would break stays whole."""
    out, last, count, signed = "", 0, 0, 0
    for m in find(text):
        secret = m.secret if kind == "text" else decoded(m.secret)
        print_ = fingerprint(secret)
        if not chosen(print_):
            continue
        if kind == "text":
            origin = text_origin(agent, file, text, m.start)
        else:
            at = places(text, secret, text[: m.start].count(secret), agent)
            if at is None:
                continue
            path, origin, _, unsure = at
            if any(map(is_signed, (path, *unsure))):
                signed += 1
                continue
        if agent in NOT_SCRUBBABLE and origin != "history":
            continue
        out += text[last : m.start] + f"[REDACTED:{m.rule.rule_id}:{print_}]"
        last, count = m.end, count + 1
    out += text[last:]
    if count and kind != "text" and is_json(text) and not is_json(out):
        return Outcome(text, 0, signed, 1)
    return Outcome(out, count, signed)


def scrub_file(path: str, fingerprints: Iterable[str] | None = None, ignored: Iterable[str] = (), rules: tuple[Rule, ...] | None = None, values: tuple[tuple[str, str], ...] = (), agent: str = "", in_place: bool = False, dry_run: bool = False, active_seconds: float = 0) -> tuple[str, int, int]:
    """(status, replacements, signed) of one file of the machine this runs on, rewritten unless dry_run. Without fingerprints every secret goes but those ignored."""
    from keysieve.operators.kernel import detector

    wanted, skipped = None if fingerprints is None else {*fingerprints}, {*ignored}
    if path.lower().endswith((".db", ".sqlite", ".sqlite3", ".vscdb")):
        return "failed: database", 0, 0
    try:
        before = os.stat(path)
        if active_seconds and time.time() - before.st_mtime < active_seconds:
            return "active", 0, 0
        text, kind = read_exact(path), kind_of(path)
        records = text.split("\n") if kind == "jsonl" else [text]
        done = [redacted(r, detector(rules, values).find, lambda p: p not in skipped and (wanted is None or p in wanted), "json" if kind == "jsonl" else kind, agent, path) for r in records]
        count, signed, broken = (sum(getattr(d, name) for d in done) for name in ("replacements", "signed", "broken"))
        if not count:
            return "settings" if agent in NOT_SCRUBBABLE else "signed" if signed else "failed: no longer valid JSON" if broken else "not found again", 0, signed
        now = os.stat(path)
        if (now.st_size, now.st_mtime_ns) != (before.st_size, before.st_mtime_ns):
            return "failed: changed since the scan", 0, signed
        if not dry_run:
            rewrite(path, "\n".join(d.text for d in done), in_place)
        return "redacted", count, signed
    except OSError as error:
        return f"failed: {error.strerror or error}", 0, 0


def scrub_in_place(result: ScanResult, only: DataFrame | None = None, rules: list[Rule] | None = None, values: dict[str, str] | None = None, include_active: bool = False, dry_run: bool = False) -> DataFrame:
    """agent, file, status, replacements, signed for each file with a hit; files are rewritten as the rows are computed (so write or cache them once).

    Each file is one row of one task: workers must see the files where the driver's paths say.
    """
    prints = scalars.fingerprint(F.col("secret"))
    plan = result.hits.select("file", F.col("location.agent").alias("agent"), prints.alias("fingerprint"))
    if only is not None:
        plan = plan.join(only.select("fingerprint").distinct(), "fingerprint", "left_semi")
    plan = plan.groupBy("agent", "file").agg(F.collect_set("fingerprint").alias("fingerprints"))
    chosen, known = None if rules is None else tuple(rules), tuple(sorted((values or {}).items()))
    active = 0 if include_active else ACTIVE_SECONDS

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            agents, files, prints = (batch.column(i).to_pylist() for i in range(3))
            rows = [scrub_file(f, p, (), chosen, known, a, False, dry_run, active) for a, f, p in zip(agents, files, prints)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["agent", "file", "status", "replacements", "signed"])

    return plan.mapInArrow(run, STATUS)


def on_session_end(payload: dict, ignored: Iterable[str] = ()) -> tuple[str, int, int]:
    """What a hook does when a session ends: its transcript loses its secrets, those of the project's .env files too. Other payloads do nothing."""
    from keysieve.operators.environment import local_values

    path, folder = payload.get("transcript_path"), payload.get("cwd")
    if not isinstance(path, str) or not path.endswith((".jsonl", ".json")) or not os.path.isfile(path):
        return "nothing to do", 0, 0
    values = local_values(folder) if isinstance(folder, str) and os.path.isdir(folder) else {}
    return scrub_file(path, None, ignored, None, tuple(sorted(values.items())), in_place=False)
