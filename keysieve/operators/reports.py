"""Reports over findings: JSON, SARIF, Markdown, text and HTML. None holds a full secret."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.functions import scalars
from keysieve.functions.plain import fingerprint
from keysieve.operators import findings as F_
from keysieve.operators.redact import HIDE_FROM
from keysieve.plans.rules import RULES

#: Level and score of a severity in SARIF.
LEVELS = {"critical": ("error", "9.5"), "high": ("error", "8.0"), "medium": ("warning", "5.5"), "low": ("note", "3.0")}


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding. A secret that stands in what describes one (a folder's or session's name) is replaced too.

    For that the different secrets (a finding each, however many hits it has) go to the driver and the workers.
    """
    secrets = [r["secret"] for r in findings.select("secret").distinct().toLocalIterator()]
    shared = findings.sparkSession.sparkContext.broadcast(Hidden(secrets))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([*map(shared.value.text, batch.column(1).to_pylist())], pa.string())], names=["fingerprint", "finding"])

    rows = F_.public(findings).select("fingerprint", F.to_json(F.struct("rule_id", "rule_name", "provider", "severity", "masked", "fingerprint", "rotate_url", "agents", "origins", "sessions", "occurrences", "first_seen", "last_seen", "locations")).alias("finding"))
    return rows.mapInArrow(run, "fingerprint string, finding string")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row for each location: a rule's identifier has the severity behind it where that differs from the rule's own."""
    own = F.create_map(*(F.lit(x) for r in RULES for x in (r.rule_id, r.severity)))
    rule = F.when(own[F.col("rule_id")] == F.col("severity"), F.col("rule_id")).otherwise(F.concat("rule_id", F.lit("/"), "severity"))
    level = F.create_map(*(F.lit(x) for s, (name, _) in LEVELS.items() for x in (s, name)))
    rows = findings.select(rule.alias("rule_id"), level[F.col("severity")].alias("level"), "rule_name", "masked", "fingerprint", "severity", F.explode("locations").alias("l"))
    return rows.select("rule_id", "level", "rule_name", "masked", "severity", F.col("l.file").alias("uri"), F.greatest("l.line", F.lit(1)).alias("line"), F.concat("fingerprint", F.lit(":"), "l.file").alias("partial_fingerprint"))


class Hidden:
    """Texts without any of some full secrets, as they are or as JSON writes them; the longest that starts at a place is replaced."""

    def __init__(self, secrets: list[str]):
        self.forms: dict[str, list[tuple[str, str]]] = {}
        for form, secret in {f: s for s in secrets if len(s) >= HIDE_FROM for f in (s, json.dumps(s)[1:-1], json.dumps(s, ensure_ascii=False)[1:-1])}.items():
            self.forms.setdefault(form[:HIDE_FROM], []).append((form, f"[REDACTED:{fingerprint(secret)}]"))
        for forms in self.forms.values():
            forms.sort(key=lambda f: -len(f[0]))

    def text(self, text: str) -> str:
        out, last, at = [], 0, 0
        while at + HIDE_FROM <= len(text):
            found = next((f for f in self.forms.get(text[at : at + HIDE_FROM], ()) if text.startswith(f[0], at)), None)
            if found:
                out += [text[last:at], found[1]]
                at = last = at + len(found[0])
            else:
                at += 1
        return "".join([*out, text[last:]])

    def value(self, value):
        """A value of lists and dictionaries with every text in it."""
        if isinstance(value, str):
            return self.text(value)
        if isinstance(value, dict):
            return {k: self.value(x) for k, x in value.items()}
        return [*map(self.value, value)] if isinstance(value, list) else value


def collected(findings: DataFrame, most: int | None = None) -> list[dict]:
    """Findings in order on the driver, for a report, none with a secret in any field. With `most` only the first; the whole is in `json_rows` and `sarif_results`."""
    rows = F_.ordered(findings)
    rows = [r.asDict(recursive=True) for r in (rows.limit(most) if most else rows).toLocalIterator()]
    secrets = [r.pop("secret") for r in rows]
    return Hidden(secrets).value(rows)


def counts(rows: list[dict]) -> dict[str, int]:
    return {s: sum(r["severity"] == s for r in rows) for s in LEVELS}


def as_json(rows: list[dict], about: dict | None = None) -> str:
    """about: files, bytes, ignored and errors of the run, if they are known."""
    return json.dumps({"summary": {"findings": len(rows), **counts(rows), **(about or {})}, "findings": rows}, ensure_ascii=False, indent=2)


def as_sarif(rows: list[dict], about: dict | None = None, transcripts: list[tuple[str, str]] = ()) -> str:
    """about: errors of the run become notifications. transcripts: (path, agent) that are committed and count as results."""
    own = {r.rule_id: r.severity for r in RULES}
    rules, results = {}, []
    for r in rows:
        rule = r["rule_id"] if own.get(r["rule_id"], r["severity"]) == r["severity"] else f"{r['rule_id']}/{r['severity']}"
        level, score = LEVELS[r["severity"]]
        rules[rule] = {"id": rule, "name": r["rule_name"], "defaultConfiguration": {"level": level}, "properties": {"security-severity": score}}
        for at in r["locations"]:
            place = {"artifactLocation": {"uri": at["file"]}, "region": {"startLine": max(at["line"], 1)}}
            results.append({"ruleId": rule, "level": level, "message": {"text": f"{r['rule_name']} {r['masked']}"}, "locations": [{"physicalLocation": place}], "partialFingerprints": {"secret/v1": f"{r['fingerprint']}:{at['file']}"}})
    for path, agent in transcripts:
        rules["committed-transcript"] = {"id": "committed-transcript", "name": "Transcript of an agent in a repository", "defaultConfiguration": {"level": "error"}, "properties": {"security-severity": "5.0"}}
        results.append({"ruleId": "committed-transcript", "level": "error", "message": {"text": f"A transcript of {agent} is committed: take it out of git and ignore it."}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": path}}}], "partialFingerprints": {"transcript/v1": path}})
    run = {"tool": {"driver": {"name": "keysieve", "rules": [*rules.values()]}}, "results": results}
    if errors := (about or {}).get("errors"):
        run["invocations"] = [{"executionSuccessful": True, "toolExecutionNotifications": [{"level": "warning", "message": {"text": e}} for e in errors]}]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, ensure_ascii=False, indent=2)


def as_markdown(rows: list[dict]) -> str:
    cell = lambda s: str(s).replace("|", "\\|").replace("\n", " ")
    lines = ["| Severity | Kind | Secret | Fingerprint | Agents | Places | First seen |", "|---|---|---|---|---|---|---|"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, (r["severity"], r["rule_name"], r["masked"], r["fingerprint"], ", ".join(r["agents"]), r["occurrences"], (r["first_seen"] or "")[:10]))) + " |" for r in rows)]) + "\n"


def as_text(rows: list[dict], verbose: bool = False) -> str:
    if not rows:
        return "No secrets found.\n"
    out = [f"{len(rows)} secrets: " + ", ".join(f"{n} {s}" for s, n in counts(rows).items() if n)]
    for r in rows:
        out += ["", f"{r['severity'].upper()}  {r['rule_name']}  {r['masked']}  [{r['fingerprint']}]"]
        out += [f"  {at['agent']}  {at['file']}:{at['line']}  {at['json_path']}  {at['origin']}" for at in r["locations"][: None if verbose else 1]]
        if r["rotate_url"]:
            out.append(f"  revoke: {r['rotate_url']}")
    return "\n".join(out) + "\n"


def as_html(rows: list[dict]) -> str:
    """A page with its data as JSON, in which < > & are escaped: severities to choose from, a bar for each origin, a dot for each day, and a search box."""
    data = json.dumps(rows, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    chips = " ".join(f"<button class=chip data-severity={s}>{n} {s}</button>" for s, n in counts(rows).items())
    by_origin = {o: sum(o in r["origins"] for r in rows) for o, _ in F_.ORIGINS}
    most = max([*by_origin.values(), 1])
    bars = "".join(f"<tr><td>{text}<td><meter max={most} value={by_origin[o]}></meter> {by_origin[o]}" for o, text in F_.ORIGINS if by_origin[o])
    days: dict[str, list[int]] = {}
    for r in rows:
        if re.match(r"\d{4}-\d\d-\d\d", r["first_seen"] or ""):
            day = days.setdefault(r["first_seen"][:10], [0, 0])
            day[0], day[1] = day[0] + 1, day[1] + r["occurrences"]
    dots = "".join(f"<circle cx={20 + 30 * i} cy=20 r={5 + min(9.0, 2 * n**0.5):.1f}><title>{d}: {k} secrets, {n} places</title></circle>" for i, (d, (k, n)) in enumerate(sorted(days.items())))
    timeline = f"<svg height=40 width={40 + 30 * len(days)}>{dots}</svg>" if days else ""
    body = "".join(f"<tr data-severity={r['severity']}><td>{r['severity']}<td>{html.escape(r['rule_name'] or '')}<td>{html.escape(r['masked'])}<td>{r['fingerprint']}<td>{html.escape(', '.join(r['origins']))}<td>{r['occurrences']}<td>{html.escape((r['first_seen'] or '')[:10])}" for r in rows)
    script = "let s='';const f=()=>document.querySelectorAll('#rows tr').forEach(r=>r.hidden=(s&&r.dataset.severity!=s)||!r.textContent.toLowerCase().includes(q.value.toLowerCase()));q.oninput=f;document.querySelectorAll('.chip').forEach(c=>c.onclick=()=>{s=s==c.dataset.severity?'':c.dataset.severity;f()})"
    return f"<!doctype html><meta charset=utf-8><title>Secrets</title><h1>{len(rows)} secrets</h1><p>{chips}<table>{bars}</table>{timeline}<p><input id=q placeholder=Search><table><thead><tr><th>Severity<th>Kind<th>Secret<th>Fingerprint<th>Origins<th>Places<th>First seen<tbody id=rows>{body}</table><script type=application/json id=data>{data}</script><script>{script}</script>\n"


RENDER = {"text": as_text, "json": as_json, "markdown": as_markdown, "sarif": as_sarif, "html": as_html}


def render(findings: DataFrame, kind: str = "text") -> str:
    if kind not in RENDER:
        raise ValueError(f"unknown format {kind}: {', '.join(RENDER)}")
    return RENDER[kind](collected(findings))


def about(result) -> dict:
    """Files, bytes, ignored and errors of a scan, for a report's summary."""
    files = result.files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return {"files": files["n"], "bytes": files["b"], "ignored": result.ignored, "errors": [f"{r['file']}: {r['message']}" for r in result.errors.collect()]}


def github_annotations(rows: list[dict], transcripts: list[tuple[str, str]] = ()) -> list[str]:
    found = [f"::{'error' if r['severity_rank'] >= 3 else 'warning'} file={at['file']},line={max(at['line'], 1)}::{r['rule_name']} {r['masked']}" for r in rows for at in r["locations"]]
    return found + [f"::warning file={path}::a transcript of {agent} is committed" for path, agent in transcripts]


def repo_markdown(rows: list[dict], transcripts: list[tuple[str, str]]) -> str:
    """What a repository holds, for a job's summary."""
    if not rows and not transcripts:
        return "## keysieve\n\nNo transcripts and no secrets are committed.\n"
    listed = [f"- `{path}` ({agent})" for path, agent in transcripts[:50]]
    return "\n".join(["## keysieve", "", f"{len(transcripts)} transcripts and {len(rows)} secrets are committed. History keeps what is deleted: rotate the keys.", "", *listed, "", as_markdown(rows) if rows else ""])


def fingerprint_of(column: str):
    return scalars.fingerprint(F.col(column))
