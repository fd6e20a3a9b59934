"""Files as they come: broken bytes, databases, appended lines, rewriting, hooks and checks of a machine."""

import json
import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from keysieve import cli
from keysieve.functions import plain
from keysieve.operators import detect, findings, hooks, reports
from keysieve.operators.kernel import Detector
from keysieve.plans import doctor, scan, scrub
from keysieve.plans.rules import RULES, custom_rule
from keysieve.sources import files
from keysieve.streaming import tail, watch
from keysieve.streaming.tail import Tail
from maker import Maker

NPM = next(r for r in RULES if r.rule_id == "npm-token")


def token(seed):
    return Maker(seed).of(NPM)


def prompt(text):
    return json.dumps({"sessionId": "s", "type": "user", "message": {"content": text}}, ensure_ascii=False)


def test_no_bytes_end_a_scan(spark, tmp_path):
    a, b, c = token(1), token(2), token(3)
    (tmp_path / "x.jsonl").write_bytes(prompt("café").encode("latin-1") + b"\n" + prompt(f"use {a}").encode() + b"\n" + b"\xff\xfe broken " + b.encode() + b"\n")
    (tmp_path / "notes.txt").write_bytes(b"\xe9 " + c.encode())
    (tmp_path / "binary.txt").write_bytes(b"\0\1" + c.encode())
    (tmp_path / "cut.txt").write_bytes(b"x" * 16_383 + "é".encode())
    result = scan.scan(spark, paths=[str(tmp_path)])
    assert {r["secret"] for r in result.findings.collect()} == {a, b, c} and result.errors.count() == 0


def test_projects_of_a_home_folder_with_a_character_on_any_boundary(spark, tmp_path):
    session = tmp_path / ".claude/projects/p/s.jsonl"
    session.parent.mkdir(parents=True)
    work = tmp_path / "wörk"
    work.mkdir()
    (work / ".aider.chat.history.md").write_text(f"#### {token(4)}\n")
    session.write_text(json.dumps({"cwd": str(work), "x": "a" * 16_300}) + "\n" + "é" * 20_000 + "\n")
    found = files.discover(spark, str(tmp_path))
    assert {r["agent"] for r in found.collect()} == {"claude", "aider"}


def test_files_that_cannot_be_read_are_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "big.txt").write_text("x" * 5000)
    (tmp_path / "fine.txt").write_text("x " + token(5))
    monkeypatch.setattr(files, "MOST_BYTES", 4000)
    result = scan.scan(spark, paths=[str(tmp_path)])
    assert [r["message"] for r in result.errors.collect()] == ["larger than 256 MiB"] and result.findings.count() == 1
    lost = result.files.withColumn("content", F.when(F.lit(False), F.col("content")))
    assert sorted(r["message"] for r in files.errors(lost).collect()) == ["could not be read", "larger than 256 MiB"]


@pytest.fixture
def database(tmp_path):
    key = token(6)
    path = tmp_path / "a,b.db"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE a (session_id TEXT, body TEXT); CREATE TABLE b (id TEXT, body TEXT); CREATE TABLE sessions (id TEXT, directory TEXT)")
    db.execute("INSERT INTO a VALUES ('one', ?)", (f"use {key}",))
    db.execute("INSERT INTO b VALUES ('two', ?)", ("words " * 30,))
    db.execute("INSERT INTO sessions VALUES ('three', ?)", (f"/w/{key}",))
    db.commit()
    db.close()
    return path, key


def test_records_of_databases_stand_for_themselves_and_are_not_scrubbed(spark, database):
    path, key = database
    result = scan.scan(spark, paths=[str(path)])
    (found,) = result.findings.collect()
    assert sorted(at["session"] for at in found["locations"]) == ["one", "three"]
    out, status = scrub.scrub(result, include_active=True)
    assert [(r["status"], r["replacements"]) for r in status.collect()] == [("failed: database", 0)]
    assert sum(key in r["text"] for r in out.collect()) == 2
    assert [r["status"] for r in scrub.scrub_in_place(result, include_active=True).collect()] == ["failed: database"]


@pytest.fixture
def log(tmp_path):
    """A session with a plain secret, one in signed thinking, one in skipped data, one that breaks its record, and old bytes."""
    a, b = token(7), token(8)
    lines = [prompt(f"use {a}").encode(), json.dumps({"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": a}]}}).encode(), json.dumps({"type": "image", "source": {"type": "base64", "data": a}}).encode(), b'{"cut": "' + b.encode(), b"\xff\xfe raw " + b.encode()]
    path = tmp_path / "s.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\n")
    os.chmod(path, 0o640)
    os.utime(path, (time.time() - 3600,) * 2)
    return path, a, b, lines


def test_scrub_in_place(spark, log):
    path, a, b, lines = log
    before = path.stat()
    result = scan.scan(spark, paths=[str(path)])
    tried = scrub.scrub_in_place(result, dry_run=True).collect()
    assert [(r["status"], r["replacements"], r["signed"]) for r in tried] == [("redacted", 3, 1)] and path.read_bytes() == b"\n".join(lines) + b"\n"
    done = scrub.scrub_in_place(result).collect()
    assert [(r["status"], r["replacements"], r["signed"]) for r in done] == [("redacted", 3, 1)]
    got = path.read_bytes().split(b"\n")
    marker = lambda s: f"[REDACTED:npm-token:{plain.fingerprint(s)}]".encode()
    assert got[:5] == [lines[0].replace(a.encode(), marker(a)), lines[1], lines[2], lines[3].replace(b.encode(), marker(b)), lines[4].replace(b.encode(), marker(b))]
    after = path.stat()
    assert (after.st_mode, after.st_mtime_ns) == (before.st_mode, before.st_mtime_ns)
    assert {r["status"] for r in scrub.scrub_in_place(result).collect()} == {"signed"}


def test_scrub_leaves_files_in_use_settings_and_changed_ones(spark, log, tmp_path, monkeypatch):
    path, a, _, _ = log
    os.utime(path)
    assert scrub.scrub_file(str(path), active_seconds=60)[0] == "active" and scrub.scrub_file(str(path), agent="config")[:2] == ("settings", 0)
    assert scrub.scrub_file(str(tmp_path / "none.jsonl"))[0].startswith("failed: No such file")
    assert scrub.scrub_file(str(path), ["0123456789ab"])[0] == "not found again"
    redacted = scrub.redacted
    monkeypatch.setattr(scrub, "redacted", lambda *x: (path.open("ab").write(b"more\n"), redacted(*x))[1])
    assert scrub.scrub_file(str(path))[0] == "failed: changed since the scan"
    monkeypatch.undo()
    link = tmp_path / "link.jsonl"
    link.symlink_to(path)
    inode = path.stat().st_ino
    assert scrub.scrub_file(str(link), [plain.fingerprint(a)], in_place=True)[0] == "redacted" and link.is_symlink() and path.stat().st_ino == inode


def test_a_record_that_would_break_stays_and_counts_nothing(spark, tmp_path):
    key = token(9)
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps({"a": key}) + "\n")
    result = scan.scan(spark, paths=[str(path)])
    wrong = result.hits.withColumn("end", F.col("end") + 2)
    out, status = scrub.scrub(scan.ScanResult(result.findings, result.files, result.documents, wrong, result.errors), include_active=True)
    assert [(r["text"], r["replacements"]) for r in out.collect()] == [(json.dumps({"a": key}), 0)]
    assert [(r["status"], r["replacements"]) for r in status.collect()] == [("failed: no longer valid JSON", 0)]


def test_session_end(tmp_path, log, capsys, monkeypatch):
    path, a, b, _ = log
    (tmp_path / ".env").write_text("API_KEY=a1b2c3d4e5f6\n")
    with path.open("a") as file:
        file.write(prompt("own a1b2c3d4e5f6") + "\n")
    ignore = tmp_path / "ignore"
    ignore.write_text(f"{plain.fingerprint(b)} # known\n")
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO(json.dumps({"transcript_path": str(path), "cwd": str(tmp_path)})))
    assert cli.main(["hook", "session-end", "--ignore-file", str(ignore)]) == 0
    text = path.read_bytes()
    assert b"env-value" in text and b"a1b2c3d4e5f6" not in text and text.count(b.encode()) == 2 and f"use {a}".encode() not in text
    for payload in ({}, {"transcript_path": 5}, {"transcript_path": "/nope/x.jsonl"}, {"transcript_path": "/etc/hosts"}):
        assert scrub.on_session_end(payload)[0] == "nothing to do"


def moved(reader, start):
    """(number, text) of what is new, and the offset after it."""
    end = reader.latestOffset()
    rows = sorted((row[4], row[5]) for p in reader.partitions(start, end) for row in reader.read(p))
    return rows, end


def test_appended_lines_are_read_once(tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("one\ntwo\nhal")
    reader = Tail({"places": json.dumps({"claude": [f"{tmp_path}/*"]}), "search_seconds": "0"})
    at = reader.initialOffset()
    rows, at = moved(reader, at)
    assert rows == []
    with path.open("a") as file:
        file.write("f\nfour")
    rows, at = moved(reader, at)
    assert rows == [(3, "half")]
    again, at = moved(reader, at)
    assert again == []
    (tmp_path / "new.jsonl").write_text("a\nb\n")
    (tmp_path / "note.md").write_text("n")
    rows, at = moved(reader, at)
    assert rows == [(0, "n"), (1, "a"), (2, "b")]
    path.write_text("other\nlines\nthan before\n")
    rows, at = moved(reader, at)
    assert rows == [(1, "other"), (2, "lines"), (3, "than before")]
    other = tmp_path / "other"
    other.write_text("x\n")
    os.replace(other, path)
    (tmp_path / "note.md").write_text("nn")
    rows, at = moved(reader, at)
    assert rows == [(0, "nn"), (1, "x")]
    path.unlink()
    assert moved(reader, at)[0] == []
    # A reader that starts anew from a stored offset goes on where that is.
    (tmp_path / "new.jsonl").open("a").write("c\n")
    late = Tail({"places": json.dumps({"claude": [f"{tmp_path}/*"]})})
    late.state = json.loads(at["files"])
    assert moved(late, at)[0] == [(3, "c")]


def test_small_files_share_tasks(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i:03}.jsonl").write_text(f"{i}\n")
    reader = Tail({"places": json.dumps({"claude": [f"{tmp_path}/*"]}), "search_seconds": "0", "from": "earliest", "tasks": "4"})
    start, end = reader.initialOffset(), reader.latestOffset()
    want = sorted(map(str, range(300)))
    for least, few, many in ((None, 5, 1), (1, 5, 4)):
        if least:
            monkeypatch.setattr(tail, "LEAST", least)
        tasks = reader.partitions(start, end)
        assert many <= len(tasks) <= few
        assert sorted(row[5] for p in tasks for row in reader.read(p)) == want
    # What is large is still divided, and no share of several ranges is larger than one range may be.
    monkeypatch.setattr(tail, "RANGE", 3 * tail.OPENING)
    (tmp_path / "big.jsonl").write_text("x" * 99 + "\n" + ("y" * 99 + "\n") * 2000)
    tasks = reader.partitions(start, reader.latestOffset())
    assert all(len(p.ranges) == 1 or sum(r.end - r.start for r in p.ranges) <= tail.RANGE for p in tasks) and len(tasks) > 100
    assert sum(1 for p in tasks for _ in reader.read(p)) == 2301


def test_databases_are_read_again_when_they_change(database):
    path, key = database
    reader = Tail({"places": json.dumps({"goose": [f"{path.parent}/*.db"]}), "search_seconds": "0"})
    at = reader.initialOffset()
    assert moved(reader, at)[0] == []
    db = sqlite3.connect(path)
    db.execute("INSERT INTO a VALUES ('four', 'more')")
    db.commit()
    db.close()
    rows, _ = moved(reader, at)
    assert len(rows) == 4 and sum(key in text for _, text in rows) == 2
    found = watch.places("/h", None, ["/p"], {"claude": ["/c"]})
    assert "/c/history.jsonl" in found["claude"] and "/p/.crush/crush.db" in found["crush"] and not any(p.endswith(".sqlite") for p in found["codex"])


def test_watch_sees_what_is_appended(spark, tmp_path):
    old, new, other = token(10), token(11), token(12)
    home = tmp_path / "home"
    path = home / ".claude/projects/p/s.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text(json.dumps({"sessionId": "abc", "cwd": "/w"}) + "\n" + prompt(f"use {old}") + "\n")
    logs = watch.agent_logs(spark, watch.places(str(home), ["claude"]), search_seconds=0)
    seen = []
    query = watch.new_findings(logs, spark.createDataFrame([(plain.fingerprint(other),)], "fingerprint string")).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        with path.open("a") as file:
            file.write(json.dumps({"type": "user", "message": {"content": f"use {new} and {other}"}}) + "\n")
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.2)
        with path.open("a") as file:
            file.write(prompt(new) + "\n")
        time.sleep(2)
    finally:
        query.stop()
    assert [(r["fingerprint"], r["location"]["line"], r["location"]["session"], r["location"]["origin"]) for r in seen] == [(plain.fingerprint(new), 3, "abc", "prompt")]


def test_quiet_files_are_redacted(log):
    path, a, _, _ = log
    now = [time.time()]
    quiet = watch.Quiet(30, clock=lambda: now[0])
    quiet.add({str(path): "claude"})
    assert quiet.due() == []
    now[0] += 31
    assert quiet.due() == [(str(path), "redacted", 3)] and quiet.due() == [] and f"use {a}".encode() not in path.read_bytes()


def test_folders_that_variables_name(spark, tmp_path):
    key = token(15)
    path = tmp_path / "elsewhere/projects/p/s.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text(prompt(key) + "\n")
    roots = files.roots_of({"CLAUDE_CONFIG_DIR": str(tmp_path / "elsewhere") + "/", "XDG_DATA_HOME": "/x"})
    assert roots == {"claude": [str(tmp_path / "elsewhere")], "opencode": ["/x/opencode"]}
    result = scan.scan(spark, str(tmp_path / "home"), ["claude"], [str(path)], roots=roots)
    assert result.files.count() == 1 and [r["secret"] for r in result.findings.collect()] == [key]


def test_custom_rules(spark, tmp_path):
    made = custom_rule("acme-token", "ACME token", "ACME", r"(acme_[a-z0-9]{6})", keywords=("acme_",), accepts=lambda s: "1" in s)
    (tmp_path / "x.txt").write_text("acme_a1b2c3 acme_aaaaaa\n")
    (found,) = scan.scan(spark, paths=[str(tmp_path / "x.txt")], rules=[*RULES, made]).findings.collect()
    assert (found["rule_id"], found["rule_name"], found["severity"], found["secret"]) == ("acme-token", "ACME token", "high", "acme_a1b2c3")
    for wrong in (("jwt", "x"), ("mine", "worst")):
        with pytest.raises(ValueError):
            custom_rule(wrong[0], "n", "p", "x", wrong[1])
    assert detect.matches(spark.createDataFrame([("a b",)], "text string"), rules=[made]).count() == 0


@pytest.mark.parametrize("text, want", [("Authorization: Bearer abcDEF1234567890xyzF!x7", ["abcDEF1234567890xyzF"]), ('bearer = "abcDEF1234567890xyzF"', []), ("Bearer   abcDEF1234567890xyzF~.9", ["abcDEF1234567890xyzF~.9"]), ("Bearer\nabcDEF1234567890xyzF", []), ('clékey = "abcDEF1234567890xyzF"', ["abcDEF1234567890xyzF"]), ('monkey = "abcDEF1234567890xyzF"', []), ('apiKey: "abcDEF1234567890xyz!"', ["abcDEF1234567890xyz!"])])
def test_generic_values(text, want):
    assert [m.secret for m in Detector().find(text) if m.rule.rule_id == "generic-secret"] == want


def test_a_secret_in_what_describes_it_reaches_no_report(spark):
    key, other = token(13), token(14)
    at = lambda s: ("claude", f"/w/{key}/a.jsonl", 1, "", f"s-{s}", f"/w/{key}", f"2026-01-01 {key}", "prompt")
    hits = spark.createDataFrame([(23.0, "npm-token", 4, key, at(other)), (23.0, "npm-token", 4, other, at(key))], f"ord double, rule_id string, severity_rank int, secret string, location {findings.LOCATION}")
    found = findings.merge(hits)
    outputs = [reports.render(found, kind) for kind in reports.RENDER] + [r["finding"] for r in reports.json_rows(found).collect()]
    assert not any(s in text for s in (key, other) for text in outputs)
    assert all(json.loads(r["finding"]) for r in reports.json_rows(found).collect())


@pytest.mark.parametrize("agent", [*hooks.TARGETS])
def test_hooks(tmp_path, agent):
    path = hooks.settings_path(agent, str(tmp_path))
    path.parent.mkdir()
    tool = hooks.TARGETS[agent].events["tool"]
    other = {"matcher": "Bash", "hooks": [{"type": "command", "command": "my-linter"}]}
    path.write_text('{"model": "x", // mine\n "hooks": {"%s": [%s],},}' % (tool, json.dumps(other)))
    assert hooks.install(path, agent) and not hooks.install(path, agent) and all(hooks.status(path, agent).values())
    got = json.loads(path.read_text())
    assert got["model"] == "x" and got["hooks"][tool][0] == other and len(got["hooks"][tool]) == 2
    assert path.with_name(path.name + ".keysieve-backup").exists()
    assert hooks.uninstall(path, agent) and not hooks.uninstall(path, agent)
    assert json.loads(path.read_text()) == {"model": "x", "hooks": {tool: [other]}} and not any(hooks.status(path, agent).values())
    path.write_text("{ nope")
    with pytest.raises(ValueError):
        hooks.install(path, agent)
    assert path.read_text() == "{ nope"


def test_hooks_into_nothing_and_comments(tmp_path):
    path = hooks.settings_path("claude", str(tmp_path))
    assert hooks.install(path, "claude") and hooks.uninstall(path, "claude") and json.loads(path.read_text()) == {}
    assert json.loads(hooks.without_comments('{"a": "// no /* no */ ,}", /* x */ "b": [1, 2,], // y\n}')) == {"a": "// no /* no */ ,}", "b": [1, 2]}
    with pytest.raises(ValueError):
        hooks.settings_path("cursor", ".")
    with pytest.raises(ValueError):
        hooks.settings_path("codex", ".", "local")


def test_doctor_of_a_machine(spark, tmp_path):
    session = tmp_path / ".claude/projects/p/s.jsonl"
    session.parent.mkdir(parents=True)
    session.write_text(prompt("hello") + "\n")
    (tmp_path / ".env").write_text("API_KEY=a1b2c3d4e5f6\n")
    result = scan.scan(spark, str(tmp_path), ["claude"])
    for folder in (tmp_path, *(p for p in tmp_path.rglob("*") if p.is_dir())):
        folder.chmod(0o755)
    session.chmod(0o644)
    state = lambda: {r["check"]: r["state"] for r in doctor.doctor(result, str(tmp_path), str(tmp_path)).collect()}
    assert state() == {"logs": "ok", "leaks": "ok", "settings": "ok", "prompts": "ok", "spread": "ok", "guard": "todo", "env": "ok", "perms": "todo", "retention": "info"}
    hooks.install(hooks.settings_path("claude", str(tmp_path)), "claude")
    path = hooks.settings_path("claude", str(tmp_path))
    path.write_text(json.dumps(json.loads(path.read_text()) | {"cleanupPeriodDays": 7}))
    (tmp_path / ".claude").chmod(0o700)
    assert {k: v for k, v in state().items() if k in ("guard", "perms", "retention")} == {"guard": "ok", "perms": "ok", "retention": "ok"}


def test_commands_of_the_machine(spark, tmp_path, capsys, monkeypatch):
    home = ["--home", str(tmp_path)]
    assert cli.main(["guard", "status", *home]) == 1 and cli.main(["guard", "install", *home]) == 0 and cli.main(["guard", "status", *home]) == 0
    assert cli.main(["guard", "install", "--agent", "cursor", *home]) == 2
    for shell in ("bash", "zsh", "fish"):
        assert cli.main(["completions", shell]) == 0
    assert "session-end" not in capsys.readouterr().err
    repo = tmp_path / "repo"
    (repo / ".specstory/history").mkdir(parents=True)
    (repo / ".specstory/history/a.md").write_text("_**User**_\nhello\n")
    for command in (["init"], ["add", "-f", "."]):
        __import__("subprocess").run(["git", "-C", str(repo), *command], check=True, capture_output=True)
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "summary"))
    assert cli.main(["repo", str(repo)]) == 0 and cli.main(["repo", str(repo), "--strict", "--github"]) == 1
    assert "::warning file=.specstory/history/a.md" in capsys.readouterr().out and "1 transcripts" in (tmp_path / "summary").read_text()
    assert cli.main(["repo", str(repo), "--strict", "--format", "sarif"]) == 1
    assert json.loads(capsys.readouterr().out)["runs"][0]["results"][0]["ruleId"] == "committed-transcript"


def test_decision_tables():
    from keysieve.operators.guard import is_secret_file, tool_risk
    from keysieve.plans.decisions import COMMANDS, OTHER_PATHS, SECRET_PATHS

    assert [(t, c) for t, c, blocked in COMMANDS if bool(tool_risk(t, {"command": c})) != blocked] == []
    assert all(map(is_secret_file, SECRET_PATHS)) and not any(map(is_secret_file, OTHER_PATHS))
