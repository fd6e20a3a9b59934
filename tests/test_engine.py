import json
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keysieve.functions import plain, scalars
from keysieve.operators import classify, context, detect, environment, findings, guard, redact, reports
from keysieve.operators.kernel import Detector, entropy, is_placeholder
from keysieve.plans.rules import RULES
from keysieve.sources import files
from keysieve.sources.sqlite import SqliteRows
from keysieve.streaming import watch
from maker import ALNUM, Maker

RUN_RULES = [r for r in RULES if r.is_token_run]


@pytest.fixture(scope="module")
def corpus(spark):
    """(id, text) with one credential for each rule, some repeated, and texts with none."""
    maker = Maker(7)
    rows = [(i, f"start {maker.text(r, maker.of(r))} end") for i, r in enumerate(RULES)]
    rows += [(200, "nothing here"), (201, None), (202, ""), (203, rows[3][1] + " " + rows[3][1]), (204, rows[5][1])]
    return spark.createDataFrame(rows, "id long, text string"), rows


def test_matches_equal_the_kernel_and_no_partitioning_matters(corpus):
    df, rows = corpus
    kernel = Detector()
    want = sorted((i, m.rule.rule_id, m.secret, m.start, m.end) for i, t in rows if t for m in kernel.find(t))
    for parts in (1, 7):
        got = sorted((r["id"], r["rule_id"], r["secret"], r["start"], r["end"]) for r in detect.matches(df.repartition(parts)).collect())
        assert got == want
    assert {r for _, r, *_ in want} == {r.rule_id for r in RULES}


def test_token_runs_equal_the_kernel(corpus):
    df, rows = corpus
    runs = {r.rule_id for r in RUN_RULES}
    kernel = Detector(RUN_RULES)
    want = {(i, m.rule.rule_id, m.secret, m.rank) for i, t in rows if t for m in kernel.find(t)}
    got = {(r["id"], r["rule_id"], r["run"], r["severity_rank"]) for r in detect.token_run_hits(detect.token_runs(df)).collect()}
    assert {x[1] for x in want} == runs and got == want


def test_scalars_equal_plain_ones(spark):
    rng = random.Random(3)
    words = ["", "a", "token", "aab", "your_thing", "p@ss/word1", "日本語テキスト"] + ["".join(rng.choices(ALNUM, k=rng.randint(1, 60))) for _ in range(100)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    s = F.col("s")
    for r in df.select("s", scalars.entropy(s).alias("h"), scalars.mask(s).alias("m"), scalars.fingerprint(s).alias("f"), scalars.is_placeholder(s).alias("p")).collect():
        assert abs(r["h"] - entropy(r["s"])) < 1e-9 and r["f"] == plain.fingerprint(r["s"]) and r["p"] == is_placeholder(r["s"])
        if r["s"]:
            assert r["m"] == plain.mask(r["s"])


def test_checksum_and_jwt(spark):
    maker = Maker()
    good = [maker.github() for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in good] + [(t[:-1] + ("a" if t[-1] != "a" else "b"),) for t in good], "t string")
    assert df.where(scalars.github_checksum_ok(F.col("t"))).count() == 20
    tokens = spark.createDataFrame([(maker.jwt("anon"),), ("eyJx.eyJy.zzz",), ("a.b",)], "t string")
    assert [r["ok"] for r in tokens.select(scalars.jwt_ok(F.col("t")).alias("ok")).collect()] == [True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=200))
def test_mask_shows_a_quarter_at_most(s):
    shown = plain.mask(s).rsplit("…(", 1)[0]
    assert s.startswith(shown) and len(shown) <= max(1, len(s) // 4)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_any_text_can_be_scanned(s):
    for m in Detector(RULES).find(s):
        assert s[m.start : m.end] == m.secret


def hit(secret, rule="npm-token", order=23.0, rank=4, **at):
    base = {"agent": "claude", "file": "a.jsonl", "line": 1, "json_path": "", "session": "s1", "project": "", "timestamp": "", "origin": "prompt"} | at
    return (order, rule, rank, secret, tuple(base.values()))


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        hit("sec-1", timestamp="2025-02-01T00:00:00Z", session="s1"), hit("sec-1", timestamp="2025-01-01T00:00:00Z", session="s2", file="b.jsonl"), hit("sec-1", timestamp="2025-01-01T00:00:00Z", session="s2", file="b.jsonl"),
        hit("sec-1", rule="generic-secret", order=98.0, rank=2, file="c.jsonl", session="", origin="tool-output"), hit("sec-2", rule="jwt", order=97.0, rank=1, agent="codex"),
    ]
    return findings.merge(spark.createDataFrame(rows, f"ord double, rule_id string, severity_rank int, secret string, location {findings.LOCATION}"))


def test_merge(found):
    one, two = sorted(found.collect(), key=lambda r: r["secret"])
    assert (one["rule_id"], one["severity"], one["sessions"], one["occurrences"], one["first_seen"], one["last_seen"]) == ("npm-token", "critical", 2, 3, "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z")
    assert [at["file"] for at in one["locations"]] == ["b.jsonl", "a.jsonl", "c.jsonl"] and one["origins"] == ["prompt", "tool-output"]
    assert two["severity"] == "low" and two["first_seen"] is None


def test_filters_and_summaries(spark, found):
    assert findings.at_least(found, "high").count() == 1
    ignored = spark.createDataFrame([(plain.fingerprint("sec-1"),)], "fingerprint string")
    assert [r["rule_id"] for r in findings.without_ignored(found, ignored).collect()] == ["jwt"]
    assert findings.ignored_count(found, ignored).first()[0] == 1
    assert [(r["severity"], r["findings"]) for r in findings.by_severity(found).orderBy("severity_rank").collect()] == [("low", 1), ("medium", 0), ("high", 0), ("critical", 1)]
    assert {r["origin"]: (r["findings"], r["share"]) for r in findings.by_origin(found).collect()} == {"prompt": (2, 1.0), "tool-output": (1, 0.5)}
    assert findings.summary(found).first().asDict() == {"findings": 2, "low": 1, "medium": 0, "high": 0, "critical": 1, "worst": "critical"}
    assert [r["fingerprint"] for r in findings.ordered(found).collect()][0] == plain.fingerprint("sec-1")
    assert {r["file"] for r in findings.scrub_plan(found).collect()} == {"a.jsonl", "b.jsonl", "c.jsonl"}
    assert [str(r["day"]) for r in findings.timeline(found).collect()] == ["2025-01-01"]


@pytest.mark.parametrize("kind", [*reports.RENDER])
def test_no_report_holds_a_secret(found, kind):
    out = reports.render(found, kind)
    assert "sec-1" not in out and "sec-2" not in out and (kind != "json" or json.loads(out)["summary"]["findings"] == 2)
    if kind == "sarif":
        run = json.loads(out)["runs"][0]
        assert len(run["results"]) == 4 and {r["ruleId"] for r in run["results"]} == {"npm-token", "jwt/low"}


def test_redaction(spark, corpus):
    df, rows = corpus
    matches = detect.matches(df)
    out = redact.redact(df, matches, ["id"])
    texts = {r["id"]: (r["text"], r["replacements"]) for r in out.collect()}
    kernel = Detector()
    for i, t in rows:
        spans = kernel.find(t or "")
        assert texts[i][1] == len(spans) and not any(m.secret in (texts[i][0] or "") for m in spans)
    assert texts[200] == ("nothing here", 0) and texts[201] == (None, 0)
    assert detect.matches(out.select("id", "text")).count() == 0
    only = spark.createDataFrame([(plain.fingerprint(kernel.find(rows[3][1])[0].secret),)], "fingerprint string")
    assert redact.redact(df, matches, ["id"], targets=only).agg(F.sum("replacements")).first()[0] == 3


def test_redacted_records_stay_valid(spark):
    npm = Maker().of(next(r for r in RULES if r.rule_id == "npm-token"))
    lines = spark.createDataFrame([(1, json.dumps({"a": f"x {npm}\n"})), (2, '{"cut": "' + npm)], "id long, text string")
    out = redact.redact(lines, detect.matches(lines), ["id"]).join(lines.withColumnRenamed("text", "old"), "id")
    assert out.where(redact.still_valid(F.col("old"), F.col("text"))).count() == 2
    assert out.where(F.try_parse_json("text").isNotNull()).count() == 1


def test_hide(spark):
    s = 'long"secret-value'
    df = spark.createDataFrame([(f"a {s} b {json.dumps(s)} c",)], "t string")
    assert df.select(redact.hide(F.col("t"), [s, "short"]).alias("t")).first()[0].count("[REDACTED:") == 2


def test_spans_and_claims(spark):
    df = spark.createDataFrame([("ab1 cd22 e😀f333",), ("",), ("none",)], "t string")
    got = [[(x["value"], x["start"], x["end"]) for x in r[0]] for r in df.select(detect.spans(F.col("t"), "[0-9]+")).collect()]
    assert got == [[("1", 2, 3), ("22", 6, 8), ("333", 12, 15)], [], []]


RECORDS = [
    ({"type": "user", "message": {"role": "user", "content": "SECRET"}, "timestamp": "t1"}, "claude", ("message.content", "prompt", "t1", [])),
    ({"type": "user", "message": {"content": [{"type": "tool_result", "content": "SECRET"}]}}, "claude", ("message.content[0].content", "tool-output", "", [])),
    ({"type": "assistant", "message": {"content": [{"type": "text", "text": "SECRET"}]}}, "claude", ("message.content[0].text", "assistant", "", [])),
    ({"display": "SECRET", "pastedContents": {}}, "claude", ("display", "history", "", [])),
    ({"type": "queue-operation", "content": "SECRET"}, "claude", ("content", "prompt", "", [])),
    ({"type": "response_item", "payload": {"type": "function_call_output", "output": "SECRET"}}, "codex", ("payload.output", "tool-output", "", [])),
    ({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "SECRET"}]}}, "codex", ("payload.content[0].text", "prompt", "", [])),
    ({"messages": [{"type": "user", "content": "SECRET"}]}, "gemini", ("messages[0].content", "prompt", "", [])),
    ({"type": "tool", "state": {"output": "SECRET"}}, "opencode", ("state.output", "tool-output", "", [])),
    ({"type": "image", "source": {"type": "base64", "data": "SECRET"}}, "claude", None),
    ({"message": {"signature": "SECRET" + "x" * 300}}, "claude", None),
    ({"a-b": {"c": "SECRET"}}, "path", ("a-b.c", "other", "", [])),
    ({"SECRET": 1}, "path", ("", "other", "", [])),
    ({"primaryApiKey": "SECRET"}, "config", None),
    ({"primaryApiKey": "SECRET", "mcpServers": {"x": {"env": {"KEY": "SECRET"}}}}, "config", ("mcpServers.x.env.KEY", "config", "", ["mcpServers.x.env.KEY"])),
    ({"projects": {"/w": {"history": [{"display": "SECRET"}]}}}, "config", ("projects['/w'].history[0].display", "history", "", [])),
]


@pytest.mark.parametrize("record, agent, want", RECORDS)
def test_places(record, agent, want):
    assert context.places(json.dumps(record), "SECRET", 0, agent) == want


def test_nth_place_and_broken_records():
    line = json.dumps({"role": "user", "a": "SECRET", "b": ["x SECRET"]})
    assert context.places(line, "SECRET", 1)[0] == "b[0]"
    assert context.places('{"a": "SECRET', "SECRET", 0) == ("", "other", "", [])


def test_walk_and_locate(spark):
    line = json.dumps({"z": "1", "a": {"x y": ["2", {"type": "image", "source": {"type": "base64", "data": "skip"}}]}, "signature": "s" * 400})
    got = context.walk(spark.createDataFrame([(1, line), (2, "no json"), (3, None)], "id long, line string")).collect()
    assert [(r["json_path"], r["value"]) for r in got] == [("z", "1"), ("a['x y'][0]", "2")]


@pytest.mark.parametrize("agent, file, text, want", [("aider", "x/.aider.chat.history.md", "#### use KEY", "prompt"), ("aider", "x/.aider.chat.history.md", "> KEY", "tool-output"), ("aider", "x/.aider.input.history", "+KEY", "history"), ("claude", "/h/.claude/paste-cache/1", "KEY", "prompt"), ("specstory", "a.md", "_**User**_\nKEY", "prompt"), ("specstory", "a.md", "_**User**_\n_**Assistant**_\nKEY", "assistant"), ("specstory", "a.md", "_**Assistant**_\n<details><summary>Tool use</summary>\nKEY", "tool-output")])
def test_text_origin(agent, file, text, want):
    assert context.text_origin(agent, file, text, text.index("KEY")) == want


BLOCKED = ["cat .env", "cat<.env", "sudo -n cat .env", "FOO=1 sudo -u root timeout 5 cat .env", "printenv", "env", "env | sort", "echo $STRIPE_SECRET_KEY", "bash -c 'cat .env'", "env -S 'cat .env'", "watch 'cat .env'", "(cat .env)", "ls; head -3 ~/.aws/credentials", "gh auth token", "python -c \"print(open('.env').read())\"", "grep -e x .env", "grep TOKEN .env", "echo $(cat id_rsa)"]
ALLOWED = ["ls", "cat README.md", "cat .env.example", "grep -rn credentials src/", "curl -H \"Authorization: Bearer $TOKEN\" x", "echo '$API_KEY'", "echo $TOKEN_COUNT", "env FOO=1 make", "set -e", "echo ${API_KEY:+set}", "python -c 'import config; print(config.key)'", "git commit -m 'read .env'"]


@pytest.mark.parametrize("command", BLOCKED)
def test_risky_commands(command):
    assert guard.risk(command)


@pytest.mark.parametrize("command", ALLOWED)
def test_harmless_commands(command):
    assert not guard.risk(command)


def test_guard_decisions(spark):
    npm = Maker().of(next(r for r in RULES if r.rule_id == "npm-token"))
    events = [("prompt", {"prompt": f"use {npm}"}), ("prompt", {"prompt": f"use {npm} {guard.ALLOW}"}), ("prompt", {"prompt": "hello"}), ("tool", {"tool_name": "Read", "tool_input": {"file_path": "/a/.env"}}), ("tool", {"tool_name": "mcp__fs__read_text_file", "tool_input": {"path": "id_rsa"}}), ("tool", {"tool_name": "Grep", "tool_input": {"path": "x", "glob": "*.pem"}}), ("tool", {"tool_name": "shell", "tool_input": {"command": ["bash", "-lc", "cat .env"]}}), ("tool", {"tool_name": "Write", "tool_input": {"file_path": ".env"}}), ("tool", [1])]
    df = spark.createDataFrame([(i, e, json.dumps(p)) for i, (e, p) in enumerate(events)] + [(99, "tool", "garbage"), (100, "prompt", None)], "id int, event string, payload string")
    got = {r["id"]: (r["exit_code"], r["message"]) for r in guard.decide(df).collect()}
    assert [got[i][0] for i in (*range(9), 99, 100)] == [2, 0, 0, 2, 2, 2, 2, 0, 0, 0, 0] and npm not in got[0][1]
    assert guard.risk(r"Get-Content C:\Users\me\.ssh\id_rsa", powershell=True) and guard.risk("Get-ChildItem Env:")


def test_paths(spark):
    want = {".env": True, "a/.env.local": True, ".env.example": False, "id_rsa": True, "id_rsa.pub": False, "src/key.py": False, "C:\\x\\server.PEM": True, "x/.kube/config": True, "config": False, "service-account-1.json": True}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", classify.is_secret_file(F.col("p")).alias("s")).collect()} == want
    assert {p: guard.is_secret_file(p) for p in want} == want
    agents = {"a/.claude/x/y.jsonl": "claude", ".specstory/history/a.md": "specstory", "cline_task_jan-1-2025x.md": "cline", "a.jsonl": None}
    df = spark.createDataFrame([(p,) for p in agents], "p string")
    assert {r["p"]: r["a"] for r in df.select("p", classify.transcript_agent(F.col("p")).alias("a")).collect()} == agents


def test_environment(spark):
    text = "export API_KEY=\"a1b2c3d4e5f6\"\n# TOKEN=zzzzzzzzzzz1\nDB_PASSWORD: q9w8e7r6t5y4  # main\nPUBLIC_KEY=a1b2c3d4e5f6\nTOKEN=short\nSECRET=changeme-now-1\nAPI_KEY=g7h8j9k0l1m2\nDATABASE_URL=postgres://u:p4ss@h/db1\nWEBHOOK=https://example.org/hooks/1\n"
    lines = spark.createDataFrame([(".env", i + 1, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")
    parsed = environment.parse(lines)
    assert {(r["name"], r["value"]) for r in environment.values(parsed).select(F.col("label").alias("name"), "value").collect()} == {("API_KEY", "g7h8j9k0l1m2"), ("DB_PASSWORD", "q9w8e7r6t5y4"), ("DATABASE_URL", "postgres://u:p4ss@h/db1")}


@pytest.fixture
def home(tmp_path):
    maker = Maker(11)
    npm = maker.of(next(r for r in RULES if r.rule_id == "npm-token"))
    session = tmp_path / ".claude/projects/p1/s1.jsonl"
    session.parent.mkdir(parents=True)
    session.write_text(json.dumps({"sessionId": "abc", "cwd": "/work/app", "type": "user", "message": {"content": "hello"}}) + "\n" + json.dumps({"type": "user", "message": {"content": f"use {npm}"}}) + "\n")
    rollout = tmp_path / ".codex/sessions/2025/01/02/r.jsonl"
    rollout.parent.mkdir(parents=True)
    rollout.write_text(json.dumps({"type": "session_meta", "payload": {"id": "cx1", "cwd": "/work/b"}}) + "\n" + json.dumps({"payload": {"type": "function_call_output", "output": npm}}) + "\n")
    (tmp_path / ".claude/file-history/x").mkdir(parents=True)
    (tmp_path / ".claude/file-history/x/h@v1").write_bytes(b"\0binary" + npm.encode())
    return tmp_path, npm


def test_agents_to_findings(spark, home):
    root, npm = home
    found = files.discover(spark, str(root), ["claude", "codex"])
    docs = files.documents(found)
    assert found.count() == 3 and docs.count() == 4
    hits = detect.matches(docs.withColumn("line", F.col("text"))).join(files.first_lines(docs), "file")
    located = context.locate(hits)
    rows = located.select("agent", "unit_no", "origin", context.session_of(F.col("agent"), F.col("line"), F.col("first_line"), F.col("file")).alias("session"), context.project_of(F.col("agent"), F.col("line"), F.col("first_line"), F.col("file")).alias("project")).collect()
    assert sorted(map(tuple, rows)) == [("claude", 2, "prompt", "abc", "/work/app"), ("codex", 2, "tool-output", "cx1", "/work/b")]
    assert {r["project"] for r in files.known_projects(found).collect()} == {"/work/app", "/work/b"}
    with pytest.raises(ValueError):
        files.discover(spark, str(root), ["nobody"])
    assert files.discover(spark, str(root / "none")).count() == 0
    (root / "work").mkdir()
    (root / "work/.aider.chat.history.md").write_text(f"#### use {npm}\n")
    (root / ".claude.json").write_text("{}")
    more = files.discover(spark, str(root), ["aider", "config"], projects=[str(root / "work")])
    assert {(r["agent"], r["file"].rsplit("/", 1)[1]) for r in more.collect()} == {("aider", ".aider.chat.history.md"), ("config", ".claude.json")}


def test_ignore_list(spark, tmp_path):
    path = str(tmp_path / "ignore")
    assert files.add_to_ignore(spark, path, spark.createDataFrame([("abc # mine",), ("# note",), ("abc",), ("def",)], "fingerprint string")) == 4
    assert {r[0] for r in files.ignore_list(spark, path).collect()} == {"abc", "def"}


def test_sqlite(spark, tmp_path):
    path = tmp_path / "state.vscdb"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE cursorDiskKV (key TEXT UNIQUE, value BLOB); CREATE TABLE messages (id INTEGER, body TEXT, raw BLOB)")
    db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [("bubbleId:c:1", json.dumps({"type": 1, "text": "hi", "aEncryptionKey": "k"}).encode()), ("cursorAuth/token", b"secret")])
    db.execute("INSERT INTO messages VALUES (1, '[1, 2]', x'ff00')")
    db.commit()
    db.close()
    spark.dataSource.register(SqliteRows)
    rows = {(r["table"], r["unit_no"]): json.loads(r["text"]) for r in spark.read.format("sqlite_rows").option("paths", json.dumps([str(path), f"{tmp_path}/none,x.db"])).load().collect()}
    assert rows == {("cursorDiskKV", 1): {"key": "bubbleId:c:1", "value": {"type": 1, "text": "hi"}}, ("messages", 1): {"table": "messages", "id": 1, "body": [1, 2]}}


def test_watch_reports_a_secret_once(spark, tmp_path):
    maker = Maker(13)
    rule = next(r for r in RULES if r.rule_id == "npm-token")
    old, new = maker.of(rule), maker.of(rule)
    folder = tmp_path / "in"
    write = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(str(folder))
    write([f"a {old}", f"b {new}", f"c {new}"])
    baseline = spark.createDataFrame([(plain.fingerprint(old),)], "fingerprint string")
    seen = []
    query = watch.start(spark, spark.readStream.schema("text string").parquet(str(folder)), lambda df: seen.extend(r["fingerprint"] for r in df.collect()), str(tmp_path / "state"), interval="0 seconds", baseline=baseline)
    try:
        query.processAllAvailable()
        write([f"again {new}"])
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [plain.fingerprint(new)]


def test_rest_works_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith(('keysieve.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\nimport __spark_entry__ as e\nprint(len(e.queries()) >= 40)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.strip() == "True"
