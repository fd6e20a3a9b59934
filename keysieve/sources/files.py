"""Log files as tables: discovery by agent, text by kind, lines with numbers, ignore lists."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.operators.classify import is_database, kind

#: Largest file that is read as a whole, and how much of it shows whether it is text.
MOST_BYTES, HEAD_BYTES = 256 << 20, 8192
#: Largest file with a hidden name, which the driver reads, and how many splits' line numbers are broadcast (under 32 MB).
MOST_HIDDEN_BYTES, MOST_SPLITS = 16 << 20, 200_000
#: Where programs keep their data under a home folder, by operating system.
APP_DATA = (".config", "Library/Application Support", "AppData/Roaming")
EDITORS = ("Code", "Code - Insiders", "Cursor", "Windsurf", "VSCodium", "Kiro")
#: Folders under a home folder in which agents keep their logs, and patterns below these.
AGENTS = {
    "claude": (
        (".claude",),
        ("projects/**/*.jsonl", "projects/**/*.jsonl.superseded-*", "projects/**/tool-results/*", "projects/*/memory/**/*.md", "history.jsonl", "file-history/**/*", "shell-snapshots/*", "session-env/**/*", "todos/*.json", "tasks/**/*.json", "plans/**/*.md", "debug/**/*", "paste-cache/**/*"),
    ),
    "codex": ((".codex",), ("sessions/**/*.jsonl", "archived_sessions/**/*.jsonl", "history.jsonl", "log/*.log", "thread_history_*.sqlite", "state_*.sqlite", "memories_*.sqlite")),
    "gemini": ((".gemini",), ("tmp/*/chats/**/*.json", "tmp/*/chats/**/*.jsonl", "tmp/*/logs.json", "tmp/*/checkpoint*.json", "history/**/*.json")),
    "opencode": ((".local/share/opencode",), ("storage/message/**/*.json", "storage/part/**/*.json", "storage/session/**/*.json", "opencode.db")),
    "cline": (APP_DATA, tuple(f"{e}/User/globalStorage/{x}/tasks/*/{f}" for e in EDITORS for x in ("saoudrizwan.claude-dev", "rooveterinaryinc.roo-cline", "kilocode.kilo-code") for f in ("api_conversation_history.json", "ui_messages.json"))),
    "continue": ((".continue",), ("sessions/*.json",)),
    "copilot": ((".copilot",), ("session-state/**/*.jsonl", "history-session-state/*.json", "logs/*.log", "command-history-state/**/*", "session-store.db", "jb/*/*.jsonl")),
    "copilot-chat": (
        APP_DATA,
        tuple(f"{e}/User/{w}" for e in ("Code", "Code - Insiders", "VSCodium") for w in ("workspaceStorage/*/chatSessions/*.jsonl", "workspaceStorage/*/chatSessions/*.json", "globalStorage/emptyWindowChatSessions/*.jsonl", "globalStorage/emptyWindowChatSessions/*.json", "workspaceStorage/*/GitHub.copilot-chat/transcripts/*.jsonl")),
    ),
    "cursor": ((*APP_DATA, ".cursor"), ("Cursor/User/globalStorage/state.vscdb", "Cursor/User/workspaceStorage/*/state.vscdb", "projects/*/agent-transcripts/**/*.jsonl", "projects/*/agent-transcripts/**/*.txt")),
    "aider": ((), (".aider.chat.history.md", ".aider.input.history")),
    "specstory": ((), (".specstory/history/*.md",)),
    "qwen": ((".qwen",), ("tmp/*/chats/*.json", "tmp/*/logs.json", "tmp/*/checkpoint*.json", "tmp/*/checkpoints/*.json", "projects/*/chats/**/*.jsonl")),
    "goose": ((".local/share", ".config", "AppData/Roaming"), ("goose/sessions/sessions.db", "goose/sessions/*.jsonl", "Block/goose/data/sessions/sessions.db")),
    "crush": ((), (".crush/crush.db",)),
    "config": (
        ("", *APP_DATA),
        (".claude.json", ".claude/settings.json", ".claude/settings.local.json", ".mcp.json", ".cursor/mcp.json", ".vscode/mcp.json", ".codeium/windsurf/mcp_config.json", ".gemini/settings.json", ".qwen/settings.json", ".codex/config.toml", ".copilot/mcp-config.json", ".continue/config.yaml", ".continue/config.json", ".continue/mcpServers/*", "opencode.json", ".crush.json")
        + ("opencode/opencode.json", "opencode/opencode.jsonc", "crush/crush.json", "goose/config.yaml", "Claude/claude_desktop_config.json", "Code/User/mcp.json", "Code - Insiders/User/mcp.json", "Cursor/User/mcp.json", "Windsurf/User/mcp.json", "*/User/globalStorage/*/settings/*mcp_settings.json"),
    ),
}
#: Agents that keep files in the folders they worked in.
IN_PROJECTS = ("aider", "specstory", "crush", "config")
#: Agents whose files must not be changed, and databases that a watch leaves out.
NOT_SCRUBBABLE, NOT_WATCHED = ("config",), ("codex", "copilot")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only in local mode an unset one becomes a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="keysieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Variables that move an agent's folder.
FOLDER_VARIABLES = (("CLAUDE_CONFIG_DIR", "claude", ""), ("CODEX_HOME", "codex", ""), ("CODEX_SQLITE_HOME", "codex", ""), ("COPILOT_HOME", "copilot", ""), ("XDG_DATA_HOME", "opencode", "/opencode"))


def roots_of(environment: Mapping[str, str]) -> dict[str, list[str]]:
    """Further folders of agents that environment variables name."""
    out: dict[str, list[str]] = {}
    for name, agent, below in FOLDER_VARIABLES:
        if environment.get(name):
            out.setdefault(agent, []).append(environment[name].rstrip("/") + below)
    return out


def agents_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, i, a not in NOT_SCRUBBABLE, a not in NOT_WATCHED) for i, a in enumerate(AGENTS)], "agent string, rank int, scrubbable boolean, watched boolean")


FILES = "agent string, file string, kind string, is_db boolean, modified timestamp, length long, content binary"


def _hidden(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, modificationTime, length, content of files whose names begin with a dot, which Spark's file sources leave out.

    Read on the driver through Hadoop's file system: settings and histories of a folder, up to 16 MiB each. One that can't
    be read has no content.
    """
    from datetime import UTC, datetime

    jvm, rows = spark._jvm, []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path)
        content = None
        if status.getLen() <= MOST_HIDDEN_BYTES:
            try:
                stream = fs.open(path)
                try:
                    content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
            except Py4JJavaError:
                content = None
        rows.append((name, datetime.fromtimestamp(status.getModificationTime() / 1000, UTC), status.getLen(), content))
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length long, content binary")


def _is_hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1][:1] in "._"


def escaped(path: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([\[\]{}*?])", r"\\\1", path)


def plain_name(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def modified_since(files: DataFrame, since: str, column: str = "modified") -> DataFrame:
    """Files changed after a moment (ISO time)."""
    return files.where(F.col(column) > F.lit(since).cast(files.schema[column].dataType))


def read_binary(spark: SparkSession, path: str | list[str], agent: str = "path", since: str | None = None) -> DataFrame:
    """agent, file, kind, is_db, modified, length, content of the files at a glob, or of a list of files; with since (ISO time) only later ones.

    Content is null where it isn't read here: JSONL is read by path in splits, databases by row, and files over 256 MiB not
    at all. A file that can't be read is left out and reported by `errors`.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    hidden = []
    if isinstance(path, list):
        hidden = [p for p in path if _is_hidden(p)]
        path = [escaped(p) for p in path if not _is_hidden(p)]
    elif _is_hidden(path):
        hidden, path = [path], []
    if since:
        reader = reader.option("modifiedAfter", since)
    name = plain_name(F.col("path"))
    rows = _hidden(spark, hidden) if hidden or not path else None
    if rows is not None and since:
        rows = modified_since(rows, since, "modificationTime")
    if path:
        listed = reader.load(path).select("path", "modificationTime", "length")
        whole = (kind(name) != "jsonl") & ~is_database(name) & (F.col("length") <= MOST_BYTES)
        names = [escaped(r["path"]) for r in listed.where(whole).select("path").toLocalIterator()]
        found = listed.withColumn("content", F.lit(None).cast("binary"))
        if names:
            found = found.unionByName(reader.load(names).select("path", "modificationTime", "length", "content"))
        rows = found if rows is None else found.unionByName(rows)
    # Each file once, with its content if that could be read.
    rows = rows.groupBy(name.alias("file")).agg(F.max("modificationTime").alias("modified"), F.max("length").alias("length"), F.max_by("content", F.col("content").isNotNull()).alias("content"))
    file = F.col("file")
    return rows.select(F.lit(agent).alias("agent"), "file", kind(file).alias("kind"), is_database(file).alias("is_db"), "modified", "length", "content")


def glob_regex(pattern: str) -> str:
    """A path pattern, with ** for any folders, as a regular expression."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", "[^/]*")
    return f"^{out}$"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _listed(spark: SparkSession, root: str, patterns: tuple[str, ...]) -> list[str]:
    """Files under a folder that match: single names are looked up, the rest listed below the folder each pattern begins with; links are not followed."""
    plain = [f"{root}/{p}" for p in patterns if "*" not in p]
    found = {p for p in plain if _exists(spark, p)}
    starts = {p.split("*")[0].rpartition("/")[0] for p in patterns if "*" in p}
    for start in sorted(starts):
        below = f"{root}/{start}".rstrip("/")
        if any(start != s and (start + "/").startswith(s + "/") for s in starts if s) or not _exists(spark, below):
            continue
        name = plain_name(F.col("path"))
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(escaped(below)).select(name.alias("file"))
        relative = F.substring("file", len(root) + 2, 1 << 20)
        fits = relative.rlike("|".join(glob_regex(p) for p in patterns if "*" in p))
        found |= {r["file"] for r in rows.where(fits).toLocalIterator()}
    return sorted(found)


def discover(spark: SparkSession, home: str, agents: list[str] | None = None, since: str | None = None, projects: list[str] | None = None, roots: dict[str, list[str]] | None = None) -> DataFrame:
    """Files of the agents under a home folder, in the projects they worked in (by default those their sessions name), and in further roots by agent.

    An unknown agent is an error. Names of files are listed on the driver, contents are read by executors; for logs in a
    store use `read_binary` or `lines` with its path.
    """
    if unknown := {*(agents or ())} - AGENTS.keys():
        raise ValueError(f"unknown agent: {', '.join(sorted(unknown))}")
    home, out = home.rstrip("/"), None
    if projects is None and {*(agents or AGENTS)} & {*IN_PROJECTS}:
        own = [p for a in ("claude", "codex") for p in _listed(spark, f"{home}/{AGENTS[a][0][0]}", AGENTS[a][1]) if p.endswith(".jsonl")]
        sessions = read_binary(spark, own, "claude") if own else None
        projects = [r["project"] for r in known_projects(sessions).toLocalIterator() if _exists(spark, r["project"])] if sessions is not None else []
    for agent in agents or AGENTS:
        folders, patterns = AGENTS[agent]
        places = [f"{home}/{f}".rstrip("/") for f in folders] + [*(roots or {}).get(agent, ())] + ([p.rstrip("/") for p in projects] if agent in IN_PROJECTS else [])
        paths = sorted({p for place in dict.fromkeys(places) if _exists(spark, place) for p in _listed(spark, place, patterns)})
        if paths:
            part = read_binary(spark, paths, agent, since)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FILES) if out is None else out


def is_text(content: Column) -> Column:
    """No zero byte near the start."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, HEAD_BYTES)), "(..)", "$1 ")) == 0


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD, so no file ends a scan."""
    return F.make_valid_utf8(content.cast("string"))


#: Rows of documents: part is the table of a database's record, else empty; (file, part, unit_no) is a key.
DOCUMENTS = "agent string, file string, kind string, part string, unit_no int, text string"


def documents(files: DataFrame) -> DataFrame:
    """agent, file, kind, part, unit_no, text: a row for each line of JSONL files (from 1), for each other file one row (0).

    JSONL is read by path, in splits. Databases, binary files, and other files over 256 MiB are left out.
    """
    spark = files.sparkSession
    texts = files.where(F.col("content").isNotNull() & ~F.col("is_db") & is_text(F.col("content"))).withColumn("text", text_of(F.col("content")))
    hidden = texts.where("kind = 'jsonl'").select("agent", "file", "kind", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("agent", "file", "kind", F.lit("").alias("part"), (F.col("n") + 1).alias("unit_no"), "text")
    whole = texts.where("kind <> 'jsonl'").select("agent", "file", "kind", F.lit("").alias("part"), F.lit(0).alias("unit_no"), "text")
    out = whole.unionByName(hidden)
    names: dict[str, list[str]] = {}
    for r in files.where(by_line(files)).select("agent", "file").toLocalIterator():
        names.setdefault(r["agent"], []).append(r["file"])
    for agent, paths in sorted(names.items()):
        out = out.unionByName(lines(spark, sorted(paths), agent))
    return out.where("text <> ''")


def by_line(files: DataFrame) -> Column:
    """Files that `lines` reads: JSONL, but for names that Spark's file sources leave out."""
    return (F.col("kind") == "jsonl") & ~F.col("is_db") & ~F.col("file").rlike("(^|/)[._][^/]*$")


def first_lines(docs: DataFrame) -> DataFrame:
    """The first record of each file, which says its session and project; a database's records each stand for themselves."""
    return docs.where("unit_no <= 1 and part = ''").groupBy("file").agg(F.min_by("text", "unit_no").alias("first_line"))


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block (where a split's first line begins), id (rising by one within a block) and text of line files, read in splits cut at line breaks."""
    rows = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text([escaped(f"file://{p}" if p.startswith("/") else p) for p in paths])
    # The path is that of a URL.
    name = plain_name(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    return rows.select(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.make_valid_utf8("value").alias("text"))


def lines(spark: SparkSession, files: str | list[str], agent: str = "path") -> DataFrame:
    """agent, file, kind, part, unit_no, text of every line of line files of any size.

    Lines are counted in each split first, by a pass that combines before its shuffle; a line's number is its place in its
    split and the lines of the file's splits before.
    """
    rows = raw_lines(spark, [files] if isinstance(files, str) else files)
    counts = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"))
    # A row for each split: broadcast while they are few, joined by a shuffle beyond.
    few = starts.limit(MOST_SPLITS + 1).collect()
    known = F.broadcast(spark.createDataFrame(few, "file string, block long, start long")) if len(few) <= MOST_SPLITS else starts
    number = (F.col("id") - F.col("start") + 1).cast("int")
    return rows.join(known, ["file", "block"]).select(F.lit(agent).alias("agent"), "file", F.lit("jsonl").alias("kind"), F.lit("").alias("part"), number.alias("unit_no"), "text")


def errors(files: DataFrame) -> DataFrame:
    """file and message of those that are left out: too large, or not to be read (found by reading the rest once more)."""
    large = files.where((F.col("length") > MOST_BYTES) & ~by_line(files) & ~F.col("is_db")).select("file", F.lit("larger than 256 MiB").alias("message"))
    unread = files.where(F.col("content").isNull() & ~by_line(files) & ~F.col("is_db") & (F.col("length") <= MOST_BYTES)).select("file", F.lit("could not be read").alias("message"))
    return large.unionByName(unread)


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints, one a line; # starts a comment."""
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("fingerprint")).where("fingerprint <> ''").distinct()


def add_to_ignore(spark: SparkSession, path: str, fingerprints: DataFrame, known: DataFrame | None = None) -> int:
    """Appends those that aren't there yet; returns how many."""
    new = fingerprints.select("fingerprint").distinct()
    new = new if known is None else new.join(known, "fingerprint", "left_anti")
    n = new.count()
    if n:
        new.coalesce(1).write.mode("append").text(path)
    return n


def known_projects(files: DataFrame) -> DataFrame:
    """Working folders that session files name in their first lines."""
    paths = [r["file"] for r in files.where(F.col("agent").isin("claude", "codex") & by_line(files)).select("file").toLocalIterator()]
    if not paths:
        return files.sparkSession.createDataFrame([], "project string")
    rows = raw_lines(files.sparkSession, paths).where(F.col("block") == 0)
    found = F.get(F.regexp_extract_all("text", F.lit(r'"cwd"\s*:\s*"((?:[^"\\]|\\.)+)"'), F.lit(1)), 0)
    return rows.select(F.get_json_object(F.concat(F.lit('{"cwd":"'), found, F.lit('"}')), "$.cwd").alias("project")).where("project is not null").distinct()


def env_files(spark: SparkSession, project: str) -> DataFrame:
    """(file, line_no, line) of .env files in a project and one level below."""
    from keysieve.operators.environment import SKIPPED_FOLDERS, is_env_file

    path = spark._jvm.org.apache.hadoop.fs.Path
    names = []
    for pattern in ("/*", "/*/*"):
        target = path(f"{project.rstrip('/')}{pattern}")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        names += [s.getPath().toString() for s in fs.globStatus(target) or () if s.isFile() and ".env" in s.getPath().getName()]
    skipped = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).isin(*SKIPPED_FOLDERS)
    found = spark.createDataFrame([(n,) for n in names], "path string").where(is_env_file(F.regexp_extract("path", "[^/]+$", 0)) & ~skipped)
    files = read_binary(spark, [r["path"] for r in found.collect()], "env")
    return files.select("file", F.posexplode(F.split(text_of(F.col("content")), "\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")
