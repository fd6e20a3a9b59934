"""SQLite databases of agents as a Spark data source: a partition for each database and table, a row for each record as JSON."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The keys of Cursor's stores that hold conversations, and the ending of fields that hold keys for encryption.
CURSOR_PREFIXES = ("bubbleId:", "composerData:", "agentKv:", "messageRequestContext:", "checkpointId:")
CURSOR_ITEMS = ("aiService.prompts", "aiService.generations", "workbench.panel.aichat.view.aichat.chatdata", "composer.composerData")
DROPPED = "EncryptionKey"


class TablePartition(InputPartition):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table


def connect(path: str) -> sqlite3.Connection:
    """Read-only, so that rows of a write-ahead log are seen; as an immutable file only where that fails."""
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        db.execute("SELECT 1 FROM sqlite_master").fetchone()
        return db
    except sqlite3.Error:
        return sqlite3.connect(f"file:{path}?immutable=1", uri=True)


def value_of(value):
    """Bytes as text if they are, texts that are JSON as what they say."""
    if isinstance(value, bytes):
        try:
            value = value.decode()
        except UnicodeDecodeError:
            return None
    if isinstance(value, str) and value[:1] in "[{":
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]

    def partitions(self):
        out = []
        for path in self.paths:
            try:
                names = connect(path).execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")
                out += [TablePartition(path, n) for (n,) in names]
            except sqlite3.Error:
                continue
        return out or [TablePartition("", "")]

    def read(self, part):
        if not part.path:
            return
        db = connect(part.path)
        quoted = part.table.replace('"', '""')
        where = ""
        if part.table == "cursorDiskKV":
            where = " WHERE " + " OR ".join(f"key LIKE '{p}%'" for p in CURSOR_PREFIXES)
        elif part.table == "ItemTable":
            where = " WHERE key IN (" + ", ".join(f"'{k}'" for k in CURSOR_ITEMS) + ")"
        try:
            statement = f'SELECT * FROM "{quoted}"{where}'
            try:
                rows = db.execute(f"{statement} ORDER BY rowid")
            except sqlite3.Error:
                rows = db.execute(statement)  # a table without row numbers
            names = [c[0] for c in rows.description]
            for n, row in enumerate(rows, 1):
                record = {k: v for k, v in zip(names, map(value_of, row)) if v is not None}
                if not where:
                    record = {"table": part.table} | record
                elif not record.get("value"):
                    continue
                elif isinstance(record["value"], dict):
                    record["value"] = {k: v for k, v in record["value"].items() if not k.endswith(DROPPED)}
                yield part.path, part.table, n, json.dumps(record, ensure_ascii=False)
        except sqlite3.Error:
            return


class SqliteRows(DataSource):
    """spark.read.format("sqlite_rows").load("a.db"), or option("paths", a JSON list).load(): file, table, unit_no, text. Unreadable tables are left out, the others read."""

    @classmethod
    def name(cls):
        return "sqlite_rows"

    def schema(self):
        return "file string, table string, unit_no int, text string"

    def reader(self, schema):
        return SqliteReader(self.options)
