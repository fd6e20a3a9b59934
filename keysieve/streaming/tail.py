"""Agents' log files as a stream: what is appended to line files, and other files and databases whenever they change.

The offset is a small table by file: what it was (inode, size, time), how far its lines are read, how many
they are and the bytes before that place. It is made on the driver from stat calls and a read of what was
appended's last line break; workers read the ranges, many small ones in one task. Files must be where driver
and workers both see them.
"""

from __future__ import annotations

import glob
import json
import os
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from keysieve.sources.sqlite import SqliteReader

SCHEMA = "agent string, file string, kind string, part string, unit_no int, text string, first_line string"
#: Bytes before the place read last that must not have changed, and largest range that one partition reads.
TAIL, RANGE = 64, 64 << 20
#: Bytes that opening a file counts as, and least bytes of a task that isn't the only one.
OPENING, LEAST = 16 << 10, 1 << 20
#: Seconds between searches for new files.
SEARCH_EVERY = 5.0


class Range:
    def __init__(self, agent: str, file: str, kind: str, start: int, end: int, line: int):
        self.agent, self.file, self.kind, self.start, self.end, self.line = agent, file, kind, start, end, line


class Share(InputPartition):
    """The ranges that one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def shared_out(ranges: list[Range], tasks: int) -> list[Share]:
    """Every range in one share, in order: about as many shares as tasks, none over RANGE unless it is a single range."""
    cost = [r.end - r.start + OPENING for r in ranges]
    most = min(max(LEAST, -(-sum(cost) // tasks)), RANGE)
    out, room = [], 0
    for r, c in zip(ranges, cost):
        if not out or c > room:
            out.append(Share([]))
            room = most
        out[-1].ranges.append(r)
        room -= c
    return out or [Share([])]


def is_database(path: str) -> bool:
    return path.lower().endswith((".db", ".sqlite", ".sqlite3", ".vscdb"))


def kind_of(path: str) -> str:
    low = path.lower()
    return "database" if is_database(path) else "jsonl" if low.endswith(".jsonl") or ".jsonl.superseded-" in low else "json" if low.endswith(".json") else "text"


def read_range(path: str, start: int, end: int) -> bytes:
    with open(path, "rb") as file:
        file.seek(start)
        return file.read(max(0, end - start))


def last_break(path: str, start: int, size: int) -> int:
    """Place after the last line break of a file's part; start if there is none, so half a line waits."""
    at = size
    while at > start:
        block = read_range(path, max(start, at - 65_536), at)
        if (found := block.rfind(b"\n")) >= 0:
            return at - len(block) + found + 1
        at -= len(block)
        if not block:
            break
    return start


def breaks(path: str, start: int, end: int) -> int:
    """Line breaks of a part of a file."""
    total = 0
    with open(path, "rb") as file:
        file.seek(start)
        while start < end and (block := file.read(min(end - start, 8 << 20))):
            total += block.count(b"\n")
            start += len(block)
    return total


class Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.places = json.loads(options["places"])
        self.primed = options.get("from", "latest") == "latest"
        self.every = float(options.get("search_seconds", SEARCH_EVERY))
        self.tasks = int(options.get("tasks", 8))
        self.known: list[tuple[str, str]] = []
        self.searched = 0.0
        self.state: dict[str, dict] = {}

    def found(self) -> list[tuple[str, str]]:
        """(agent, file) of all patterns, searched for anew every few seconds."""
        now = time.monotonic()
        if not self.searched or now - self.searched >= self.every:
            names = {f: a for a, patterns in self.places.items() for p in patterns for f in glob.glob(p, recursive=True, include_hidden=True) if os.path.isfile(f)}
            self.known, self.searched = sorted((a, f) for f, a in names.items()), now
        return self.known

    def look(self, state: dict[str, dict]) -> dict[str, dict]:
        """What each file is now. A line file that was replaced, cut or changed before the place read last starts again, in its next life."""
        out = {}
        for agent, path in self.found():
            try:
                stat = os.stat(path)
                was = state.get(path)
                now = {"agent": agent, "id": [stat.st_ino, stat.st_size, stat.st_mtime_ns], "at": 0, "lines": 0, "tail": "", "life": 0}
                if was and was["id"] == now["id"]:
                    out[path] = was
                    continue
                if kind_of(path) != "jsonl":
                    out[path] = now | {"at": stat.st_size, "life": was["life"] + 1 if was else 0}
                    continue
                if was:
                    tail = bytes.fromhex(was["tail"])
                    same = was["id"][0] == stat.st_ino and stat.st_size >= was["at"] and read_range(path, was["at"] - len(tail), was["at"]) == tail
                    now |= {k: was[k] for k in ("at", "lines", "life")} if same else {"life": was["life"] + 1}
                end = last_break(path, now["at"], stat.st_size)
                now["lines"] += breaks(path, now["at"], end)
                out[path] = now | {"at": end, "tail": read_range(path, max(0, end - TAIL), end).hex()}
            except OSError:
                if path in state:
                    out[path] = state[path]
        return out

    def initialOffset(self) -> dict:
        self.state = self.look({}) if self.primed else {}
        return {"files": json.dumps(self.state)}

    def latestOffset(self) -> dict:
        self.state = self.look(self.state)
        return {"files": json.dumps(self.state)}

    def partitions(self, start: dict, end: dict):
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        self.state = self.state or after
        for path, now in after.items():
            was = before.get(path)
            if was == now:
                continue
            kind = kind_of(path)
            whole = kind != "jsonl" or not was or was["life"] != now["life"]
            at, line = (0, 0) if whole else (was["at"], was["lines"])
            if kind != "jsonl":
                out.append(Range(now["agent"], path, kind, 0, now["at"], 0))
                continue
            while at < now["at"]:
                # Cut at a line break; a longer line is one range.
                cut = last_break(path, at, min(at + RANGE, now["at"]))
                cut = cut if cut > at else now["at"]
                out.append(Range(now["agent"], path, kind, at, cut, line))
                line += breaks(path, at, cut) if cut < now["at"] else 0
                at = cut
        return shared_out(out, self.tasks)

    def read(self, partition: Share):
        for part in partition.ranges:
            yield from self.rows(part)

    def rows(self, partition: Range):
        if partition.kind == "database":
            rows = SqliteReader({"path": partition.file})
            for table in rows.partitions():
                for file, name, number, text in rows.read(table):
                    yield partition.agent, file, "jsonl", name, number, text, ""
            return
        try:
            data = read_range(partition.file, partition.start, partition.end)
            first = b""
            if partition.kind == "jsonl":
                with open(partition.file, "rb") as file:
                    first = file.readline()
        except OSError:
            return
        if partition.kind != "jsonl":
            if data and b"\0" not in data[:8192]:
                yield partition.agent, partition.file, partition.kind, "", 0, data.decode("utf-8", "replace"), ""
            return
        opening = first.decode("utf-8", "replace").rstrip("\n")
        for number, line in enumerate(data.split(b"\n")[:-1], partition.line + 1):
            if line:
                yield partition.agent, partition.file, partition.kind, "", number, line.decode("utf-8", "replace"), opening

    def commit(self, end: dict) -> None:
        pass


class AgentLogs(DataSource):
    """spark.readStream.format("agent_logs").option("places", JSON of agent to patterns).load(); from "latest" (what is there already is known) or "earliest"; tasks: about how many read a large batch."""

    @classmethod
    def name(cls) -> str:
        return "agent_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Tail:
        return Tail(dict(self.options))
