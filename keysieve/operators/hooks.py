"""Hooks in agents' settings: put in, taken out and looked up, without a loss of anything else there."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
from dataclasses import dataclass
from pathlib import Path

#: A command that is ours, however it was installed.
OURS = re.compile(r"(?:^|[\s\"'\\/])keysieve(?:\.cli|\.exe)?[\"']?\s+hook\b")
#: Comments outside strings, and commas before an end.
COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
LAST_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])')


@dataclass(frozen=True)
class Target:
    """An agent's folder and files of settings, its names of our three events, and the tools that are looked at."""

    folder: str
    user: str
    project: str
    local: str
    events: dict[str, str]
    tools: str


TARGETS = {
    "claude": Target(".claude", "settings.json", "settings.json", "settings.local.json", {"prompt": "UserPromptSubmit", "tool": "PreToolUse", "session-end": "SessionEnd"}, "Read|Grep|Bash|PowerShell|NotebookRead|mcp__.*read.*"),
    "codex": Target(".codex", "hooks.json", "hooks.json", "", {"prompt": "UserPromptSubmit", "tool": "PreToolUse", "session-end": "SessionEnd"}, "Bash|shell|local_shell|read_file|mcp__.*read.*"),
    "gemini": Target(".gemini", "settings.json", "settings.json", "", {"prompt": "BeforeAgent", "tool": "BeforeTool", "session-end": "SessionEnd"}, "read_file|read_many_files|run_shell_command|grep|search_file_content|mcp_.*read.*"),
}


def target_of(agent: str) -> Target:
    if agent not in TARGETS:
        raise ValueError(f"hooks are known for {', '.join(TARGETS)}, not {agent}")
    return TARGETS[agent]


def settings_path(agent: str, home: str, scope: str = "user", project: str = ".") -> Path:
    target = target_of(agent)
    names = {"user": target.user, "project": target.project, "local": target.local}
    if not names.get(scope):
        raise ValueError(f"{agent} has no settings of scope {scope}")
    return Path(home if scope == "user" else project, target.folder, names[scope])


def without_comments(text: str) -> str:
    """JSON with comments and last commas as plain JSON; strings stay as they are."""
    plain = COMMENT.sub(lambda m: m[1] or "", text)
    return LAST_COMMA.sub(lambda m: m[1] or "", plain)


def load(path: Path) -> dict:
    """Settings, with comments or without; none where there is no file."""
    text = path.read_text("utf-8") if path.exists() else ""
    for form in (text, without_comments(text)):
        try:
            found = json.loads(form) if form.strip() else {}
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError(f"{path} can't be read as JSON settings and was left as it is")


def save(path: Path, settings: dict) -> None:
    """At once, so that no agent reads half of it; the first version is kept beside it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    kept = path.with_name(f"{path.name}.keysieve-backup")
    if path.exists() and not kept.exists():
        shutil.copy2(path, kept)
    handle, other = tempfile.mkstemp(prefix=".keysieve-", dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(json.dumps(settings, indent=2, ensure_ascii=False) + "\n")
    if path.exists():
        shutil.copymode(path, other)
    os.replace(other, path)


def command(event: str) -> str:
    return f'"{sys.executable}" -m keysieve.cli hook {event}'


def ours(group) -> bool:
    hooks = group.get("hooks") if isinstance(group, dict) else None
    return any(isinstance(h, dict) and OURS.search(str(h.get("command", ""))) for h in hooks or ())


def wanted(agent: str) -> dict[str, dict]:
    target = target_of(agent)
    groups = {name: {"hooks": [{"type": "command", "command": command(event)}]} for event, name in target.events.items()}
    groups[target.events["tool"]]["matcher"] = target.tools
    return groups


def changed(settings: dict, groups: dict[str, dict]) -> dict:
    """settings with our groups in place of any there; without groups ours are gone, and so are lists that this leaves empty."""
    hooks = settings.get("hooks", {})
    if not isinstance(hooks, dict) or not all(isinstance(g, list) for g in hooks.values()):
        raise ValueError("the settings' hooks are not of the known form")
    others = {event: [g for g in hooks.get(event, ()) if not ours(g)] for event in {**hooks, **groups}}
    new = {event: kept + ([groups[event]] if event in groups else []) for event, kept in others.items()}
    new = {event: kept for event, kept in new.items() if kept or event not in hooks or not any(map(ours, hooks[event]))}
    out = {**settings, "hooks": new}
    if not new and "hooks" in out:
        del out["hooks"]
    return out


def put(path: Path, agent: str, groups: dict[str, dict]) -> bool:
    """Whether the file had to change."""
    before = load(path)
    after = changed(before, groups)
    if after != before:
        save(path, after)
    return after != before


def install(path: Path, agent: str) -> bool:
    return put(path, agent, wanted(agent))


def uninstall(path: Path, agent: str) -> bool:
    return put(path, agent, {})


def status(path: Path, agent: str) -> dict[str, bool]:
    """Whether each event has our hook."""
    hooks = load(path).get("hooks", {})
    return {name: any(map(ours, hooks.get(name, ()))) if isinstance(hooks, dict) else False for name in target_of(agent).events.values()}


def present(home: str) -> list[str]:
    return [agent for agent, target in TARGETS.items() if Path(home, target.folder).is_dir()]
