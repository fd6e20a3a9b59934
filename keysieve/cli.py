"""Command line: python -m keysieve.cli scan|check|scrub|hook|guard|repo|doctor|agents|rules|ignore|watch|completions."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from datetime import UTC, datetime, timedelta

from keysieve.plans.rules import SEVERITIES, select


def since(text: str) -> str:
    """A date, or how long ago: 30m, 12h, 7d, 2w."""
    if m := re.fullmatch(r"(\d+)([mhdw])", text):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return (datetime.now(UTC) - timedelta(**{unit: int(m[1])})).strftime("%Y-%m-%dT%H:%M:%S")
    return datetime.fromisoformat(text).strftime("%Y-%m-%dT%H:%M:%S")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("keysieve")
    sub = out.add_subparsers(dest="command")
    for name in ("scan", "scrub", "doctor", "agents", "watch", "repo"):
        p = sub.add_parser(name)
        p.add_argument("--home", default=os.path.expanduser("~"))
        p.add_argument("--agent", action="append")
        p.add_argument("--path", action="append")
        p.add_argument("--rules", action="append")
        p.add_argument("--skip-rules", action="append")
        p.add_argument("--env", action="append", help="project folders whose .env values are looked for")
        p.add_argument("--min-severity", default="low", choices=[*SEVERITIES])
        p.add_argument("--since", type=since)
        p.add_argument("--ignore-file")
        p.add_argument("--format", default="text")
        p.add_argument("--output", help="folder for redacted copies (scrub) or the state (watch)")
        p.add_argument("--exit-zero", action="store_true")
        p.add_argument("--all-files", action="store_true")
        p.add_argument("--strict", action="store_true", help="repo: committed transcripts count as failures")
        p.add_argument("--github", action="store_true", help="repo: annotations, and the summary of a job's step")
        p.add_argument("--in-place", action="store_true", help="scrub: the files themselves, not copies")
        p.add_argument("--dry-run", action="store_true", help="scrub: only say what would be done")
        p.add_argument("--include-active", action="store_true", help="scrub: files in use too")
        p.add_argument("--scrub-after", type=float, help="watch: seconds that a file with a new secret must be still before it is redacted")
        p.add_argument("--notify", action="store_true", help="watch: a desktop notification for each new secret")
        p.add_argument("folder", nargs="?", default=".")
    p = sub.add_parser("check")
    p.add_argument("text", nargs="?")
    p = sub.add_parser("hook")
    p.add_argument("event", choices=("prompt", "tool", "session-end"))
    p.add_argument("--ignore-file")
    p = sub.add_parser("guard")
    p.add_argument("action", choices=("install", "uninstall", "status"))
    p.add_argument("--agent", action="append")
    p.add_argument("--home", default=os.path.expanduser("~"))
    p.add_argument("--scope", default="user", choices=("user", "project", "local"))
    p = sub.add_parser("completions")
    p.add_argument("shell", choices=("bash", "zsh", "fish"))
    sub.add_parser("rules")
    p = sub.add_parser("ignore")
    p.add_argument("fingerprint", nargs="+")
    p.add_argument("--ignore-file", required=True)
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("keysieve").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """0: clean, 1: secrets found, 2: wrong use."""
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv if argv and not argv[0].startswith("-") else ["scan", *argv])
    try:
        return COMMANDS[args.command](args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2


def run_check(args) -> int:
    from keysieve.functions.plain import fingerprint, mask
    from keysieve.operators.kernel import detector

    found = detector().find(args.text if args.text is not None else sys.stdin.read())
    for m in found:
        print(f"{m.rule.name}  {mask(m.secret)}  [{fingerprint(m.secret)}]")
    return int(bool(found))


def run_hook(args) -> int:
    from keysieve.operators.guard import decision, parsed
    from keysieve.plans.scrub import on_session_end

    given = sys.stdin.read()
    if args.event == "session-end":
        lines = open(args.ignore_file, encoding="utf-8").read().split("\n") if args.ignore_file else ()
        on_session_end(parsed(given), [x.split("#")[0].strip() for x in lines])
        return 0
    code, message = decision(args.event, given)
    if message:
        print(message, file=sys.stderr)
    return code


def run_guard(args) -> int:
    """status: 1 if a hook is missing. Without --agent those that are installed, or Claude."""
    from keysieve.operators import hooks

    agents, code = args.agent or hooks.present(args.home) or ["claude"], 0
    for agent in agents:
        path = hooks.settings_path(agent, args.home, args.scope)
        if args.action == "status":
            state = hooks.status(path, agent)
            code |= not all(state.values())
            print(f"{agent}  " + ", ".join(f"{event} {'on' if on else 'off'}" for event, on in state.items()))
        else:
            did = (hooks.install if args.action == "install" else hooks.uninstall)(path, agent)
            print(f"{agent}  {args.action} {'done' if did else 'not needed'}: {path}")
    return int(code)


def run_completions(args) -> int:
    """A script for a shell, from the parser itself."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    options = {name: sorted(o for a in p._actions for o in a.option_strings if o.startswith("--")) for name, p in commands.items()}
    if args.shell == "fish":
        print("\n".join([f"complete -c keysieve -n __fish_use_subcommand -a {n}" for n in options] + [f"complete -c keysieve -n '__fish_seen_subcommand_from {n}' -l {o[2:]}" for n, own in options.items() for o in own]))
        return 0
    cases = "\n".join(f"    {n}) words='{' '.join(own)}' ;;" for n, own in options.items())
    start = "autoload -U +X bashcompinit && bashcompinit\n" if args.shell == "zsh" else ""
    print(f"{start}_keysieve() {{\n  local words='{' '.join(options)}'\n  case ${{COMP_WORDS[1]}} in\n{cases}\n  esac\n  COMPREPLY=($(compgen -W \"$words\" -- \"${{COMP_WORDS[COMP_CWORD]}}\"))\n}}\ncomplete -F _keysieve keysieve")
    return 0


def run_rules(args) -> int:
    for r in select():
        print(f"{r.rule_id}  {r.severity}  {r.provider}  {r.name}")
    return 0


def run_ignore(args) -> int:
    from keysieve.sources.files import add_to_ignore, ignore_list

    spark = session()
    known = ignore_list(spark, args.ignore_file) if os.path.exists(args.ignore_file) else None
    add_to_ignore(spark, args.ignore_file, spark.createDataFrame([(f,) for f in args.fingerprint], "fingerprint string"), known)
    return 0


def scanned(args):
    from keysieve.plans.scan import scan
    from keysieve.sources.files import ignore_list, roots_of

    spark = session()
    ignored = ignore_list(spark, args.ignore_file) if args.ignore_file else None
    rules = select(args.rules, args.skip_rules) if args.rules or args.skip_rules else None
    return scan(spark, None if args.path and not args.agent else args.home, args.agent, args.path, rules, args.min_severity, ignored, args.since, args.env, roots_of(os.environ))


def run_scan(args) -> int:
    from keysieve.operators.reports import RENDER, about, collected

    if args.format not in RENDER:
        raise ValueError(f"unknown format {args.format}")
    result = scanned(args)
    rows = collected(result.findings)
    more = (about(result),) if args.format in ("json", "sarif") else ()
    print(RENDER[args.format](rows, *more), end="")
    return int(bool(rows) and not args.exit_zero)


def run_scrub(args) -> int:
    """Copies into a folder (--output), or the files themselves (--in-place)."""
    from keysieve.plans.scrub import scrub, scrub_in_place

    result = scanned(args)
    if args.in_place or args.dry_run:
        status = scrub_in_place(result, result.findings, None, None, args.include_active, args.dry_run or not args.in_place)
    else:
        out, status = scrub(result, result.findings, args.include_active)
        if args.output:
            out.write.mode("errorifexists").parquet(args.output)
    for r in status.collect():
        print(f"{r['file']}: {r['status']}, {r['replacements']} replaced, {r['signed']} in signed blocks")
    return 0


def run_doctor(args) -> int:
    from keysieve.plans.doctor import doctor

    rows = doctor(scanned(args), args.home, args.folder).collect()
    for r in rows:
        print(f"{r['state']}  {r['check']}: {r['text']}" + (f"  ({r['advice']})" if r["advice"] else ""))
    return int(any(r["state"] == "todo" for r in rows) and not args.exit_zero)


def run_agents(args) -> int:
    for r in scanned(args).per_agent().collect():
        print(f"{r['agent']}  {r['files']} files  {r['bytes']} bytes")
    return 0


def run_repo(args) -> int:
    """1 if a secret is committed; with --strict also if a transcript is."""
    from keysieve.operators import reports
    from keysieve.plans.scan import scan_repo
    from keysieve.sources.files import ignore_list

    spark = session()
    ignored = ignore_list(spark, args.ignore_file) if args.ignore_file else None
    result, found = scan_repo(spark, args.folder, args.all_files, args.min_severity, ignored)
    rows, transcripts = reports.collected(result.findings), sorted((r["relpath"], r["agent"]) for r in found.collect())
    root = os.path.abspath(args.folder)
    for at in (at for r in rows for at in r["locations"]):
        at["file"] = os.path.relpath(at["file"], root)
    if args.format == "sarif":
        print(reports.as_sarif(rows, reports.about(result), transcripts if args.strict else ()))
    else:
        print(reports.RENDER[args.format](rows), end="")
        print("".join(f"transcript: {path} ({agent})\n" for path, agent in transcripts[:50]), end="")
    if args.github:
        print("\n".join(reports.github_annotations(rows, transcripts if args.strict else ())))
        for name, text in (("GITHUB_STEP_SUMMARY", reports.repo_markdown(rows, transcripts)), ("GITHUB_OUTPUT", f"transcripts={len(transcripts)}\nsecrets={len(rows)}\n")):
            if os.environ.get(name):
                with open(os.environ[name], "a", encoding="utf-8") as file:
                    file.write(text)
    return int(bool(rows or args.strict and transcripts) and not args.exit_zero)


def run_watch(args) -> int:
    """Reports what is new from now on: what is in the logs already is the baseline."""
    from keysieve.sources.files import known_projects, roots_of
    from keysieve.streaming import watch

    spark = session()
    now = scanned(args)
    projects = [r["project"] for r in known_projects(now.files).toLocalIterator()]
    before = [(r["fingerprint"],) for r in now.findings.select("fingerprint").toLocalIterator()]
    baseline = spark.createDataFrame(before, "fingerprint string")
    logs = watch.agent_logs(spark, watch.places(args.home, args.agent, projects, roots_of(os.environ)))
    quiet = watch.Quiet(args.scrub_after) if args.scrub_after else None

    def report(df, _):
        new = {}
        for r in df.toLocalIterator():
            at = r["location"]
            new[at["file"]] = at["agent"]
            print(json.dumps({k: r[k] for k in ("fingerprint", "rule_id", "severity_rank", "masked")} | at.asDict()), flush=True)
            if args.notify:
                watch.notify("Secret in a log", f"{r['rule_id']} {r['masked']}")
        if quiet:
            quiet.add(new)
            for file, status, count in quiet.due():
                print(f"{file}: {status}, {count} replaced", flush=True)

    found = watch.new_findings(logs, baseline)
    found.writeStream.outputMode("append").option("checkpointLocation", args.output or f"{args.home}/.keysieve-watch").trigger(processingTime="2 seconds").foreachBatch(report).start().awaitTermination()
    return 0


COMMANDS = {"scan": run_scan, "check": run_check, "scrub": run_scrub, "hook": run_hook, "guard": run_guard, "completions": run_completions, "repo": run_repo, "doctor": run_doctor, "agents": run_agents, "rules": run_rules, "ignore": run_ignore, "watch": run_watch}

if __name__ == "__main__":
    sys.exit(main())
