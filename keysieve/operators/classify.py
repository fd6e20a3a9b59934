"""What a path is: an agent's transcript, settings, a file of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transcripts in a repository by path, and the agent that writes them.
TRANSCRIPTS = (
    (r"(^|/)\.specstory/history/[^/]+\.md$", "specstory"),
    (r"(^|/)\.aider\.chat\.history\.md$", "aider"),
    (r"(^|/)\.aider\.input\.history$", "aider"),
    (r"(^|/)\.claude/.+\.jsonl$", "claude"),
    (r"(^|/)\.codex/.+\.jsonl$", "codex"),
    (r"(^|/)rollout-\d{4}-\d\d-\d\dT[\d-]+-[0-9a-f-]+\.jsonl$", "codex"),
    (r"(^|/)\.gemini/(.+/)?chats/[^/]+\.json$", "gemini"),
    (r"(^|/)\.continue/sessions/[^/]+\.json$", "continue"),
    (r"(^|/)api_conversation_history\.json$", "cline"),
    (r"(^|/)cline_task_[a-z]{3}-\d{1,2}-\d{4}[^/]*\.md$", "cline"),
)
#: Settings that are often committed on purpose.
SETTINGS = (
    r"(^|/)\.mcp\.json$",
    r"(^|/)\.claude/settings(\.local)?\.json$",
    r"(^|/)\.(cursor|vscode)/mcp\.json$",
    r"(^|/)\.(gemini|qwen)/settings\.json$",
    r"(^|/)(opencode\.jsonc?|\.crush\.json|claude_desktop_config\.json)$",
)
#: Files that hold nothing but secrets, and templates of such files.
SECRET_FILES = (
    ".env", ".env.*", "*.env", ".envrc", ".npmrc", ".pypirc", ".netrc", "_netrc", ".git-credentials",
    ".dockercfg", "credentials", "credentials.json", "*.pem", "*.key", "*.p12", "*.pfx", "*.keystore",
    "*.jks", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "*.ppk", "secrets.yml", "secrets.yaml",
    "secrets.json", ".secrets", "service-account*.json", "*.tfvars", "terraform.tfstate",
    "kubeconfig", ".kube/config", ".aws/credentials", ".docker/config.json", ".vault-token",
    ".dev.vars", "*.tfstate", "*.tfstate.backup", ".pgpass", ".my.cnf", ".htpasswd",
    ".claude/.credentials.json", ".codex/auth.json", ".gemini/oauth_creds.json", "gh/hosts.yml",
    ".config/gcloud/application_default_credentials.json", ".azure/accesstokens.json",
)
SAFE_FILES = ("*.example", "*.sample", "*.template", "*.dist", "*.defaults", "*.pub", ".env.*.example")


def glob_regex(globs: tuple[str, ...]) -> str:
    """One regular expression for lower-case paths: globs without a slash match the last part, others the last parts."""
    one = lambda g: "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c) for c in g)
    return "(^|/)(" + "|".join(map(one, globs)) + ")$"


SECRET_REGEX, SAFE_REGEX = glob_regex(SECRET_FILES), glob_regex(SAFE_FILES)


def plain_path(path: Column) -> Column:
    return F.lower(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")))


def is_secret_file(path: Column) -> Column:
    p = plain_path(path)
    return p.rlike(SECRET_REGEX) & ~p.rlike(SAFE_REGEX)


def transcript_agent(path: Column) -> Column:
    """The first that fits, or null."""
    out = F.lit(None).cast("string")
    for pattern, agent in reversed(TRANSCRIPTS):
        out = F.when(path.rlike(pattern), agent).otherwise(out)
    return out


def is_settings(path: Column) -> Column:
    return path.rlike("|".join(SETTINGS))


def kind(path: Column) -> Column:
    """jsonl, json or text by name."""
    p = F.lower(path)
    return F.when(p.endswith(".jsonl") | p.contains(".jsonl.superseded-"), "jsonl").when(p.endswith(".json"), "json").otherwise("text")


def is_database(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(db|sqlite|sqlite3|vscdb)$")
