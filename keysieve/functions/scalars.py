"""Scalar functions of credential detection as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.plans.rules import COVERED, LITERAL_WORDS, PLACEHOLDER_WORDS, SEVERITIES

#: Words in names of secrets, words that make a name public, and names of URLs that hold a password.
SECRET_WORDS = ("KEY", "APIKEY", "SECRET", "TOKEN", "PASSWORD", "PASSWD", "PASS", "PWD", "CREDENTIAL", "CREDENTIALS", "AUTH", "DSN", "WEBHOOK", "PRIVATE", "CONNECTION", "CONN")
PUBLIC_WORDS = ("PUBLIC", "PUBLISHABLE", "ANON")
URL_NAMES = ("DATABASE_URL", "REDIS_URL", "MONGODB_URI", "MONGO_URL")


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string."""
    chars, n = characters(s), F.length(s)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def is_placeholder(s: Column) -> Column:
    low = F.lower(s)
    out = F.size(F.array_distinct(characters(low))) <= 3
    for word in PLACEHOLDER_WORDS:
        out = out | low.contains(word)
    return out | low.isin(*LITERAL_WORDS)


def is_mixed(s: Column) -> Column:
    """A digit and another kind of letter, and not a path."""
    kinds = sum((s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    return (F.length(s) - F.length(F.replace(s, F.lit("/"))) < 2) & (kinds >= 2) & s.rlike("[0-9]")


def is_covered(s: Column) -> Column:
    """Starts like a credential that has a rule of its own."""
    out = F.lit(False)
    for start in COVERED:
        out = out | s.startswith(start)
    return out


def fingerprint(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 12)


def mask(s: Column) -> Column:
    """The first characters, at most a quarter, and the length."""
    n = F.length(s)
    keep = F.least(F.when(n <= 12, 2).otherwise(6), F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))
    return F.concat(F.substring(s, F.lit(1), keep), F.lit("…("), n.cast("string"), F.lit(" chars)"))


def github_checksum_ok(s: Column) -> Column:
    """The last six characters are the CRC-32 of the body in base 62."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    body = F.substring(s, F.lit(5), F.length(s) - 10)
    step = lambda acc, _: F.struct((acc["n"] / 62).cast("long").alias("n"), F.concat(F.substring(F.lit(digits), (acc["n"] % 62 + 1).cast("int"), F.lit(1)), acc["s"]).alias("s"))
    start = F.struct(F.crc32(body).cast("long").alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda acc: acc["s"]) == F.substring(s, -6, 6)


def base64url_json(part: Column) -> Column:
    """A base64url part as text, null if it isn't one."""
    padded = F.concat(F.translate(part, "-_", "+/"), F.expr("'===='").substr(F.lit(1), F.pmod(-F.length(part), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def jwt_claim(token: Column, part: int, claim: str) -> Column:
    return F.get_json_object(base64url_json(F.split(token, r"\.")[part]), f"$.{claim}")


def jwt_ok(token: Column) -> Column:
    """Three parts, a header object with alg and a payload object."""
    parts = F.split(token, r"\.")
    return (F.size(parts) == 3) & F.coalesce(jwt_claim(token, 0, "alg").isNotNull() & F.json_object_keys(base64url_json(parts[1])).isNotNull(), F.lit(False))


def json_fragment(raw: Column) -> Column:
    """A raw match as its JSON string says, if it has escapes; what isn't valid stays."""
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "$.v")
    return F.when(raw.contains("\\"), F.coalesce(decoded, raw)).otherwise(raw)


def line_of(text: Column, start: Column) -> Column:
    """Line number, from 1, of a 0-based offset."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def severity_label(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, value in SEVERITIES.items():
        out = F.when(rank == value, label).otherwise(out)
    return out


def name_words(name: Column) -> Column:
    """Upper-case words of a name in camelCase or divided by _ . -"""
    return F.split(F.upper(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_.\\-]+")


def is_secret_name(name: Column) -> Column:
    words = name_words(name)
    has = lambda few: F.arrays_overlap(words, F.array(*map(F.lit, few)))
    return ~has(PUBLIC_WORDS) & (has(SECRET_WORDS) | F.upper(name).isin(*URL_NAMES))


def marker(rule_id: Column, secret: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), rule_id, F.lit(":"), fingerprint(secret), F.lit("]"))
