"""Functions for Spark SQL: SELECT * FROM logs, LATERAL scan_text(text); SELECT id, inline(find_secrets(text)) FROM logs for many rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class ScanText:
    """rule_id, provider, severity_rank, masked, fingerprint, start and end of each secret in a text, worst first; each once."""

    def eval(self, text: str):
        from keysieve.functions.plain import fingerprint, mask
        from keysieve.operators.kernel import detector

        seen = set()
        for m in sorted(detector().find(text or ""), key=lambda m: (-m.rank, m.start)):
            if m.secret not in seen:
                seen.add(m.secret)
                yield m.rule.rule_id, m.rule.provider, m.rank, mask(m.secret), fingerprint(m.secret), m.start, m.end


FOUND = "array<struct<rule_id:string,provider:string,severity_rank:int,masked:string,fingerprint:string,start:int,end:int>>"


def find_secrets(rules: tuple | None = None):
    """An Arrow function of texts: what scan_text gives, as an array, a batch of rows at a time."""

    def run(texts):
        import pyarrow as pa

        from keysieve.functions.plain import fingerprint, mask
        from keysieve.operators.kernel import detector

        find, names = detector(rules).find, ("rule_id", "provider", "severity_rank", "masked", "fingerprint", "start", "end")
        kind = pa.list_(pa.struct([(n, pa.int32() if n in ("severity_rank", "start", "end") else pa.string()) for n in names]))
        out = []
        for text in texts.to_pylist():
            once = {m.secret: m for m in sorted(find(text or ""), key=lambda m: (m.rank, -m.start))}
            worst = sorted(once.values(), key=lambda m: (-m.rank, m.start))
            out.append([dict(zip(names, (m.rule.rule_id, m.rule.provider, m.rank, mask(m.secret), fingerprint(m.secret), m.start, m.end))) for m in worst])
        return pa.array(out, kind)

    return F.arrow_udf(run, FOUND)


def redact_secrets(rules: tuple | None = None):
    """An Arrow function of texts: each without its secrets, markers in their place; null stays null."""

    def run(texts):
        import pyarrow as pa

        from keysieve.functions.plain import fingerprint
        from keysieve.operators.kernel import detector

        find, out = detector(rules).find, []
        for text in texts.to_pylist():
            pieces, last = [], 0
            for m in find(text or ""):
                pieces += [text[last : m.start], f"[REDACTED:{m.rule.rule_id}:{fingerprint(m.secret)}]"]
                last = m.end
            out.append(text and "".join([*pieces, text[last:]]))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def register(spark: SparkSession) -> None:
    """scan_text as a table function (a row at a time); find_secrets and redact_secrets in Arrow batches; mask_secret, secret_fingerprint and shannon_entropy as SQL functions."""
    spark.udtf.register("scan_text", F.udtf(ScanText, returnType="rule_id string, provider string, severity_rank int, masked string, fingerprint string, start int, end int"))
    spark.udf.register("find_secrets", find_secrets())
    spark.udf.register("redact_secrets", redact_secrets())
    keep = "least(if(length(s) <= 12, 2, 6), greatest(length(s) div 4, 1))"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION secret_fingerprint(s STRING) RETURNS STRING RETURN substring(sha2(s, 256), 1, 12)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_secret(s STRING) RETURNS STRING RETURN concat(substring(s, 1, cast({keep} AS INT)), '…(', length(s), ' chars)')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(s STRING) RETURNS DOUBLE RETURN aggregate(array_distinct(filter(split(s, ''), c -> c <> '')), 0D, (a, c) -> a - size(filter(split(s, ''), x -> x = c)) / length(s) * log2(size(filter(split(s, ''), x -> x = c)) / length(s)))")
