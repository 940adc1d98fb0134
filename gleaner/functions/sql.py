"""Functions for SQL: ``register(spark)`` makes them known to a session.

    gleaner_entropy(binary), gleaner_fingerprint(binary, kind, start, end), gleaner_escaped(string), gleaner_aws_account(string)
    gleaner_blob_id(binary), gleaner_is_safe(string), gleaner_redacted(string, salt)
    TABLE gleaner_scan_text(string): rule_id, start, end, secret, line_start, entropy of every match in a text
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gleaner.functions import scalars as S
from gleaner.sources.rules import Rule, load_rules


def register(spark: SparkSession, rules: Sequence[Rule] | None = None) -> None:
    """Registers the functions; the table function finds ``rules`` (the built-in ones by default)."""
    spark.udf.register("gleaner_entropy", S.entropy)
    spark.udf.register("gleaner_fingerprint", S.fingerprint)
    spark.udf.register("gleaner_escaped", S.escaped)
    spark.udf.register("gleaner_aws_account", S.aws_account_number)
    pattern = "(?i)" + "|".join(f"(?:{p.replace(chr(92) + 'Z', chr(92) + 'z')})" for p in S.SAFE_LIST)
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    for head, kind, body in (
        ("gleaner_blob_id(content BINARY)", "STRING", "sha1(concat(cast('blob ' || octet_length(content) AS BINARY), unhex('00'), content))"),
        ("gleaner_is_safe(value STRING)", "BOOLEAN", f"value RLIKE '{quoted}'"),
        ("gleaner_redacted(value STRING, salt STRING)", "STRING", "'[REDACTED:' || substring(sha2(salt || value, 256), 1, 8) || ']'"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    chosen = list(load_rules() if rules is None else rules)

    class ScanText:
        def __init__(self) -> None:
            from gleaner.operators.matcher import Scanner

            self.scanner = Scanner(chosen)

        def eval(self, text: str):
            for m in self.scanner(text.encode("utf-8"), "file") if text is not None else ():
                if "problem" in m:
                    raise TimeoutError(f"{m['rule_id']}: {m['problem']}")  # a table function has no row for it
                yield m["rule_id"], m["start"], m["end"], m["secret"], m["line_start"], m["entropy"]

    shape = "rule_id string, start long, end long, secret string, line_start int, entropy float"
    spark.udtf.register("gleaner_scan_text", udtf(ScanText, returnType=shape))
