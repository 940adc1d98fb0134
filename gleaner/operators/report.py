"""Reports and summaries of findings.

``json_text`` and ``sarif_text`` build a whole report on the driver, for the console; for many findings
write ``json_lines``, ``bson`` or ``sarif_results`` from the executors.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalars import escaped, redacted, repo_url
from gleaner.operators.validate import BODY_LIMIT, status_label
from gleaner.operators.documents import write_document
from gleaner.session import checkpoint
from gleaner.sources.blobs import path_of

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def shown(findings: DataFrame, only_valid: bool = False) -> DataFrame:
    """Findings of visible rules; with ``only_valid`` those whose validation succeeded."""
    out = findings.where("visible")
    return out.where("validation_success and validation_status <> 100") if only_valid else out


def _git_metadata(origins: Column, line: Column) -> Column:
    git = F.get(F.filter(origins, lambda o: (o["kind"] == "git_repo") & o["commit"].isNotNull()), F.lit(0))
    url, commit, path = repo_url(git["repo_path"]), git["commit"], git["blob_path"]
    return F.when(
        git.isNotNull(),
        F.struct(
            url.alias("repository_url"),
            F.struct(
                commit["commit_id"].alias("id"), F.concat(url, F.lit("/commit/"), commit["commit_id"]).alias("url"),
                F.date_format(commit["committer_ts"], "yyyy-MM-dd").alias("date"),
                commit["committer_name"].alias("committer_name"), commit["committer_email"].alias("committer_email"),
            ).alias("commit"),
            F.struct(
                path.alias("path"), F.concat(url, F.lit("/blob/"), commit["commit_id"], F.lit("/"), path, F.lit("#L"), line.cast("string")).alias("url"),
                F.concat(F.lit("git -C "), git["repo_path"], F.lit(" show "), commit["commit_id"], F.lit(":"), path).alias("git_command"),
            ).alias("file"),
        ),
    )


def redact(findings: DataFrame, salt: str) -> DataFrame:
    """Findings whose secrets are replaced by a salted hash everywhere they would be shown."""
    hidden = redacted(F.col("secret"), F.lit(salt))
    out = findings.withColumns({"secret": hidden, "value": hidden.cast("binary"), "captures": F.array().cast(findings.schema["captures"].dataType), "validation_body": F.replace("validation_body", F.col("secret"), hidden)})
    return out.drop("before", "after")


def report_rows(findings: DataFrame, ordered: bool = True) -> DataFrame:
    """(id, matches) per finding, the nested shape of the JSON report; in order of path, start and rule (or with _path and start, in any order)."""
    response = F.when(
        F.octet_length("validation_body") > BODY_LIMIT, F.concat(F.substring("validation_body", 1, BODY_LIMIT), F.lit("..."))
    ).otherwise(F.col("validation_body"))
    language = F.col("language") if "language" in findings.columns else F.lit(None).cast("string")
    finding = F.struct(
        F.col("secret").alias("snippet"), F.col("fingerprint"), F.col("confidence"), F.format_string("%.2f", F.col("entropy").cast("double")).alias("entropy"),
        F.struct(status_label(F.col("validation_success"), F.col("validation_status")).alias("status"), response.alias("response")).alias("validation"),
        F.coalesce(language, F.lit("Unknown")).alias("language"), F.col("line_start").alias("line"), F.col("column_start"), F.col("column_end"),
        path_of().alias("path"), _git_metadata(F.col("origins"), F.col("line_start")).alias("git_metadata"),
    )
    if "before" in findings.columns:
        around = F.struct(F.decode("before", "UTF-8").alias("before"), F.decode("after", "UTF-8").alias("after"))
        finding = F.struct(finding.alias("f"), around.alias("context")).withField("f.context", around)["f"]
    rule = F.struct(F.col("rule_name").alias("name"), F.col("rule_id").alias("id"))
    rows = findings.select(
        F.col("rule_id").alias("id"), F.array(F.struct(rule.alias("rule"), finding.alias("finding"))).alias("matches"), path_of().alias("_path"), "start"
    )
    return rows.orderBy("_path", "start", "id").select("id", "matches") if ordered else rows


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in a column ``value`` ready for ``write.text``."""
    return report_rows(findings).select(F.to_json(F.struct("id", "matches")).alias("value"))


def write_json_lines(findings: DataFrame, path: str) -> None:
    json_lines(findings).write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str) -> None:
    """The whole report as one JSON array, in parts below ``path`` that are the document one after another (``documents.join_files`` joins them)."""
    rows = report_rows(findings, ordered=False).select(F.to_json(F.struct("id", "matches")).alias("value"), "_path", "start", "id")
    write_document(rows, ["_path", "start", "id", "value"], path, "[\n", "\n]")


def json_text(findings: DataFrame) -> str:
    """The whole report as one JSON array on the driver, for console output; empty without findings."""
    rows = [json.loads(r["value"]) for r in json_lines(findings).toLocalIterator()]
    return json.dumps(rows, indent=2, ensure_ascii=False) if rows else ""


def _bson(value: object) -> tuple[int, bytes]:
    if isinstance(value, bool):
        return 0x08, bytes([value])
    if value is None:
        return 0x0A, b""
    if isinstance(value, int):
        return (0x10, struct.pack("<i", value)) if -(2**31) <= value < 2**31 else (0x12, struct.pack("<q", value))
    if isinstance(value, float):
        return 0x01, struct.pack("<d", value)
    if isinstance(value, datetime):
        return 0x09, struct.pack("<q", int(value.timestamp() * 1000))
    if isinstance(value, str):
        raw = value.encode("utf-8")
        return 0x02, struct.pack("<i", len(raw) + 1) + raw + b"\0"
    if isinstance(value, dict):
        return 0x03, bson_document(value)
    if isinstance(value, list):
        return 0x04, bson_document({str(i): v for i, v in enumerate(value)})
    raise TypeError(f"no BSON form for {type(value).__name__}")


def bson_document(fields: dict) -> bytes:
    body = b""
    for name, value in fields.items():
        kind, raw = _bson(value)
        body += bytes([kind]) + name.encode("utf-8") + b"\0" + raw
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def bson_fields(raw: bytes, array: bool = False) -> dict | list:
    """The fields of a BSON document made by ``bson_document``."""
    out, at = {}, 4
    while raw[at]:
        kind, stop = raw[at], raw.index(b"\0", at + 1)
        name, at = raw[at + 1 : stop].decode("utf-8"), stop + 1
        if kind == 0x0A:
            value = None
        elif kind == 0x08:
            value, at = bool(raw[at]), at + 1
        elif kind in (0x01, 0x09, 0x10, 0x12):
            form = {0x01: "<d", 0x09: "<q", 0x10: "<i", 0x12: "<q"}[kind]
            value = struct.unpack_from(form, raw, at)[0]
            at += struct.calcsize(form)
        elif kind in (0x02, 0x03, 0x04):
            size = struct.unpack_from("<i", raw, at)[0]
            if kind == 0x02:
                value, at = raw[at + 4 : at + 3 + size].decode("utf-8"), at + 4 + size
            else:
                value, at = bson_fields(raw[at : at + size], kind == 0x04), at + size
        else:
            raise ValueError(f"BSON kind {kind:#x}")
        out[name] = value
    return list(out.values()) if array else out


def read_bson(documents: DataFrame) -> DataFrame:
    """BSON documents (binary ``value``) as JSON in a column ``value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": pd.Series([json.dumps(bson_fields(bytes(v))) for v in batch["value"]], dtype=object)})

    return documents.select("value").mapInPandas(run, "value string")


def bson(findings: DataFrame) -> DataFrame:
    """One BSON document per finding in a binary column ``value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [bson_document(json.loads(v)) for v in batch["value"]]})

    return json_lines(findings).mapInPandas(run, "value binary")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, rule_name, result): one SARIF result per finding, as JSON, its locations one per distinct path."""
    label = status_label(F.col("validation_success"), F.col("validation_status"), attempted_first=True)
    where = F.transform(
        F.filter("origins", lambda o: o["kind"] != "extended"),
        lambda o: F.struct(
            F.struct(
                F.struct(F.coalesce(o["path"], o["blob_path"], o["repo_path"]).alias("uri")).alias("artifactLocation"),
                F.struct(
                    F.col("line_start").alias("startLine"), F.col("column_start").alias("startColumn"), F.col("line_end").alias("endLine"),
                    F.col("column_end").alias("endColumn"), F.struct(F.col("secret").alias("text")).alias("snippet"),
                ).alias("region"),
            ).alias("physicalLocation")
        ),
    )
    message = F.concat(F.lit("Rule "), F.col("rule_name"), F.lit(" found a secret. Validation: "), label)
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.lit("review").alias("kind"), F.lit("warning").alias("level"),
        F.struct(message.alias("text")).alias("message"), F.array_distinct(where).alias("locations"),
        F.struct(F.col("fingerprint")).alias("partialFingerprints"),
        F.struct(F.col("confidence"), F.format_string("%.2f", F.col("entropy").cast("double")).alias("entropy"), label.alias("validation_status")).alias("properties"),
    )
    return findings.select("rule_id", "rule_name", F.to_json(result).alias("result"))


def sarif_text(findings: DataFrame, tool: str = "gleaner") -> str:
    """A SARIF 2.1.0 log on the driver; rules listed are those with results."""
    results, rules = [], {}
    for row in sarif_results(findings).orderBy("rule_id", "result").toLocalIterator():
        rules[row["rule_id"]] = row["rule_name"]
        results.append(json.loads(row["result"]))
    listed = [{"id": i, "name": n, "shortDescription": {"text": n}} for i, n in sorted(rules.items())]
    run = {"tool": {"driver": {"name": tool, "rules": listed}}, "results": results}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def write_sarif(findings: DataFrame, path: str, tool: str = "gleaner") -> None:
    """A SARIF 2.1.0 log as one JSON document, in parts below ``path``; rules listed are those with results (at most those of the rule files)."""
    results = checkpoint(sarif_results(findings))
    rules = results.groupBy("rule_id").agg(F.max("rule_name").alias("name")).orderBy("rule_id").collect()
    listed = [{"id": r["rule_id"], "name": r["name"], "shortDescription": {"text": r["name"]}} for r in rules]
    head = {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": listed}}, "results": []}]}
    text = json.dumps(head, ensure_ascii=False)
    write_document(results.select(F.col("result").alias("value"), "rule_id"), ["rule_id", "value"], path, text[:-4] + "\n", "\n" + text[-4:])


def pretty(findings: DataFrame) -> DataFrame:
    """One block of text per finding in a column ``value``, in order of path, start and rule."""
    label = status_label(F.col("validation_success"), F.col("validation_status"), attempted_first=True)
    line = lambda name, value: F.concat(F.lit(f" |{name:.<15}: "), value)
    attempted = F.col("validation_status") != 100
    language = F.col("language") if "language" in findings.columns else F.lit(None).cast("string")
    shown_as = lambda o: F.when(
        (o["kind"] == "git_repo") & o["commit"].isNotNull(),
        F.concat_ws(
            "\n", line("Git Repo", repo_url(o["repo_path"])), line("Commit", o["commit"]["commit_id"]),
            line("Committer", F.concat_ws(" ", o["commit"]["committer_name"], F.concat(F.lit("<"), o["commit"]["committer_email"], F.lit(">")))),
            line("Date", F.date_format(o["commit"]["committer_ts"], "yyyy-MM-dd")), line("Path", o["blob_path"]),
            line("Git Link", F.concat(repo_url(o["repo_path"]), F.lit("/blob/"), o["commit"]["commit_id"], F.lit("/"), o["blob_path"], F.lit("#L"), F.col("line_start").cast("string"))),
            line("Git Command", F.concat(F.lit("git -C "), o["repo_path"], F.lit(" show "), o["commit"]["commit_id"], F.lit(":"), o["blob_path"])),
        ),
    ).when(o["kind"] == "git_repo", line("Git Repo", repo_url(o["repo_path"]))).when(o["kind"] == "extended", line("Extended", o["extended_json"])).otherwise(line("Path", o["path"]))
    block = F.concat_ws(
        "\n", F.concat(F.upper("rule_name"), F.lit(" => ["), F.upper("rule_id"), F.lit("]")), line("Finding", escaped(F.col("secret"))),
        line("Fingerprint", F.col("fingerprint")), line("Confidence", F.col("confidence")),
        line("Entropy", F.format_string("%.2f", F.col("entropy").cast("double"))), line("Validation", label),
        F.when(attempted, line("Response", escaped(F.substring("validation_body", 1, BODY_LIMIT)))),
        line("Language", F.coalesce(language, F.lit("Unknown"))), line("Line Num", F.col("line_start").cast("string")),
        F.array_join(F.transform("origins", shown_as), "\n"),
    )
    return findings.select(block.alias("value"), path_of().alias("_p"), "start", "rule_id").orderBy("_p", "start", "rule_id").select("value")


def count_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_name").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "rule_name")


def summary(findings: DataFrame, blobs: DataFrame, per_origin: bool = False) -> DataFrame:
    """One row: findings, successes, failures (attempted and not successful), distinct blobs and their bytes.

    ``per_origin`` counts a finding once for each of its origins.
    """
    weight = F.size("origins") if per_origin else F.lit(1)
    attempted = F.col("validation_status") != 100
    of = findings.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("findings"),
        F.coalesce(F.sum(F.when(F.col("validation_success") & attempted, weight)), F.lit(0)).alias("successful"),
        F.coalesce(F.sum(F.when(~F.col("validation_success") & attempted, weight)), F.lit(0)).alias("failed"),
    )
    once = blobs.groupBy("blob_id").agg(F.max("num_bytes").alias("num_bytes"))
    return of.crossJoin(once.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes")))  # one row and one


def exit_code(findings: DataFrame) -> DataFrame:
    """0 without findings, 205 with a validated one, else 200; counts invisible ones too."""
    n, valid = F.count("*"), F.count_if(F.col("validation_success") & (F.col("validation_status") != 100))
    return findings.agg(F.when(n == 0, 0).when(valid > 0, 205).otherwise(200).alias("exit_code"))


def rule_statistics(timings: DataFrame) -> DataFrame:
    """Per rule: matches, total, mean, slowest and fastest time with the blob that took longest, slowest rules first."""
    return timings.groupBy("rule_id").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("slowest"),
        F.min("seconds").alias("fastest"), F.max_by("blob_id", F.struct("seconds", "blob_id")).alias("slowest_blob"),
    ).orderBy(F.desc("slowest"), "rule_id")
