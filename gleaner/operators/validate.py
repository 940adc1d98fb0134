"""Validation of findings against recorded or live responses.

Requests are rendered once per distinct secret (and the values it depends on), answered
by a table of responses or by a transport the caller supplies, judged by built-in
expressions, and joined back to every finding they stand for.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.templates import TemplateError, render
from gleaner.operators import dependencies
from gleaner.session import checkpoint
from gleaner.sources.rules import HTTP_METHODS, Rule, dependencies_table

BODY_LIMIT = 512
TTL_SECONDS = 1200
TRANSIENT = (502, 503, 504)
#: Seconds that one validation may take, its second try included, and that the connection may stand still.
DEADLINE, STILL = 30.0, 10.0
#: Headers of every HTTP request; they replace a rule's own of the same names.
STANDARD_HEADERS = {
    "User-Agent": "gleaner/1.0", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
}
Transport = Callable[[dict[str, Any]], tuple[int, dict[str, str], str]]


def looks_html(headers: Column, body: Column) -> Column:
    """By content type, or by a start that looks like markup."""
    kind = F.lower(F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit("")))
    head = F.lower(F.ltrim(F.substring(body, 1, 1024)))
    return kind.contains("text/html") | kind.contains("application/xhtml") | (head.startswith("<") & head.contains("<html"))


def _word(matcher: dict[str, Any], body: Column) -> Column:
    hits = [body.contains(w) for w in matcher.get("words") or ()]
    met = _fold(hits, bool(matcher.get("match_all_words")))
    return ~met if matcher.get("negative") else met


def _fold(conditions: Sequence[Column], every: bool) -> Column:
    out = F.lit(every)
    for c in conditions:
        out = out & c if every else out | c
    return out


def matcher_condition(matcher: dict[str, Any], status: Column, headers: Column, body: Column) -> Column:
    """One response matcher as a condition; the kind is told by its keys."""
    kind = str(matcher.get("type", ""))
    if kind == "WordMatch" or "words" in matcher:
        return _word(matcher, body)
    if kind == "StatusMatch" or "status" in matcher:
        codes = [int(c) for c in matcher.get("status") or ()]
        met = _fold([status == c for c in codes], bool(matcher.get("match_all_status")))
        return ~met if matcher.get("negative") else met
    if kind == "HeaderMatch" or "header" in matcher:
        value = F.lower(F.coalesce(F.try_element_at(headers, F.lit(str(matcher["header"]).lower())), F.lit("")))
        hits = [value.contains(str(e).lower()) for e in matcher.get("expected") or ()]
        return _fold(hits, bool(matcher.get("match_all_values")))
    if kind == "JsonValid":
        return F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))
    if kind == "XmlValid":
        return body.rlike(r"(?s)^\s*<([A-Za-z_][\w.:-]*)(?:\s[^>]*)?(?:/>|>.*</\1\s*>)\s*$|(?s)^\s*<\?xml.*>\s*$")
    return F.lit(True)


def response_matches(matchers: Sequence[dict[str, Any]], status: Column, headers: Column, body: Column, html_allowed: bool = False) -> Column:
    """Whether a response passes all its matchers; without any, whatever is not HTML passes."""
    shown = F.substring(body, 1, BODY_LIMIT)
    all_met = _fold([matcher_condition(m, status, headers, shown) for m in matchers], True)
    return all_met & (F.lit(html_allowed) | ~looks_html(headers, shown))


def status_label(success: Column, status: Column, attempted_first: bool = False) -> Column:
    """What reports call the outcome; ``attempted_first`` asks for status 100 before success."""
    active, waiting = (success, "Active Credential"), (status == 100, "Not Attempted")
    first, second = (waiting, active) if attempted_first else (active, waiting)
    return F.when(first[0], first[1]).when(second[0], second[1]).otherwise("Inactive Credential")


def template_variables(captures: Sequence[dict[str, Any]]) -> dict[str, str]:
    """Variables of a match: the whole match goes if there is more, unnamed groups are TOKEN, the last wins."""
    kept = captures[1:] if len(captures) > 1 else captures
    return {(c["name"] or "TOKEN").upper(): c["value"] for c in kept}


def request_of(rule: Rule, variables: dict[str, str]) -> dict[str, Any]:
    """The HTTP request of a rule for these variables; TemplateError if it cannot be made.

    Multipart bodies are lists of parts; the content of a file part is the path of the file.
    """
    raw = (rule.validation or {}).get("content", {}).get("request", {})
    headers = {}
    for name, value in sorted((raw.get("headers") or {}).items()):
        try:
            headers[name] = render(str(value), variables).replace("\r", "").replace("\n", "")
        except TemplateError:
            continue
    url = render(str(raw.get("url", "")), variables).strip()
    if not url.startswith(("http://", "https://")):
        raise TemplateError(f"not a URL: {url!r}")
    method = str(raw.get("method", "GET")).upper()
    if method not in HTTP_METHODS:
        raise TemplateError(f"unsupported HTTP method {method!r}")
    made = {"method": method, "url": url, "headers": headers}
    if raw.get("multipart") is not None:
        made["multipart"] = [_part(p, variables) for p in raw["multipart"].get("parts") or () if p.get("type") in PART_KINDS]
    return made


#: Kinds of parts and their content types where a rule gives none; others are left out.
PART_KINDS = {"file": "application/octet-stream", "text": "text/plain"}


def _part(part: dict[str, Any], variables: dict[str, str]) -> dict[str, str]:
    """One part of a multipart body; content that cannot be rendered is empty."""
    try:
        content = render(str(part.get("content", "")), variables)
    except TemplateError:
        content = ""
    return {"name": str(part["name"]), "type": part["type"], "content": content, "content_type": str(part.get("content_type") or PART_KINDS[part["type"]])}


def _with_files(request: dict[str, Any]) -> dict[str, Any]:
    """The request with the bytes of its file parts (none, where a file cannot be read)."""
    for part in request.get("multipart", ()):
        if part["type"] == "file":
            try:
                with open(part["content"], "rb") as file:
                    part["content"] = file.read()
            except OSError:
                part["content"] = b""
    return request


def plan_requests(matches: DataFrame, rules: Sequence[Rule], values: DataFrame | None = None, blob: str = "blob_id") -> DataFrame:
    """(rule_id, secret, extra, request_key, request, problem, problem_status): one row per distinct secret and set of variables.

    A request that cannot be made has a problem: 400 if a template or URL is at fault, 500 for anything else.

    ``values`` are dependency values (blob, rule_id, variable, value).  Secrets are grouped before any
    request is rendered, so a secret found a million times is asked about once.
    """
    return _planned(matches if values is None else with_values(matches, values, blob), rules)


def _planned(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``plan_requests`` for matches as they are, or with the values of ``with_values``."""
    by_id = {r.id: r for r in rules if r.validation and r.validation.get("type") == "Http"}
    secrets = matches.where(F.col("rule_id").isin(list(by_id)))
    if OWN not in matches.columns:
        grouped = secrets.groupBy("rule_id", "secret").agg(F.any_value("captures").alias("captures"))
        grouped = grouped.withColumn("extra", F.lit(None).cast("map<string,string>"))
    else:
        keyed = secrets.withColumn("extra_json", _as_key(F.col(OWN)))
        grouped = keyed.groupBy("rule_id", "secret", "extra_json").agg(F.any_value("captures").alias("captures"), F.any_value(OWN).alias("extra")).drop("extra_json")

    # flat columns: nested ones cost more on the way to Python and back than the rendering itself
    told = F.to_json(F.transform("captures", lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"))))
    grouped = grouped.select("rule_id", "secret", told.alias("captures"), F.to_json("extra").alias("extra"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rule_id, secret, captures, extra in zip(*(batch[c] for c in ("rule_id", "secret", "captures", "extra")), strict=True):
                given = json.loads(extra) if extra is not None else {}
                variables = template_variables([{"name": None} | c for c in json.loads(captures)]) | given
                request, problem, status = None, None, None
                try:
                    request = json.dumps(request_of(by_id[rule_id], variables), sort_keys=True)
                except TemplateError as error:
                    problem, status = str(error), 400
                except Exception as error:  # noqa: BLE001 - a rule that cannot be carried out is an outcome
                    problem, status = f"Validation failed: {error}", 500
                out.append((rule_id, secret, extra if given else None, request, problem, status))
            yield pd.DataFrame(out, columns=["rule_id", "secret", "extra", "request", "problem", "problem_status"]).astype({"problem_status": "Int32"})

    planned = grouped.mapInPandas(run, "rule_id string, secret string, extra string, request string, problem string, problem_status int")
    return planned.withColumns({"extra": F.from_json("extra", "map<string,string>"), "request_key": F.concat(F.lit("HTTP:"), F.sha1("request"))})


def http_transport(request: dict[str, Any]) -> tuple[int, dict[str, str], str]:
    """Sends a request over HTTP; redirects are followed, and a status of any kind is an answer."""
    standard = {name.lower() for name in STANDARD_HEADERS}
    body, headers = None, {n: v for n, v in request["headers"].items() if n.lower() not in standard} | STANDARD_HEADERS
    if "multipart" in request:
        border = uuid.uuid4().hex
        body = b""
        for part in request["multipart"]:
            content = part["content"] if isinstance(part["content"], bytes) else part["content"].encode("utf-8")
            name = part["name"].replace('"', "%22")
            body += f'--{border}\r\nContent-Disposition: form-data; name="{name}"\r\nContent-Type: {part["content_type"]}\r\n\r\n'.encode() + content + b"\r\n"
        body += f"--{border}--\r\n".encode()
        headers["Content-Type"] = f"multipart/form-data; boundary={border}"
    asked = urllib.request.Request(request["url"], data=body, headers=headers, method=request["method"])
    try:
        with urllib.request.urlopen(asked, timeout=STILL) as answer:  # noqa: S310 - only http and https are planned
            return answer.status, dict(answer.headers.items()), answer.read(BODY_LIMIT * 8).decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers.items()), error.read(BODY_LIMIT * 8).decode("utf-8", "replace")


def send(requests: DataFrame, transport: Transport, pause: float = 0.5, deadline: float = DEADLINE, at_once: int = 16) -> DataFrame:
    """(request_key, status, headers, body) from a live transport, on the executors, once per distinct request.

    A request is sent once more, ``2 * pause`` seconds later (two at most), after an error or a status of 502, 503 or 504;
    without an answer within ``deadline`` seconds its status is 408.  Every task has ``at_once`` requests under way.
    Its ``multipart``, where it has one, is a list of parts: name, type, content (text, or the bytes of a file), content_type.
    """

    def answer(request: str) -> tuple[int, dict[str, str], str]:
        for last in (False, True):
            try:
                status, headers, body = transport(_with_files(json.loads(request)))
            except Exception as error:  # noqa: BLE001 - any transport failure is an outcome
                status, headers, body = 502, {}, f"HTTP error: {error}"
            if last or status not in TRANSIENT:
                return status, headers, body
            time.sleep(min(2 * pause, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part = batch.iloc[at : at + at_once]
                pool = ThreadPoolExecutor(at_once)
                waiting = [pool.submit(answer, r) for r in part["request"]]
                end, out = time.monotonic() + deadline, []
                for key, future in zip(part["request_key"], waiting, strict=True):
                    try:
                        status, headers, body = future.result(max(0.0, end - time.monotonic()))
                    except Late:
                        status, headers, body = 408, {}, "Validation timed out"
                    out.append((key, status, {k.lower(): v for k, v in headers.items()}, body[:BODY_LIMIT]))
                pool.shutdown(wait=False, cancel_futures=True)  # one that hangs does not hold up the task
                yield pd.DataFrame(out, columns=["request_key", "status", "headers", "body"])

    wanted = requests.where("request is not null").select("request_key", "request").dropDuplicates(["request_key"])
    return wanted.mapInPandas(run, "request_key string, status int, headers map<string,string>, body string")


_MATCHERS = "rule_id string, html boolean, matchers array<struct<kind:string,words:array<string>,codes:array<int>,header:string,every:boolean,negative:boolean>>"


def matchers_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, html, matchers): a row for each rule with a request, its response matchers as data."""
    rows = []
    for rule in rules:
        content = (rule.validation or {}).get("content", {})
        request = content.get("request", {}) if isinstance(content, dict) else {}
        if request:
            told = [_matcher_row(m) for m in request.get("response_matcher") or ()]
            rows.append((rule.id, bool(request.get("response_is_html")), told))
    return spark.createDataFrame(rows, _MATCHERS)


def _matcher_row(matcher: dict[str, Any]) -> tuple:
    """(kind, words, codes, header, every, negative) of one matcher, whose kind is told by its keys."""
    kind, negative = str(matcher.get("type", "")), bool(matcher.get("negative"))
    if kind == "WordMatch" or "words" in matcher:
        return "word", [str(w) for w in matcher.get("words") or ()], [], "", bool(matcher.get("match_all_words")), negative
    if kind == "StatusMatch" or "status" in matcher:
        return "status", [], [int(c) for c in matcher.get("status") or ()], "", bool(matcher.get("match_all_status")), negative
    if kind == "HeaderMatch" or "header" in matcher:
        return "header", [str(e).lower() for e in matcher.get("expected") or ()], [], str(matcher["header"]).lower(), bool(matcher.get("match_all_values")), False
    return {"JsonValid": "json", "XmlValid": "xml"}.get(kind, "any"), [], [], "", True, False


def judge(requests: DataFrame, responses: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, secret, extra, success, status, body): the outcome of each planned request.

    The matchers of all rules are one table, joined by rule (its size is that of the rule files) and folded over each answer, so
    the plan does not grow with the rules.
    """
    known = F.broadcast(matchers_table(requests.sparkSession, rules))
    joined = requests.join(responses, "request_key", "left").join(known, "rule_id", "left")
    status, headers, body = F.col("status"), F.col("headers"), F.coalesce("body", F.lit(""))
    shown = F.substring(body, 1, BODY_LIMIT)
    needs = lambda kind: F.exists("matchers", lambda m: m["kind"] == kind)
    # what does not depend on the matcher is worked out once, and only where one asks for it
    whole = lambda kind: F.when(needs(kind), matcher_condition({"type": f"{kind.capitalize()}Valid"}, status, headers, shown)).otherwise(False)
    joined = joined.withColumns({"_json": whole("json"), "_xml": whole("xml"), "_body": shown})

    def among(items: Column, every: Column, hit: Callable[[Column], Column]) -> Column:
        return F.when(every, F.forall(items, hit)).otherwise(F.exists(items, hit))

    def met(m: Column) -> Column:
        value = F.lower(F.coalesce(F.try_element_at(headers, m["header"]), F.lit("")))
        found = (
            F.when(m["kind"] == "word", among(m["words"], m["every"], lambda w: F.col("_body").contains(w)))
            .when(m["kind"] == "status", among(m["codes"], m["every"], lambda c: status == c))
            .when(m["kind"] == "header", among(m["words"], m["every"], lambda w: value.contains(w)))
            .when(m["kind"] == "json", F.col("_json")).when(m["kind"] == "xml", F.col("_xml")).otherwise(True)
        )
        return F.coalesce(found != m["negative"], F.lit(False))

    success = F.forall("matchers", met) & (F.col("html") | ~looks_html(headers, F.col("_body")))
    answered = status.isNotNull()
    return joined.select(
        "rule_id", "secret", "extra",
        F.coalesce(success & answered, F.lit(False)).alias("success"),
        F.when(F.col("problem").isNotNull(), F.col("problem_status")).when(answered, status).otherwise(502).alias("status"),
        F.coalesce("problem", F.when(answered, F.col("_body")), F.lit("HTTP error: no response")).alias("body"),
    )


def value_sets(values: DataFrame, blob: str = "blob_id") -> DataFrame:
    """(blob, rule_id, extra): the dependency values of each rule in each blob as one map, the least value of a variable."""
    given = values.groupBy(blob, "rule_id", "variable").agg(F.min("value").alias("value"))
    return given.groupBy(blob, "rule_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("variable", "value")))).alias("extra"))


#: The dependency values of a match's rule in its blob.
OWN = "_own_values"


def with_values(matches: DataFrame, values: DataFrame, blob: str = "blob_id") -> DataFrame:
    """``matches`` with the dependency values of their rule in their blob as one map (null for none)."""
    return matches.join(value_sets(values, blob).withColumnRenamed("extra", OWN), [blob, "rule_id"], "left").select(*matches.columns, OWN)


def _as_key(extra: Column) -> Column:
    """A map as text, the same for equal maps; null for none."""
    return F.to_json(F.sort_array(F.map_entries(extra)))


def join_back(
    matches: DataFrame, results: DataFrame, missing: DataFrame | None = None, blob: str = "blob_id", values: DataFrame | None = None
) -> DataFrame:
    """``matches`` with the outcome of their secret; prevalidated rules succeed, missing dependencies give 428.

    With ``values`` (the dependency values that the requests were planned with) an outcome counts only where the blob holds the values it
    was asked with: a secret that is valid with one blob's account says nothing of another blob's.
    """
    return _joined_back(matches if values is None else with_values(matches, values, blob), results, missing, blob)


def _joined_back(matches: DataFrame, results: DataFrame, missing: DataFrame | None, blob: str) -> DataFrame:
    """``join_back`` for matches as they are, or with the values of ``with_values``, which are dropped."""
    order = F.struct("success", "status", "body")
    best = results.groupBy("rule_id", "secret", _as_key(F.col("extra")).alias("_extra")).agg(F.max_by(order, order).alias("_r"))
    if OWN not in matches.columns:
        best = best.groupBy("rule_id", "secret").agg(F.max_by("_r", "_r").alias("_r"))
        out = matches.join(best, ["rule_id", "secret"], "left")
    else:
        same = [F.col(f"_m.{c}") == F.col(f"_b.{c}") for c in ("rule_id", "secret")] + [_as_key(F.col(f"_m.{OWN}")).eqNullSafe(F.col("_b._extra"))]
        kept = [f"_m.{c}" for c in matches.columns if c != OWN]
        out = matches.alias("_m").join(best.alias("_b"), same, "left").select(*kept, "_b._r")
    if missing is None:
        out = out.withColumn("_lacking", F.lit(None).cast("string"))
    else:
        lacking = missing.groupBy(blob, "rule_id").agg(F.array_join(F.array_sort(F.collect_set("dep_rule_id")), ", ").alias("_lacking"))
        out = out.join(lacking, [blob, "rule_id"], "left")
    skipped = F.concat(F.lit("Validation skipped – missing dependent rules: "), "_lacking")
    case = lambda prevalidated, lacking, column, default: (
        F.when(F.col("prevalidated"), prevalidated).when(F.col("_lacking").isNotNull(), lacking).otherwise(F.coalesce(F.col(f"_r.{column}"), default))
    )
    return out.withColumns(
        {
            "validation_success": case(F.lit(True), F.lit(False), "success", F.col("validation_success")),
            "validation_status": case(F.lit(200), F.lit(428), "status", F.col("validation_status")),
            "validation_body": case(F.lit("Prevalidated"), skipped, "body", F.col("validation_body")),
        }
    ).drop("_r", "_lacking")


def still_fresh(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Cached responses that are younger than ``ttl`` seconds (column ``validated_at``)."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("validated_at") < ttl)


def validated(
    matches: DataFrame, rules: Sequence[Rule], transport: Transport | None = None, responses: DataFrame | None = None,
    cache: DataFrame | None = None, blob: str = "blob_id",
) -> DataFrame:
    """``matches`` with the outcome of every secret that can be validated.

    Requests are planned once per secret and the values it depends on; those answered by ``responses`` (request_key,
    status, headers, body) or by a fresh row of ``cache`` (the same with validated_at) are not sent, the others go to
    ``transport``.  Without a transport, requests that nothing answers stay "Not Attempted".  Rules with a validation
    of type Raw give 501; rules that lack a value they depend on 428; prevalidated ones succeed.
    """
    spark = matches.sparkSession
    needs = dependencies_table(spark, rules)
    values = dependencies.dependency_values(matches, needs, blob)
    # written once: requests are planned from it, and outcomes joined to it
    mine = checkpoint(with_values(matches, values, blob))
    requests = checkpoint(_planned(mine, rules))
    known = responses
    if cache is not None:
        fresh = still_fresh(cache, F.current_timestamp()).select("request_key", "status", "headers", "body")
        known = fresh if known is None else known.unionByName(fresh.join(known, "request_key", "left_anti"))
    if transport is not None:
        rest = requests if known is None else requests.join(known, "request_key", "left_anti")
        sent = checkpoint(send(rest, transport))
        known = sent if known is None else known.unionByName(sent)
    if known is None:
        known = spark.createDataFrame([], "request_key string, status int, headers map<string,string>, body string")
    known = known.dropDuplicates(["request_key"])
    tried = requests if transport is not None else requests.where("problem is not null").unionByName(
        requests.where("problem is null").join(known, "request_key", "left_semi").select(requests.columns)
    )
    outcomes = judge(tried, known, rules)
    raw = [r.id for r in rules if (r.validation or {}).get("type") == "Raw"]
    if raw:
        # once for each set of values, as requests are
        never = mine.where(F.col("rule_id").isin(raw)).select("rule_id", "secret", F.map_entries(OWN).alias("e")).distinct()
        outcomes = outcomes.unionByName(never.select(
            "rule_id", "secret", F.map_from_entries("e").alias("extra"), F.lit(False).alias("success"), F.lit(501).alias("status"),
            F.lit("Validation of this kind is not supported").alias("body"),
        ))
    return _joined_back(mine, outcomes, dependencies.missing_dependencies(matches, needs, blob), blob)
