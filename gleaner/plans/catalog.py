"""All queries over the driver tables, with the SQL each is checked against.

The tables hold few real credentials, so most queries use five demonstration rules for things
that do occur: tokens, e-mail addresses, dotted quads, licence lines and URLs.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.functions.regexes import re2_form
from gleaner.operators import dedup, dependencies, documents, matcher, report, validate
from gleaner.functions import sql as sql_functions
from gleaner.functions import templates
from gleaner.session import checkpoint, shared_folder
from gleaner.sources import archives
from gleaner.sources import blobs as B
from gleaner.sources import git, seen
from gleaner.sources.git import first_seen_linear
from gleaner.sources.rules import Rule, at_least, check_rules, load_rules, rules_table, select_rules
from gleaner.streaming import scan as streams
from gleaner.streaming import validity

TOKEN = Rule("demo.token", "Demo Token", r'token = "([0-9a-f]{40})"', min_entropy=3.0, confidence="high", examples=('token = "9f8e3d2c1b7a605948372615f4e3d2c19f8e3d2c"',))
EMAIL = Rule("demo.email", "Demo Email", r"[a-z0-9._]{1,40}@[a-z0-9.]{1,40}\.[a-z]{2,4}", keywords=("@",), examples=("a@example.org",))
QUAD = Rule("demo.ipv4", "Demo Address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", confidence="low", examples=("10.0.0.1",), depends_on=(("demo.email", "mail"),))
LICENSE = Rule("demo.license", "Demo License", r"Licensed under [A-Za-z0-9 .,-]{3,60}\.", visible=False, examples=("Licensed under CC BY 4.0.",))
URL = Rule("demo.url", "Demo URL", r"https?://[a-z0-9./_-]{4,80}", keywords=("http",), examples=("https://example.org/a",))
WORD = Rule("demo.word", "Demo Word", r"\b([a-z]{14,40})\b", examples=("internationalisation",))
LINK = Rule("demo.link", "Demo Link", r"(?<scheme>https?)://(?<host>[a-z0-9.]{4,60})(/[a-z0-9./_-]{1,60})?", keywords=("http",), examples=("https://example.org/a",))
RULES = [TOKEN, EMAIL, QUAD, LICENSE, URL]
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return B.from_table(docs, "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))


def _found(spark: SparkSession, sf_dir: str, rules: list[Rule] = RULES) -> DataFrame:
    """Matches in the documents, with doc_id."""
    found = matcher.scan(_doc_blobs(spark, sf_dir), rules)
    return found.withColumn("doc_id", F.substring(B.path_of(), 5, 30).cast("long"))


def _kept(spark: SparkSession, sf_dir: str, rules: list[Rule] = RULES) -> DataFrame:
    """The same, written to the shared folder: for plans that use the findings more than once, so that the texts are scanned once."""
    return checkpoint(_found(spark, sf_dir, rules))


def _flat(found: DataFrame, *more) -> DataFrame:
    return found.select("doc_id", "rule_id", "secret", "start", "end", *more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all rules in the documents, once per rule and secret, with the places they were seen."""
    # copies are merged as findings, after the scan: the contents themselves are never shuffled
    found = report.shown(matcher.scan(_doc_blobs(spark, sf_dir), at_least([*RULES, *load_rules()], "medium")))
    found = checkpoint(found)
    first = dedup.first_of_each(found, ["rule_id", "secret"], ["blob_id", "start"])
    seen = dedup.origin_rows(found, ["rule_id", "secret"]).groupBy("rule_id", "secret").agg(F.count("*").alias("seen"))
    return first.join(seen, ["rule_id", "secret"]).select(
        "rule_id", "rule_name", "secret", "confidence", "entropy", "line_start", "fingerprint", "seen"
    )


# --- SQL of the matcher: values and byte offsets from splitting around the matches ---------------------


def _sql_matches(rule: Rule, table: str = "documents", key: str = "doc_id", text: str = "text", group: int | None = None) -> str:
    pattern = re2_form(rule.pattern).replace("'", "''")
    group = (1 if "(" in rule.pattern.replace("(?", "") else 0) if group is None else group
    return f"""
SELECT {key}, '{rule.id}' AS rule_id, value AS secret,
    base + strlen(whole) * 0 + (instr(whole, value) - 1) AS start, base + (instr(whole, value) - 1) + strlen(value) AS "end",
    {key}_body AS body
FROM (SELECT {key}, {text} AS {key}_body, wholes[i] AS whole, vals[i] AS value,
        CAST(list_sum(list_transform(pieces[1:i], lambda p: strlen(p))) + coalesce(list_sum(list_transform(wholes[1:i-1], lambda p: strlen(p))), 0) AS BIGINT) AS base
      FROM (SELECT {key}, {text}, wholes, vals, pieces, unnest(range(1, len(wholes) + 1)) AS i
            FROM (SELECT {key}, {text}, regexp_extract_all({text}, '{pattern}', 0) AS wholes,
                    regexp_extract_all({text}, '{pattern}', {group}) AS vals, regexp_split_to_array({text}, '{pattern}') AS pieces
                  FROM {table} WHERE {text} IS NOT NULL) WHERE len(wholes) > 0))"""


_SQL_ENTROPY = """(SELECT -sum(c * 1.0 / n * log2(c * 1.0 / n)) FROM (SELECT count(*) AS c, any_value(n) AS n
    FROM (SELECT unnest(string_split({v}, '')) AS ch, length({v}) AS n) GROUP BY ch))"""


def _sql_found(rules: list[Rule] = RULES, **where) -> str:
    """Matches of several rules after the entropy gate (the values of the demonstration rules are ASCII)."""
    parts = " UNION ALL ".join(
        f"SELECT * FROM ({_sql_matches(r, **where)}) WHERE {_SQL_ENTROPY.format(v='secret')} > {r.min_entropy} + 1e-6" for r in rules
    )
    safe = " OR ".join(f"regexp_matches(secret, '(?i){p.replace(chr(92) + 'Z', chr(36)).replace(chr(39), chr(39) * 2)}')" for p in S.SAFE_LIST)
    return f"SELECT * FROM ({parts}) WHERE NOT ({safe})"


_RULE_ROWS = ", ".join(f"('{r.id}', '{r.name}', '{r.confidence}', {str(r.visible).lower()}, {r.min_entropy})" for r in RULES)
_RULES_SQL = f"(VALUES {_RULE_ROWS}) AS rules(rule_id, rule_name, confidence, visible, min_entropy)"
_BLOB_SQL = "sha1(concat('blob ', strlen(text), chr(0), text))"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- matching -------------------------------------------------------------------------------------------


@query(f'SELECT doc_id, rule_id, secret, start, "end" FROM ({_sql_found([TOKEN])})')
def scan_tokens(spark, sf_dir):
    return _flat(_found(spark, sf_dir, [TOKEN]))


@query(f'SELECT doc_id, rule_id, secret, start, "end" FROM ({_sql_found()})')
def scan_multi_rule(spark, sf_dir):
    return _flat(_found(spark, sf_dir))


@query(f'SELECT page_id, rule_id, secret, start, "end" FROM ({_sql_found([EMAIL, URL], table="pages", key="page_id", text="html")})')
def pages_scan(spark, sf_dir):
    pages = B.from_table(_read(spark, sf_dir, "pages"), "html", F.col("page_id").cast("string"))
    return matcher.scan(pages, [EMAIL, URL]).select(B.path_of().cast("long").alias("page_id"), "rule_id", "secret", "start", "end")


@query(f'SELECT key, rule_id, secret, start, "end" FROM ({_sql_found([EMAIL, QUAD, URL, WORD], table="(SELECT conv_id * 1000 + turn AS key, text FROM conversations)", key="key")})')
def conversation_scan(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    found = matcher.scan(B.from_table(rows, "text", F.col("key").cast("string")), [EMAIL, QUAD, URL, WORD])
    return found.select(B.path_of().cast("long").alias("key"), "rule_id", "secret", "start", "end")


_KEY_RULE = Rule("demo.k", "Demo Key", r'"k": ([0-9]{1,9})')


@query(f"""SELECT event_id, secret, {_BLOB_SQL.replace('text', 'props')} AS blob_id
FROM (SELECT event_id, props, regexp_extract(props, '"k": ([0-9]{{1,9}})', 1) AS secret FROM events) WHERE length(secret) > 1
AND {_SQL_ENTROPY.format(v='secret')} > 0 AND NOT regexp_matches(secret, '123456789')""")
def events_json_scan(spark, sf_dir):
    """JSON lines with an origin each, as the line-oriented enumerator takes them."""
    events = _read(spark, sf_dir, "events")
    lines = events.select(F.to_json(F.struct(F.col("props").alias("content"), F.struct(F.col("event_id").cast("string").alias("path")).alias("origin"))).alias("value"))
    found = matcher.scan(B.from_jsonl(lines), [_KEY_RULE])
    return found.select(B.path_of().cast("long").alias("event_id"), "secret", "blob_id")


@query()
def base64_source(spark, sf_dir):
    """The documents' contents in base64 as JSON lines, scanned for tokens."""
    docs = _read(spark, sf_dir, "documents")
    lines = docs.select(F.to_json(F.struct(F.base64(F.col("text").cast("binary")).alias("content_base64"), F.struct(F.col("doc_id").alias("path")).alias("origin"))).alias("value"))
    return matcher.scan(B.from_jsonl(lines), [TOKEN]).select(B.path_of().cast("long").alias("doc_id"), "secret", "start", "end")


SQL["base64_source"] = f'SELECT doc_id, secret, start, "end" FROM ({_sql_found([TOKEN])})'


#: SQL cannot repeat as often as the pattern of this rule may.
_IN_SQL = [r for r in load_rules() if r.id != "pem.private_key"]


@query(" UNION ALL ".join(
    f"SELECT doc_id, rule_id, '{r.name}' AS rule_name, '{r.confidence}' AS confidence, secret, start, \"end\" FROM ({_sql_found([r])})" for r in _IN_SQL
))
def builtin_pack_findings(spark, sf_dir):
    """The built-in rule pack over the documents, without fingerprints, which SQL cannot compute."""
    return _found(spark, sf_dir, _IN_SQL).select("doc_id", "rule_id", "rule_name", "confidence", "secret", "start", "end")


_LINK_RE = re2_form(LINK.pattern).replace("?<", "?P<")


@query(f"""SELECT page_id, name, value FROM (SELECT page_id, unnest(['scheme', 'host']) AS name, unnest([regexp_extract(w, '{_LINK_RE}', 1), regexp_extract(w, '{_LINK_RE}', 2)]) AS value
FROM (SELECT page_id, unnest(regexp_extract_all(url, '{_LINK_RE}', 0)) AS w FROM pages))""")
def named_captures(spark, sf_dir):
    """The named groups of every match in the addresses of the pages."""
    pages = B.from_table(_read(spark, sf_dir, "pages"), "url", F.col("page_id").cast("string"))
    found = matcher.scan(pages, [LINK]).select(B.path_of().cast("long").alias("page_id"), F.explode("captures").alias("c"))
    return found.where("c.match_number = -1").select("page_id", "c.name", "c.value")


@query(f"""SELECT doc_id, start, CAST(CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) & 9223372036854775807 AS VARCHAR) AS finding_id FROM (SELECT doc_id, start, sha1(concat(
'{TOKEN.sha1}', chr(0), '{{"captures":[{{"name":null,"match_number":0,"start":', start - 9, ',"end":', "end" + 1, ',"value":"token = \\"', secret, '\\""}},{{"name":null,"match_number":1,"start":', start, ',"end":', "end",
',"value":"', secret, '"}}]}}')) AS h FROM ({_sql_found([TOKEN])}))""")
def finding_ids(spark, sf_dir):
    return _found(spark, sf_dir, [TOKEN]).select("doc_id", "start", S.finding_id(F.col("rule_sha1"), F.col("captures")).alias("finding_id"))


@query(f"""SELECT doc_id, secret, start, "end", 1 + length(b) - length(replace(b, chr(10), '')) AS "line"
FROM (SELECT *, CASE WHEN start = 0 THEN '' ELSE decode(encode(body)[1:start]) END AS b FROM ({_sql_found([TOKEN, EMAIL])}))""")
def archive_kinds_scan(spark, sf_dir):
    """The documents as members of four kinds of archives: gz, tar.gz, a zip within a tar, and a zip in pieces of a thousand bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tar(name: str, data: bytes, mode: str) -> bytes:
            file, info = io.BytesIO(), tarfile.TarInfo(name)
            info.size = len(data)
            with tarfile.open(fileobj=file, mode=mode) as archive:
                archive.addfile(info, io.BytesIO(data))
            return file.getvalue()

        def zipped(name: str, data: bytes) -> bytes:
            file = io.BytesIO()
            with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(name, data)
            return file.getvalue()

        def packed(doc_id: int, text: str) -> tuple[str, bytes]:
            raw, name = text.encode("utf-8"), f"{doc_id}.txt"
            make = (
                ("gz", lambda: gzip.compress(raw)), ("tar.gz", lambda: tar(name, raw, "w:gz")), ("tar", lambda: tar("inner.zip", zipped(name, raw), "w")), ("zip", lambda: zipped(name, raw)),
            )
            kind, data = make[doc_id % 4]
            return f"{doc_id}.{kind}", data()

        yield from archives.in_batches(packed(*row) for batch in batches for row in zip(batch["doc_id"], batch["text"], strict=True))

    packed = _read(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    members = archives.expand(B.from_table(packed, "content", F.col("path")), piece=8000)
    found = archives.joined(matcher.scan(members, [TOKEN, EMAIL]), 4000)
    return found.select(F.regexp_extract(B.path_of(), r"^([0-9]+)\.", 1).cast("long").alias("doc_id"), "secret", "start", "end", F.col("line_start").cast("long").alias("line"))


@query(f'SELECT doc_id, secret, start, "end" FROM ({_sql_found([TOKEN, EMAIL])})')
def archive_scan(spark, sf_dir):
    """The documents as members of zip archives, one of each, expanded and scanned."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(doc_id: int, text: str) -> tuple[str, bytes]:
            file = io.BytesIO()
            with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{doc_id}.txt", text.encode("utf-8"))
            return f"{doc_id}.zip", file.getvalue()

        yield from archives.in_batches(packed(*row) for batch in batches for row in zip(batch["doc_id"], batch["text"], strict=True))

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    packed = B.from_table(docs.mapInPandas(pack, "path string, content binary"), "content", F.col("path"))
    found = matcher.scan(archives.expand(packed), [TOKEN, EMAIL])
    return found.select(F.regexp_extract(B.path_of(), r"!(\d+)\.txt$", 1).cast("long").alias("doc_id"), "secret", "start", "end")


@query(f"SELECT {_BLOB_SQL} AS blob_id, any_value(strlen(text)) AS num_bytes, list_sort(list(concat('doc/', doc_id))) AS paths FROM documents WHERE text IS NOT NULL GROUP BY 1")
def distinct_blobs(spark, sf_dir):
    """Identical contents as one blob with the places of all."""
    one = B.distinct_blobs(_doc_blobs(spark, sf_dir))
    return one.select("blob_id", "num_bytes", F.array_sort(F.transform("origins", lambda o: o["path"])).alias("paths"))


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_BLOB_SQL} NOT IN (SELECT {_BLOB_SQL} FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def unseen_blobs(spark, sf_dir):
    """Blobs that an earlier run, over every third document, has not seen: by its sketch, and its keys where that speaks for them."""
    blobs = _doc_blobs(spark, sf_dir)
    doc = F.substring(B.path_of(), 5, 30).cast("long")
    store = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    seen.record(blobs.where(doc % 3 == 0), "blob_id", store, "first")
    return seen.unseen(blobs.select("blob_id", doc.alias("doc_id")), "blob_id", store).select("doc_id")


@query("""WITH d AS (SELECT event_id, user_id * 1000 + event_id % 17 AS k, event_id % 4 AS part FROM events)
SELECT event_id, part FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.k = a.k AND b.part < a.part)""")
def unseen_over_runs(spark, sf_dir):
    """Four runs over the events, each with the keys that none before it has seen."""
    events = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 1000 + F.col("event_id") % 17).alias("k"), (F.col("event_id") % 4).alias("part"))
    store, out = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}", None
    for run in range(4):
        own = events.where(F.col("part") == run)
        new = seen.unseen(own, "k", store) if run else own
        out = new if out is None else out.unionByName(new)
        if run == 0:
            seen.record(own, "k", store, "0")
        else:
            # the runs before are told apart by their part, so what this one reads does not change
            out = checkpoint(out)
            seen.record(own, "k", store, str(run))
    return out.select("event_id", "part")


def _sql_condition(rule: Rule) -> str:
    """The literals that a rule's matches hold, one of each clause."""
    quoted = lambda k: k.replace("'", "''")
    return " AND ".join("(" + " OR ".join(f"contains(t, '{quoted(k)}')" for k in clause) + ")" for clause in rule.clauses)


@query("WITH d AS (SELECT lower(text) AS t, text FROM documents) " + " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, count(DISTINCT {_BLOB_SQL}) AS blobs, count(*) AS calls FROM d WHERE {_sql_condition(r)} HAVING count(*) > 0" for r in [*RULES, *load_rules()] if r.clauses
))
def rule_calls(spark, sf_dir):
    """In how many contents the pattern of each rule with known literals was run, from the timings of a scan with the built-in pack."""
    times = checkpoint(matcher.timings(_doc_blobs(spark, sf_dir), [r for r in [*RULES, *load_rules()] if r.clauses]))
    calls = report.rule_statistics(times).select("rule_id", "calls")
    return times.groupBy("rule_id").agg(F.count_distinct("blob_id").alias("blobs")).join(calls, "rule_id")


_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "nt", "ea", "st", "ou")
#: 250 rules whose matches hold one of two words and a third.
_PACK = [
    Rule(f"many.{i}", f"Many {i}", f"(?i)(?:{a}{b}{a}|{b}{c}ing)[a-z]*[ ,.]+[a-z ,.]{{0,40}}?{c}{a}{b}", min_entropy=-1.0)
    for i in range(250) for a, b, c in [(_SYLLABLES[i % 17], _SYLLABLES[i // 17 % 17], _SYLLABLES[(5 * i + 3) % 17])]
]


@query("WITH d AS (SELECT lower(text) AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, count(*) AS calls FROM d WHERE {_sql_condition(r)} HAVING count(*) > 0" for r in _PACK
))
def rule_conditions(spark, sf_dir):
    """A pack of 250 rules: how many contents meet each rule's condition over literals, all conditions worked out in one pass."""
    times = matcher.timings(_doc_blobs(spark, sf_dir), _PACK)
    return times.groupBy("rule_id").agg(F.count("*").alias("calls"))


@query("""SELECT window_start, count(*) AS findings, count(DISTINCT secret) AS secrets FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start,
regexp_extract(props, '"k": ([0-9]{1,9})', 1) AS secret FROM events) WHERE secret <> '' AND length(list_distinct(string_split(secret, ''))) > 1 GROUP BY 1""")
def stream_scan(spark, sf_dir):
    """The events as a stream, scanned and written exactly once, then counted in windows."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{folder}/in"  # a stream of files is read from a folder
    events = _read(spark, sf_dir, "events")
    # two batches, each of enough files for all cores
    files = max(2, spark.sparkContext.defaultParallelism)
    events.repartition(2 * files).write.parquet(source)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source).withColumn("seen", F.col("ts").cast("timestamp"))
    found = matcher.scan(streams.table_stream(rows, "props", "seen", "event_id"), [_KEY_RULE])
    streams.write_findings(found, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    window = F.window("seen_at", "10 minutes").start.cast("timestamp_ntz")
    return done.groupBy(window.alias("window_start")).agg(F.count("*").alias("findings"), F.count_distinct("secret").alias("secrets"))


@query("""SELECT page_id, base64(encode(url)) AS b64, sha256(url) AS hash, url_encode(url) AS pct, upper(replace(url, '/', '-')) AS mixed FROM pages""")
def template_filters(spark, sf_dir):
    """Request templates over a column."""
    forms = {"b64": "{{ URL | b64enc }}", "hash": "{{ URL | sha256 }}", "mixed": "{{ URL | replace: '/', '-' | upcase }}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = {k: [templates.render(t, {"URL": u}) for u in batch["url"]] for k, t in forms.items()}
            # everything but letters and digits is escaped; plain URL encoding leaves four signs
            made["pct"] = [templates.render("{{ URL | url_encode }}", {"URL": u}).replace("%2D", "-").replace("%5F", "_").replace("%2E", ".").replace("%7E", "~") for u in batch["url"]]
            yield pd.DataFrame({"page_id": batch["page_id"], **{k: pd.Series(v, dtype=object) for k, v in made.items()}})

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.mapInPandas(run, "page_id long, b64 string, hash string, mixed string, pct string")


@query(r"""SELECT page_id FROM pages WHERE NOT ((regexp_matches(url, '(^|/)[^/]*[78][^/]*(/|$)') AND NOT regexp_matches(url, '(^|/)en(/|$)')) OR regexp_matches(url, '^http://[^/]*/fr(/|$)'))""")
def ignore_list(spark, sf_dir):
    """An ignore list with a class, a line that keeps what an earlier one leaves out, and an anchored line."""
    pages = _read(spark, sf_dir, "pages")
    return pages.where(~B.ignored(F.col("url"), ["*[78]*", "!en", "/http:/*/*/fr"])).select("page_id")


@query()
def builtin_pack(spark, sf_dir):
    """The whole built-in rule pack over the documents."""
    return _flat(_found(spark, sf_dir, load_rules()), "rule_name", "confidence", "fingerprint")


# --- scalars ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_BLOB_SQL} AS blob_id, strlen(text) AS num_bytes FROM documents WHERE text IS NOT NULL")
def blob_ids(spark, sf_dir):
    blobs = _doc_blobs(spark, sf_dir)
    return blobs.select(F.substring(B.path_of(), 5, 30).cast("long").alias("doc_id"), "blob_id", "num_bytes")


@query(f"SELECT {_BLOB_SQL} AS blob_id, count(*) AS appearances, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedup(spark, sf_dir):
    blobs = _doc_blobs(spark, sf_dir)
    doc = F.substring(B.path_of(), 5, 30).cast("long")
    return blobs.groupBy("blob_id").agg(F.count("*").alias("appearances"), F.min(doc).alias("first_doc"))


@query(f"SELECT doc_id, secret, round({_SQL_ENTROPY.format(v='secret')}, 3) AS entropy FROM ({_sql_found([TOKEN, EMAIL])})")
def entropy_values(spark, sf_dir):
    found = _found(spark, sf_dir, [TOKEN, EMAIL])
    return found.select("doc_id", "secret", F.round(F.col("entropy").cast("double"), 3).alias("entropy"))


@query(f"SELECT doc_id, secret FROM ({_sql_found([replace(r, min_entropy=3.2) for r in (TOKEN, EMAIL, URL)])})")
def entropy_gate(spark, sf_dir):
    return _found(spark, sf_dir, [replace(r, min_entropy=3.2) for r in (TOKEN, EMAIL, URL)]).select("doc_id", "secret")


_SAFE_SQL = " OR ".join(f"regexp_matches(line, '(?i){p.replace(chr(92) + 'Z', chr(36)).replace(chr(39), chr(39) * 2)}')" for p in S.SAFE_LIST)


@query(f"""SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE contains(line, 'token') AND NOT ({_SAFE_SQL})""")
def safe_list_filter(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.where(F.col("line").contains("token") & ~S.safe_listed(F.col("line")))


@query(f"""SELECT doc_id, rule_id, start, 1 + length(b) - length(replace(b, chr(10), '')) AS line_start,
    strlen(b) - coalesce(strlen(b) - strlen(list_last(string_split(b, chr(10)))), 0) AS column_start
FROM (SELECT doc_id, rule_id, start, CASE WHEN start = 0 THEN '' ELSE decode(encode(body)[1:start]) END AS b FROM ({_sql_found([TOKEN, EMAIL, LICENSE])}))""")
def source_location(spark, sf_dir):
    found = _found(spark, sf_dir, [TOKEN, EMAIL, LICENSE])
    return found.select("doc_id", "rule_id", "start", F.col("line_start").cast("long").alias("line_start"), F.col("column_start").cast("long").alias("column_start"))


@query("""SELECT doc_id, contains(left(text, 1024), chr(0)) OR starts_with(text, '%PDF') AS binary FROM documents WHERE text IS NOT NULL""")
def binary_sniff(spark, sf_dir):
    blobs = _doc_blobs(spark, sf_dir)
    return blobs.select(F.substring(B.path_of(), 5, 30).cast("long").alias("doc_id"), S.looks_binary(F.col("content")).alias("binary"))


@query("SELECT doc_id FROM documents WHERE strlen(text) <= 1048")
def size_filter(spark, sf_dir):
    kept = B.keep(_doc_blobs(spark, sf_dir), max_mb=0.001)
    return kept.select(F.substring(B.path_of(), 5, 30).cast("long").alias("doc_id"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/[^/]*7[^/]*(/|$)')")
def ignore_paths(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return pages.where(~B.ignored(F.col("url"), ["# numbers", "*7*"])).select("page_id")


@query("""SELECT page_id, CASE lower(regexp_extract(url, '[^/]\\.([^./]*)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'txt' THEN 'text/plain'
    WHEN 'json' THEN 'application/json' WHEN 'xml' THEN 'application/xml' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
    CASE WHEN contains(html, 'public class') THEN 'Java' ELSE NULL END AS language, 'UTF-8' AS charset FROM pages""")
def mime_language(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return pages.select(
        "page_id", S.mime_type(F.col("url")).alias("mime"), S.language(F.col("url"), F.col("html")).alias("language"),
        S.charset(F.col("html").cast("binary")).alias("charset"),
    )


@query("""SELECT doc_id, token, octet_length(from_base64(token)) AS decoded FROM
(SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{12,}={0,2}')) AS token FROM documents) WHERE length(token) % 4 = 0""")
def base64_candidates(spark, sf_dir):
    tokens = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{12,}={0,2}"), 0)).alias("token"))
    good = tokens.where(S.is_base64(F.col("token")))
    return good.select("doc_id", "token", F.octet_length(F.unbase64("token")).cast("long").alias("decoded"))


@query(f"SELECT doc_id, secret, concat('[REDACTED:', left(sha256(concat('salt', secret)), 8), ']') AS shown FROM ({_sql_found([TOKEN, EMAIL])})")
def redact(spark, sf_dir):
    return _found(spark, sf_dir, [TOKEN, EMAIL]).select("doc_id", "secret", S.redacted(F.col("secret"), F.lit("salt")).alias("shown"))


@query()
def fingerprints(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "rule_id", "start", "end", "fingerprint")


# --- deduplication and merging -------------------------------------------------------------------------------


@query(f'SELECT rule_id, secret, min(doc_id) AS doc_id FROM ({_sql_found()}) GROUP BY ALL')
def dedup_secret(spark, sf_dir):
    found = _found(spark, sf_dir).withColumn("kind", F.lit("file"))
    return dedup.first_per_secret(found, [F.col("doc_id"), F.col("start")]).select("rule_id", "secret", "doc_id")


@query(f'SELECT secret, start, "end", count(DISTINCT doc_id) AS origins, min(doc_id) AS first_doc FROM ({_sql_found()}) GROUP BY secret, start, "end"')
def dedup_fingerprint_origins(spark, sf_dir):
    found = _kept(spark, sf_dir)
    merged = dedup.merge_origins(found, ["fingerprint"], ["doc_id", "rule_id"])
    return merged.select("secret", "start", "end", F.size("origins").cast("long").alias("origins"), F.col("doc_id").alias("first_doc"))


@query(f"""SELECT doc_id, rule_id, start, round({_SQL_ENTROPY.format(v='secret')}, 3) AS entropy, {_BLOB_SQL.replace('text', 'body')} AS blob_id, false AS safe,
concat('[REDACTED:', left(sha256(concat('salt', secret)), 8), ']') AS shown FROM ({_sql_found([TOKEN, EMAIL])})""")
def sql_scan(spark, sf_dir):
    """A scan in SQL, by the registered functions and the table function."""
    sql_functions.register(spark, [TOKEN, EMAIL])
    found = spark.sql(
        "SELECT doc_id, s.rule_id, s.start, gleaner_entropy(cast(s.secret AS BINARY)) AS e, gleaner_blob_id(cast(text AS BINARY)) AS blob_id, "
        "gleaner_is_safe(s.secret) AS safe, gleaner_redacted(s.secret, 'salt') AS shown FROM {docs} d, LATERAL gleaner_scan_text(d.text) s",
        docs=_read(spark, sf_dir, "documents"),
    )
    return found.select("doc_id", "rule_id", "start", F.round(F.col("e").cast("double"), 3).alias("entropy"), "blob_id", "safe", "shown")


@query(f"SELECT DISTINCT secret, start, concat('doc/', doc_id) AS path FROM ({_sql_found()})")
def no_dedup_explode(spark, sf_dir):
    rows = dedup.origin_rows(_found(spark, sf_dir), ["fingerprint", "secret", "start"])
    return rows.select("secret", "start", F.col("origin.path").alias("path"))


@query(f"""SELECT doc_id, rule_id, start, "end", EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end"
    AND (b.start, b."end") <> (a.start, a."end")) AS contained FROM f a""".join(["WITH f AS (" + _sql_found([EMAIL, QUAD, URL]) + ") ", ""]))
def overlap_containment(spark, sf_dir):
    found = _found(spark, sf_dir, [EMAIL, QUAD, URL]).select("doc_id", "rule_id", "start", "end")
    return dedup.inside_another(found, ["doc_id"])


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM i b WHERE b.l_suppkey = a.l_suppkey AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.k < a.k)) AS contained FROM i a""")
def span_containment(spark, sf_dir):
    """Containment over many spans: line items as intervals of parts, per supplier."""
    items = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )
    return dedup.inside_another(items, ["l_suppkey"], tie=["k"]).select("l_orderkey", "l_linenumber", "contained")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 = 0 AS g, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
o AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i)
SELECT l_orderkey, l_linenumber, coalesce(far >= e, FALSE) AS contained FROM o""")
def span_containment_hot(spark, sf_dir):
    """Containment with two keys for all line items, one of which has nearly all: cut into slices, the farthest end carried over."""
    items = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50 == 0).alias("g"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )
    return dedup.inside_another(items, ["g"], tie=["k"], least=1000).select("l_orderkey", "l_linenumber", "contained")


_COMMITS = "(SELECT o_orderkey AS commit_id, o_orderdate AS topo, o_custkey AS blob_id FROM orders)"


@query(f"SELECT blob_id, commit_id FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY topo, commit_id) AS r FROM {_COMMITS}) WHERE r = 1")
def first_seen(spark, sf_dir):
    """First-seen commit over a line of history (orders as commits, customers as blobs)."""
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("topo"), F.col("o_custkey").alias("blob_id"), F.lit("f").alias("path")
    )
    return first_seen_linear(orders).select("blob_id", "commit_id")


_HISTORY_SQL = """n AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
edges AS (SELECT a.id, b.id AS parent FROM n a JOIN n b ON a.c = b.c AND (b.r = a.r - 1 - (a.r % 2) OR (a.r % 5 = 0 AND b.r = a.r - 1)))"""


@query(f"""WITH RECURSIVE {_HISTORY_SQL}, up AS (SELECT id, parent FROM edges UNION SELECT up.id, e.parent FROM up JOIN edges e ON e.id = up.parent)
SELECT id AS commit_id, c || '/' || p AS blob_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM up JOIN n b ON b.id = up.parent WHERE up.id = a.id AND b.c = a.c AND b.p = a.p)""")
def history_first_seen(spark, sf_dir):
    """First-seen commits over branching histories: the orders of a customer as commits with branches and merges, priorities as blobs."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = checkpoint(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.row_number().over(order).alias("r")))
    at = lambda back: F.lag("o_orderkey", back).over(order).cast("string")
    first = F.when(F.col("r") % 2 == 1, at(2)).otherwise(at(1))
    parents = F.array_distinct(F.array_compact(F.array(first, F.when(F.col("r") % 5 == 0, at(1)))))
    commits = n.select(F.col("o_orderkey").cast("string").alias("commit_id"), parents.alias("parents"), F.col("o_orderkey").alias("topo"), "o_custkey")
    changes = n.select(F.col("o_orderkey").cast("string").alias("commit_id"), F.lit("f").alias("path"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("blob_id"))
    return git.first_seen(commits, changes, within="o_custkey").select(F.col("commit_id").cast("long").alias("commit_id"), "blob_id")


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey AS blob_id, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT id AS commit_id, blob_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.blob_id = a.blob_id AND b.r < a.r AND
CASE WHEN b.r % 10 <> 0 THEN TRUE ELSE b.r % 30 <> 0 AND b.r + 5 <= a.r - CASE WHEN a.r % 10 = 0 THEN 1 ELSE 0 END END)""")
def history_deep_first_seen(spark, sf_dir):
    """One history as deep as there are orders: every tenth order is a branch of one commit, merged five commits later or (every thirtieth) never; customers as blobs."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # numbered by ranges of keys, so that no task orders all rows
    ranged = checkpoint(orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    before = {r["part"]: sum(x["n"] for x in sizes if x["part"] < r["part"]) for r in sizes}
    starts = F.create_map(*(F.lit(v) for item in before.items() for v in item))
    n = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")) + starts[F.col("part")])
    n = checkpoint(n.select(F.col("o_orderkey").cast("string").alias("commit_id"), F.col("o_custkey").cast("string").alias("blob_id"), F.col("r").cast("long").alias("topo")))
    r = F.col("topo")
    # the commit before on the line, and the branch that is merged here
    line = F.when(r % 10 == 1, r - 2).otherwise(r - 1)
    wanted = F.array(line, F.when((r % 10 == 5) & ((r - 5) % 30 != 0), r - 5))
    links = n.select("commit_id", "topo", F.posexplode(F.array_compact(wanted)).alias("k", "at"))
    named = links.join(n.select(F.col("commit_id").alias("parent"), F.col("topo").alias("at")), "at")
    parents = named.groupBy("commit_id").agg(F.sort_array(F.collect_list(F.struct("k", "parent"))).alias("p")).select("commit_id", F.col("p.parent").alias("parents"))
    commits = n.select("commit_id", "topo").join(parents, "commit_id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    changes = n.select("commit_id", F.lit("f").alias("path"), "blob_id")
    return git.first_seen(commits, changes, block=4096).select(F.col("commit_id").cast("long").alias("commit_id"), F.col("blob_id").cast("long").alias("blob_id"))


# --- dependencies ------------------------------------------------------------------------------------------------


def _dependencies(spark: SparkSession) -> DataFrame:
    rows = [("demo.ipv4", "demo.email", "mail"), ("demo.token", "demo.license", "terms")]
    return spark.createDataFrame(rows, "rule_id string, dep_rule_id string, variable string")


_DEPS_SQL = "(VALUES ('demo.ipv4', 'demo.email', 'MAIL'), ('demo.token', 'demo.license', 'TERMS')) AS d(rule_id, dep_rule_id, variable)"


@query(f"""WITH f AS ({_sql_found()}) SELECT n.doc_id, n.rule_id, d.variable, g.secret AS value, g.start
FROM (SELECT DISTINCT doc_id, rule_id FROM f) n JOIN {_DEPS_SQL} USING (rule_id) JOIN f g ON g.doc_id = n.doc_id AND g.rule_id = d.dep_rule_id""")
def dependency_join(spark, sf_dir):
    got = dependencies.dependency_values(_kept(spark, sf_dir), _dependencies(spark), blob="doc_id")
    return got.select("doc_id", "rule_id", "variable", "value", "start")


@query(f"""WITH f AS ({_sql_found()}) SELECT n.doc_id, n.rule_id, d.dep_rule_id FROM (SELECT DISTINCT doc_id, rule_id FROM f) n
JOIN {_DEPS_SQL} USING (rule_id) WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = n.doc_id AND g.rule_id = d.dep_rule_id)""")
def missing_dependency(spark, sf_dir):
    return dependencies.missing_dependencies(_kept(spark, sf_dir), _dependencies(spark), blob="doc_id")


@query(f"""WITH f AS ({_sql_found()}) SELECT doc_id, rule_id, start, doc_id IN (SELECT doc_id FROM f WHERE rule_id IN ('demo.ipv4', 'demo.token')) AS dependent FROM f""")
def dependent_blobs(spark, sf_dir):
    found = _kept(spark, sf_dir)
    simple, dependent = dependencies.split_phases(found, _dependencies(spark), blob="doc_id")
    label = lambda df, v: df.select("doc_id", "rule_id", "start", F.lit(v).alias("dependent"))
    return label(simple, False).unionByName(label(dependent, True))


@query("""SELECT order_id, event_id FROM (SELECT a.event_id AS order_id, b.event_id, row_number() OVER (PARTITION BY a.event_id
ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), epoch_us(b.ts), b.event_id) AS r FROM events a JOIN
(SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b
ON a.user_id = b.user_id WHERE a.event_type = 'purchase') WHERE r = 1""")
def nearest_variable(spark, sf_dir):
    """The nearest value to each target, in either direction (clicks of a user around each purchase)."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    targets = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("order_id"), F.col("at").alias("end"))
    values = events.where("event_type = 'click'").select("user_id", F.col("at").alias("start"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("value"))
    near = dependencies.nearest_value(targets, values, blob="user_id")
    return near.select("order_id", F.col("value").cast("long").alias("event_id"))


@query("""SELECT order_id, event_id FROM (SELECT a.event_id AS order_id, b.event_id, row_number() OVER (PARTITION BY a.event_id
ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), epoch_us(b.ts), b.event_id) AS r FROM events a JOIN
(SELECT user_id % 10 = 0 AS g, ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, ts) b
ON (a.user_id % 10 = 0) = b.g WHERE a.event_type = 'purchase') WHERE r = 1""")
def nearest_variable_hot(spark, sf_dir):
    """The nearest value with two keys for all events, one of which has nine tenths: cut into slices, values carried over in both directions."""
    events = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10 == 0).alias("g"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    targets = events.where("event_type = 'purchase'").select("g", F.col("event_id").alias("order_id"), F.col("at").alias("end"))
    values = events.where("event_type = 'click'").select("g", F.col("at").alias("start"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("value"))
    near = dependencies.nearest_value(targets, values, blob="g", least=500)
    return near.select("order_id", F.col("value").cast("long").alias("event_id"))


# --- validation ----------------------------------------------------------------------------------------------------


def _probed(spark: SparkSession, sf_dir: str) -> tuple[list[Rule], DataFrame]:
    request = {"method": "GET", "url": "https://api.invalid/check?t={{ TOKEN | sha256 }}", "headers": {"X-Token": "{{ TOKEN }}"}}
    matchers = [{"type": "StatusMatch", "status": [200]}, {"type": "WordMatch", "words": ['"ok"']}]
    rule = replace(TOKEN, validation={"type": "Http", "content": {"request": {**request, "response_matcher": matchers}}})
    return [rule, EMAIL], _kept(spark, sf_dir, [rule, EMAIL])


def _answers(requests: DataFrame) -> DataFrame:
    """Recorded responses made from the secrets: those that begin with a digit are good."""
    good = F.substring("secret", 1, 1).rlike("[0-9]")
    return requests.where("request is not null").select(
        "request_key", F.when(good, 200).otherwise(401).alias("status"), F.create_map(F.lit("content-type"), F.lit("application/json")).alias("headers"),
        F.when(good, '{"ok": true}').otherwise('{"error": "no"}').alias("body"),
    ).dropDuplicates(["request_key"])


@query(f"SELECT DISTINCT rule_id, secret, regexp_matches(secret, '^[0-9]') AS success FROM ({_sql_found([TOKEN])})")
def validate_once(spark, sf_dir):
    """One outcome for each distinct secret."""
    rules, found = _probed(spark, sf_dir)
    requests = validate.plan_requests(found, rules, blob="doc_id")
    return validate.judge(requests, _answers(requests), rules).select("rule_id", "secret", "success")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, found = _probed(spark, sf_dir)
    requests = validate.plan_requests(found, rules, blob="doc_id")
    return validate.join_back(found, validate.judge(requests, _answers(requests), rules), blob="doc_id")


_VALID_SQL = f"""SELECT *, CASE WHEN rule_id = 'demo.email' THEN 100 WHEN regexp_matches(secret, '^[0-9]') THEN 200 ELSE 401 END AS status,
rule_id = 'demo.token' AND regexp_matches(secret, '^[0-9]') AS success FROM ({_sql_found([TOKEN, EMAIL])})"""


@query(f"SELECT doc_id, rule_id, start, status::INT AS status, success FROM ({_VALID_SQL})")
def validate_join_back(spark, sf_dir):
    """The outcome of each secret on every finding of it."""
    return _validated(spark, sf_dir).select("doc_id", "rule_id", "start", F.col("validation_status").alias("status"), F.col("validation_success").alias("success"))


@query(f"""SELECT doc_id, start, CASE WHEN success THEN 'Active Credential' WHEN status = 100 THEN 'Not Attempted' ELSE 'Inactive Credential' END AS label
FROM ({_VALID_SQL})""")
def validation_status(spark, sf_dir):
    label = validate.status_label(F.col("validation_success"), F.col("validation_status"))
    return _validated(spark, sf_dir).select("doc_id", "start", label.alias("label"))


@query("""SELECT event_id, (s = 200 OR s = 201) AND contains(left(props, 512), 'k') AND json_valid(props) AND NOT contains(left(props, 512), '99') AS met
FROM (SELECT event_id, props, 200 + (event_id % 3) AS s FROM events)""")
def response_match(spark, sf_dir):
    """Response matchers over recorded responses (events as responses)."""
    matchers = [
        {"type": "StatusMatch", "status": [200, 201]}, {"type": "WordMatch", "words": ["k"], "match_all_words": True},
        {"type": "JsonValid"}, {"type": "WordMatch", "words": ["99"], "negative": True},
    ]
    events = _read(spark, sf_dir, "events").withColumn("status", F.lit(200) + F.col("event_id") % 3)
    none = F.create_map().cast("map<string,string>")
    return events.select("event_id", validate.response_matches(matchers, F.col("status"), none, F.col("props")).alias("met"))


#: 750 rules for judging: what they ask of an answer, as (number, word, every word, status, negative, header's value).
_ASKED = [(i, f"{i % 97}", i % 3 == 0, 200 + i % 4, i % 5 == 0, f"v{i % 7}") for i in range(750)]


def _many_rules() -> list[Rule]:
    def matchers(word: str, every: bool, status: int, negative: bool, value: str) -> list[dict]:
        return [
            {"type": "WordMatch", "words": [word, "k"], "match_all_words": every, "negative": negative}, {"type": "StatusMatch", "status": [status, 204]},
            {"type": "HeaderMatch", "header": "X-Kind", "expected": [value, "V9"]}, {"type": "JsonValid"},
        ]

    return [
        Rule(f"many.{i}", f"Many {i}", "x", validation={"type": "Http", "content": {"request": {"url": "https://api.invalid/", "response_matcher": matchers(*rest)}}})
        for i, *rest in _ASKED
    ]


@query(f"""WITH asked(n, word, every, status, negative, value) AS (VALUES {', '.join(f"({n}, '{w}', {e}, {s}, {g}, '{v}')" for n, w, e, s, g, v in _ASKED)}),
told AS (SELECT event_id, event_id % 750 AS n, 200 + (event_id // 750) % 5 AS status, left(props, 512) AS body, props, 'v' || (event_id // 7) % 10 AS kind FROM events)
SELECT event_id, 'many.' || n AS rule_id, t.status::INT AS status,
(CASE WHEN every THEN contains(body, word) AND contains(body, 'k') ELSE contains(body, word) OR contains(body, 'k') END) <> negative
AND t.status IN (a.status, 204) AND (contains(kind, value) OR contains(kind, 'v9')) AND json_valid(props) AS success FROM told t JOIN asked a USING (n)""")
def judge_many_rules(spark, sf_dir):
    """Answers judged by 750 rules with four matchers each (events as answers), in one plan."""
    events = _read(spark, sf_dir, "events").withColumn("key", F.col("event_id").cast("string"))
    none = F.lit(None).cast("string")
    requests = events.select(
        F.concat(F.lit("many."), F.col("event_id") % 750).alias("rule_id"), F.col("key").alias("secret"), F.lit(None).cast("map<string,string>").alias("extra"),
        F.col("key").alias("request_key"), none.alias("problem"), F.lit(None).cast("int").alias("problem_status"),
    )
    kind = F.concat(F.lit("V"), F.floor(F.col("event_id") / 7) % 10)
    answers = events.select(
        F.col("key").alias("request_key"), (200 + F.floor(F.col("event_id") / 750) % 5).cast("int").alias("status"), F.create_map(F.lit("x-kind"), kind).alias("headers"), F.col("props").alias("body")
    )
    told = validate.judge(requests, answers, _many_rules())
    return told.select(F.col("secret").cast("long").alias("event_id"), "rule_id", "status", "success")


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 50 AS secret, o_orderkey % 7 AS account FROM orders)
SELECT o_orderkey, (secret * 7 + account) % 3 = 0 AS success, CASE WHEN (secret * 7 + account) % 3 = 0 THEN 200 ELSE 401 END::INT AS status FROM f""")
def validate_by_values(spark, sf_dir):
    """One secret in many blobs, each with an account of its own: its outcome there is that of the request with that account."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("secret"), (F.col("o_orderkey") % 7).alias("account"))
    texts = orders.select("o_orderkey", F.concat(F.lit("acct "), "account", F.lit(" pin "), "secret").alias("text"))
    found = checkpoint(matcher.scan(B.from_table(texts, "text", F.col("o_orderkey").cast("string")), [_ACCOUNT, _PIN]))
    found = found.withColumn("place", B.path_of())
    asked = orders.select("secret", "account").distinct()
    request = F.concat(F.lit('{"headers": {}, "method": "GET", "url": "https://api.invalid/'), "account", F.lit("/"), "secret", F.lit('"}'))
    record = asked.select(
        F.concat(F.lit("HTTP:"), F.sha1(request.cast("binary"))).alias("request_key"), F.when((F.col("secret") * 7 + F.col("account")) % 3 == 0, 200).otherwise(401).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/plain")).alias("headers"), F.lit("answer").alias("body"),
    )
    told = validate.validated(found, [_ACCOUNT, _PIN], responses=record, blob="place").where("rule_id = 'demo.pin'")
    return told.select(F.col("place").cast("long").alias("o_orderkey"), F.col("validation_success").alias("success"), F.col("validation_status").alias("status"))


@query("""SELECT k, unnest(asks) AS asked_at FROM (SELECT user_id % 10 AS k, list_reduce(list_sort(list(epoch_us(ts))),
lambda a, t: CASE WHEN t >= list_last(a) + 1200000000 THEN list_append(a, t) ELSE a END, [min(epoch_us(ts))]) AS asks FROM events GROUP BY 1)""")
def validation_windows(spark, sf_dir):
    """The events as a stream of requests (ten keys): when each key is asked, an answer being good for 1,200 seconds.

    They arrive in three parts, each read by a run of the stream that goes on from the state of the one before.
    """
    events = _read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    third = F.floor((F.unix_micros("ts") - (first or 0)) * 3 / ((last or 0) - (first or 0) + 1))
    key = (F.col("user_id") % 10).cast("string")
    for part in range(3):
        events.where(third == part).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        asked = validity.asks(rows.select(key.alias("request_key"), F.concat(F.lit("GET /"), key).alias("request"), "ts"), "ts")
        writer = asked.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.start().awaitTermination()
    return spark.read.schema(asked.schema).parquet(f"{folder}/out").select(F.col("request_key").cast("long").alias("k"), F.unix_micros("asked_at").alias("asked_at"))


_ACCOUNT = Rule("demo.account", "Demo Account", r"acct ([0-9]{1,9})\b", min_entropy=-1.0)
_PIN = Rule(
    "demo.pin", "Demo Pin", r"pin ([0-9]{1,12})\b", min_entropy=-1.0, depends_on=(("demo.account", "AKID"),),
    validation={"type": "Http", "content": {"request": {
        "method": "GET", "url": "https://api.invalid/{{ AKID }}/{{ TOKEN }}", "response_matcher": [{"type": "StatusMatch", "status": [200]}]}}},
)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 428 WHEN (o_custkey + o_orderkey) % 3 = 0 THEN 200 ELSE 401 END::INT AS status,
o_custkey % 10 <> 0 AND (o_custkey + o_orderkey) % 3 = 0 AS success, CASE WHEN o_custkey % 10 = 0 THEN 'Validation skipped – missing dependent rules: demo.account' ELSE 'answer' END AS body
FROM orders WHERE NOT regexp_matches(o_orderkey::VARCHAR, '123456789')""")
def validate_dependent(spark, sf_dir):
    """Secrets that need a second value from the same blob (orders as texts; every tenth customer's lack it), answered from a record."""
    orders = _read(spark, sf_dir, "orders")
    account = F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("acct "), "o_custkey", F.lit(" "))).otherwise("")
    texts = orders.select("o_orderkey", F.concat(account, F.lit("pin "), "o_orderkey").alias("text"))
    found = checkpoint(matcher.scan(B.from_table(texts, "text", F.col("o_orderkey").cast("string")), [_ACCOUNT, _PIN]))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    url = F.concat(F.lit("https://api.invalid/"), c, F.lit("/"), k)
    request = F.concat(F.lit('{"headers": {}, "method": "GET", "url": "'), url, F.lit('"}'))
    record = orders.select(
        F.concat(F.lit("HTTP:"), F.sha1(request.cast("binary"))).alias("request_key"), F.when((c + k) % 3 == 0, 200).otherwise(401).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/plain")).alias("headers"), F.lit("answer").alias("body"),
    )
    told = validate.validated(found, [_ACCOUNT, _PIN], responses=record).where("rule_id = 'demo.pin'")
    return told.select(
        F.col("secret").cast("long").alias("o_orderkey"), F.col("validation_status").alias("status"), F.col("validation_success").alias("success"),
        F.col("validation_body").alias("body"),
    )


# --- reports -----------------------------------------------------------------------------------------------------------


@query(f"SELECT rule_name, count(*) AS findings FROM ({_sql_found()}) JOIN {_RULES_SQL} USING (rule_id) GROUP BY rule_name")
def rule_summary(spark, sf_dir):
    return report.count_by_rule(_found(spark, sf_dir))


@query(f"""SELECT (SELECT count(*) FROM v) AS findings, coalesce((SELECT sum(1) FROM v WHERE success AND status <> 100), 0)::BIGINT AS successful,
coalesce((SELECT sum(1) FROM v WHERE NOT success AND status <> 100), 0)::BIGINT AS failed, (SELECT count(DISTINCT {_BLOB_SQL}) FROM documents WHERE text IS NOT NULL) AS blobs,
(SELECT sum(strlen(text))::BIGINT FROM (SELECT DISTINCT text FROM documents)) AS bytes""".join([f"WITH v AS ({_VALID_SQL}) ", ""]))
def scan_summary(spark, sf_dir):
    return report.summary(_validated(spark, sf_dir), _doc_blobs(spark, sf_dir))


@query(f"WITH v AS ({_VALID_SQL}) SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) FILTER (success AND status <> 100) > 0 THEN 205 ELSE 200 END AS exit_code FROM v")
def exit_code(spark, sf_dir):
    return report.exit_code(_validated(spark, sf_dir))


@query(f"""SELECT doc_id, rule_name, snippet, entropy, status, path, "line" FROM (SELECT doc_id, rule_name, secret AS snippet,
printf('%.2f', {_SQL_ENTROPY.format(v='secret')}) AS entropy, CASE WHEN success THEN 'Active Credential' WHEN status = 100 THEN 'Not Attempted' ELSE 'Inactive Credential' END AS status,
concat('doc/', doc_id) AS path, 1 + length(b) - length(replace(b, chr(10), '')) AS "line" FROM (SELECT *, CASE WHEN start = 0 THEN '' ELSE decode(encode(body)[1:start]) END AS b FROM ({_VALID_SQL}))
JOIN {_RULES_SQL} USING (rule_id) WHERE visible)""")
def report_json(spark, sf_dir):
    """The JSON report, read back into columns."""
    rows = report.report_rows(report.shown(_validated(spark, sf_dir)))
    m = F.col("matches")[0]
    f = m["finding"]
    return rows.select(
        F.substring(f["path"], 5, 30).cast("long").alias("doc_id"), m["rule"]["name"].alias("rule_name"), f["snippet"].alias("snippet"),
        f["entropy"].alias("entropy"), f["validation"]["status"].alias("status"), f["path"].alias("path"),
        f["line"].cast("long").alias("line"),
    )


@query()
def report_json_lines(spark, sf_dir):
    return report.json_lines(report.shown(_found(spark, sf_dir)))


@query()
def report_bson(spark, sf_dir):
    return report.bson(report.shown(_found(spark, sf_dir)))


@query()
def report_sarif(spark, sf_dir):
    return report.sarif_results(report.shown(_found(spark, sf_dir)))


@query()
def report_pretty(spark, sf_dir):
    return report.pretty(report.shown(_found(spark, sf_dir)))


_SHOWN_SQL = f"""SELECT doc_id, rule_id, rule_name, secret AS snippet, concat('doc/', doc_id) AS path, 1 + length(b) - length(replace(b, chr(10), '')) AS "line"
FROM (SELECT *, CASE WHEN start = 0 THEN '' ELSE decode(encode(body)[1:start]) END AS b FROM ({_sql_found()})) JOIN {_RULES_SQL} USING (rule_id) WHERE visible"""
_REPORT = "struct<id:string,matches:array<struct<rule:struct<name:string,id:string>,finding:struct<snippet:string,path:string,line:bigint>>>>"


def _read_back(lines: DataFrame) -> DataFrame:
    m = F.from_json("value", _REPORT)["matches"][0]
    return lines.select(m["rule"]["id"].alias("rule_id"), m["rule"]["name"].alias("rule_name"), m["finding"]["snippet"].alias("snippet"), m["finding"]["path"].alias("path"), m["finding"]["line"].alias("line"))


@query(f'SELECT rule_id, rule_name, snippet, path, "line" FROM ({_SHOWN_SQL})')
def report_json_lines_read(spark, sf_dir):
    """The JSON lines, written and read back."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    report.write_json_lines(report.shown(_found(spark, sf_dir)), path)
    return _read_back(spark.read.text(path))


def _document(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """A report written by many tasks, joined into one file and parsed as one document."""
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    write(report.shown(_found(spark, sf_dir)), f"{folder}/parts")
    documents.join_files(spark, f"{folder}/parts", f"{folder}/whole.json")
    return spark.read.option("multiLine", "true").json(f"{folder}/whole.json")


@query(f'SELECT rule_id, rule_name, snippet, path, "line" FROM ({_SHOWN_SQL})')
def report_json_document(spark, sf_dir):
    """The whole JSON report as one array, written in parts and parsed as one."""
    m = F.col("matches")[0]
    f = m["finding"]
    rows = _document(spark, sf_dir, report.write_json)
    return rows.select(m["rule"]["id"].alias("rule_id"), m["rule"]["name"].alias("rule_name"), f["snippet"].alias("snippet"), f["path"].alias("path"), f["line"].alias("line"))


@query(f"""SELECT rule_id, rule_name, snippet, path, "line", (SELECT count(DISTINCT rule_id) FROM ({_SHOWN_SQL})) AS rules FROM ({_SHOWN_SQL})""")
def report_sarif_document(spark, sf_dir):
    """The SARIF log as one document, its results and the rules it lists."""
    run = _document(spark, sf_dir, report.write_sarif).select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"), F.col("run.tool.driver.rules").alias("listed"))
    place = F.col("r.locations")[0]["physicalLocation"]
    own = F.filter("listed", lambda x: x["id"] == F.col("r.ruleId"))[0]
    return run.select(
        F.col("r.ruleId").alias("rule_id"), own["name"].alias("rule_name"), place["region"]["snippet"]["text"].alias("snippet"), place["artifactLocation"]["uri"].alias("path"),
        place["region"]["startLine"].alias("line"), F.size("listed").cast("long").alias("rules"),
    )


@query(f'SELECT rule_id, rule_name, snippet, path, "line" FROM ({_SHOWN_SQL})')
def report_bson_read(spark, sf_dir):
    """The BSON documents, read back."""
    return _read_back(report.read_bson(report.bson(report.shown(_found(spark, sf_dir)))))


@query(f'SELECT rule_id, rule_name, snippet, path, "line" FROM ({_SHOWN_SQL})')
def report_sarif_read(spark, sf_dir):
    """The SARIF results, read back."""
    place = "$.locations[0].physicalLocation."
    get = lambda path: F.get_json_object("result", path)
    return report.sarif_results(report.shown(_found(spark, sf_dir))).select(
        get("$.ruleId").alias("rule_id"), "rule_name", get(place + "region.snippet.text").alias("snippet"), get(place + "artifactLocation.uri").alias("path"),
        get(place + "region.startLine").cast("long").alias("line"),
    )


@query(f'SELECT upper(rule_id) AS rule_id, upper(rule_name) AS rule_name, snippet, path, "line" FROM ({_SHOWN_SQL})')
def report_pretty_read(spark, sf_dir):
    """The blocks of text, read back."""
    blocks = report.pretty(report.shown(_found(spark, sf_dir)))
    take = lambda pattern: F.regexp_extract("value", pattern, 1)
    return blocks.select(
        take(r"=> \[([^\]]*)\]").alias("rule_id"), take(r"^(.*?) => \[").alias("rule_name"), take(r"\|Finding\.*: (.*)").alias("snippet"),
        take(r"\|Path\.*: (.*)").alias("path"), take(r"\|Line Num\.*: (.*)").cast("long").alias("line"),
    )


@query(f"""WITH f AS ({_sql_found([r for r in RULES if r.confidence != 'low'])}) SELECT r.rule_id, rule_name, confidence, visible, min_entropy::FLOAT AS min_entropy,
count(f.rule_id) AS findings, count(DISTINCT f.doc_id) AS documents FROM {_RULES_SQL.replace(' AS rules(', ' AS r(')} LEFT JOIN f USING (rule_id) WHERE confidence IN ('medium', 'high') GROUP BY ALL""")
def rules_catalog(spark, sf_dir):
    """The rules of a selection with what they find in the documents."""
    chosen = select_rules(at_least(RULES, "medium"), ["demo"])
    found = _found(spark, sf_dir, chosen).groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"))
    told = rules_table(spark, chosen).select("rule_id", "rule_name", "confidence", "visible", "min_entropy").join(found, "rule_id", "left")
    return told.fillna(0, ["findings", "documents"])


@query("""WITH n AS (SELECT sum(len(regexp_extract_all(text, 'q[a-z]{4}')))::BIGINT AS n FROM documents)
SELECT * FROM (SELECT 'demo.broken' AS rule_id, 'error' AS level, NULL::BIGINT AS matches UNION ALL SELECT 'demo.broken', 'warning', NULL UNION ALL SELECT 'demo.short', 'warning', n FROM n)""")
def rules_check(spark, sf_dir):
    """What the checker says about good and bad rules, and what those that compile match in the documents."""
    bad = [Rule("demo.broken", "Broken", "([a-z"), Rule("demo.short", "xy", "q[a-z]{4}", min_entropy=-1.0, examples=("quick",))]
    told = sorted({(i, level) for i, level, _ in check_rules([*RULES, *load_rules(), *bad])})
    broken = {i for i, level in told if level == "error"}
    usable = [r for r in bad if r.id not in broken]
    matches = _found(spark, sf_dir, usable).groupBy("rule_id").agg(F.count("*").alias("matches"))
    return spark.createDataFrame(told, "rule_id string, level string").join(matches, "rule_id", "left").select("rule_id", "level", "matches")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
