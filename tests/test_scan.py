"""Sources, matcher, deduplication, dependencies, validation, reports and streams."""

import io
import json
import random
import struct
import subprocess
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions.scalars import fingerprint_of
from gleaner.operators import dedup, dependencies, matcher, report, validate
from gleaner.sources import archives, blobs, git
from gleaner.sources.rules import Rule, dependencies_table, load_rules
from gleaner.streaming import scan as streaming

SECRET = Rule("demo.secret", "Demo Secret", r"secret_([0-9]{4})", confidence="low")
KEY = Rule("demo.key", "Demo Key", r"key=([a-z0-9]{8})")
PAIR = Rule("demo.pair", "Demo Pair", r"pair=([a-z]{4})|couple=([a-z]{5})", depends_on=(("demo.key", "id"),))
NAMED = Rule("demo.named", "Demo Named", r"((?P<user>[a-z]+):([0-9]+)@)")


def _scan(spark, items, rules, **options):
    return matcher.scan(blobs.from_bytes(spark, items), rules, **options)


def _plain(content, rules):
    """Slow matcher straight from the definition."""
    scanner = [(r, matcher.compile_bytes(r.pattern)) for r in rules]
    for rule, regex in scanner:
        spans = []
        for m in regex.finditer(content):
            g = 1 if regex.groups and m[1] is not None else 0
            s, e = m.span(g)
            if matcher.entropy_of(m[g]) <= rule.min_entropy or matcher.is_safe(m[g]):
                continue
            if any((a <= s and e <= b) or (s <= a and b <= e) for a, b in spans):
                continue
            spans.append((s, e))
            yield rule.id, s, e, m[g]


def test_values_captures_and_offsets(spark):
    content = "é pair=abcd couple=fghij bob:12@".encode()
    got = {(r["rule_id"], r["start"]): r for r in _scan(spark, [("a", content)], [PAIR, NAMED]).collect()}
    first, second, named = got[("demo.pair", 8)], got[("demo.pair", 13)], got[("demo.named", 26)]
    assert (first["secret"], first["end"]) == ("abcd", 12)
    assert (second["secret"], bytes(second["value"])) == ("fghij", b"couple=fghij")  # group 2 only: the span is the whole match
    assert [c["name"] for c in named["captures"]] == ["user", None, None, None, None] and named["secret"] == "bob:12@"
    assert first["fingerprint"] == str(fingerprint_of(b"abcd", "file", 8, 12)) and first["validation_status"] == 100


def test_lines_and_columns(spark):
    rows = _scan(spark, [("a", b"x secret_1357\n\n  secret_2468 y")], [SECRET]).orderBy("start").collect()
    assert [(r["line_start"], r["column_start"], r["line_end"], r["column_end"]) for r in rows] == [(1, 9, 1, 12), (3, 9, 3, 12)]
    rows = _scan(spark, [("a", b"x secret_1357\n")], [SECRET], compat_columns=True).collect()
    assert (rows[0]["line_start"], rows[0]["column_start"]) == (1, 0)


def test_scan_matches_the_definition_on_noise(spark):
    rng = random.Random(7)
    rules = [SECRET, KEY, PAIR, Rule("demo.text", "Demo Text", r"[a-z]{3,6}[0-9]{1,3}", min_entropy=2.2), *load_rules()]
    items = []
    for i in range(40):
        parts = [rng.choice(["secret_", "key=", "pair=", "é", "\n", " ", "ghp_" + "".join(rng.choices("abcXYZ0189", k=36))]) + "".join(rng.choices("abc0123456789 \n", k=rng.randint(0, 14))) for _ in range(60)]
        items.append((str(i), "".join(parts).encode()))
    got = sorted((r["p"], r["rule_id"], r["start"], r["end"], bytes(r["value"])) for r in _scan(spark, items, rules).withColumn("p", blobs.path_of()).repartition(3).collect())
    want = sorted((p, *hit) for p, c in items for hit in _plain(c, rules))
    assert got == want and len(got) > 100


def test_null_and_empty_content(spark):
    frame = blobs.from_bytes(spark, [("a", b"")])
    none = frame.withColumn("content", F.lit(None).cast("binary"))
    assert matcher.scan(frame.unionByName(none), [KEY]).count() == 0


def test_coarse_filter_needs_a_literal_of_every_rule():
    assert matcher.may_match([KEY, Rule("x", "xyz", "[0-9]+")], F.lit(b"").cast("binary")) is None


def test_files_filters_and_ignore_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").write_text("secret_1234\n")
    (tmp_path / "sub" / "big.txt").write_text("x" * 5000)
    (tmp_path / "sub" / "pic.png").write_bytes(b"\x89PNG secret_9989")
    found = blobs.from_files(spark, [str(tmp_path)])
    names = lambda df: sorted(r["p"].rpartition("/")[2] for r in df.select(blobs.path_of().alias("p")).collect())
    assert names(found) == [".hidden", "big.txt", "pic.png"]
    assert names(blobs.from_files(spark, [str(tmp_path)], max_mb=0.001)) == [".hidden", "pic.png"]
    assert names(blobs.keep(found, no_binary=True)) == [".hidden", "big.txt"]
    assert names(blobs.keep(found, ignore=["# none", "sub/", ""])) == [".hidden"]
    assert names(blobs.keep(found, ignore=["*.png", "**/big.*"])) == [".hidden"]


def test_json_lines_and_duplicates(spark):
    lines = spark.createDataFrame([('{"content": "key=abcdefg1", "origin": {"path": "p"}}',), ('{"content_base64": "a2V5PWFiY2RlZmcx"}',), ('{"other": 1}',)], "value string")
    found = blobs.from_jsonl(lines)
    assert found.count() == 2 and matcher.scan(found, [KEY]).count() == 2
    merged = blobs.distinct_blobs(found).collect()
    assert len(merged) == 1 and len(merged[0]["origins"]) == 2


def _archives():
    zipped, tarred = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("in/a.txt", "secret_1234")
        z.writestr("../evil.txt", "secret_6676")
    with tarfile.open(fileobj=tarred, mode="w:gz") as t:
        for name, data in (("b.txt", b"secret_5678"), ("n.zip", zipped.getvalue())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    header = json.dumps({"files": {"d": {"files": {"c.txt": {"offset": "0", "size": 11}}}}}).encode()
    asar = struct.pack("<IIII", 4, len(header) + 8, len(header) + 4, len(header)) + header + b"secret_4321"
    return {"x.zip": zipped.getvalue(), "y.tar.gz": tarred.getvalue(), "z.asar": asar, "bad.zip": b"secret_7787", "plain.txt": b"secret_8898"}


def test_archives_expand(spark):
    import bz2
    import gzip
    import lzma
    import zlib

    items = _archives() | {"g.txt.gz": gzip.compress(b"secret_1121"), "h.bz2": bz2.compress(b"secret_2232"), "i.xz": lzma.compress(b"secret_3343"), "j.zlib": zlib.compress(b"secret_4454")}
    found = blobs.from_bytes(spark, items.items())
    rows = matcher.scan(archives.expand(found), [SECRET]).select(blobs.path_of().alias("p"), "secret").collect()
    assert {(r["p"], r["secret"]) for r in rows} == {
        ("x.zip!in/a.txt", "1234"), ("y.tar.gz!b.txt", "5678"), ("y.tar.gz!n.zip!in/a.txt", "1234"), ("z.asar!d/c.txt", "4321"), ("bad.zip", "7787"),
        ("plain.txt", "8898"), ("g.txt.gz!g.txt", "1121"), ("h.bz2!h", "2232"), ("i.xz!i", "3343"), ("j.zlib!j", "4454"),
    }
    assert blobs.keep(found, archives=False).count() == 1 and not archives.safe_member("/a") and archives.safe_member("a..b/c")


def test_large_members_are_read_whole():
    import bz2
    import gzip
    import lzma
    import zlib

    rng = random.Random(4)
    text = b"".join(b"%d " % rng.randrange(10**9) for _ in range(3000)) + b"secret_1234"
    zipped, tarred = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a.txt", text)
    with tarfile.open(fileobj=tarred, mode="w:gz") as t:
        for name, data in (("b.txt", text), ("n.zip", zipped.getvalue())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    header = json.dumps({"files": {"c.txt": {"offset": "0", "size": len(text)}}}).encode()
    asar = (4).to_bytes(4, "little") + b"".join((len(header) + k).to_bytes(4, "little") for k in (8, 4, 0)) + header + text
    items = {
        "x.zip": zipped.getvalue(), "y.tar.gz": tarred.getvalue(), "z.asar": asar, "g.gz": gzip.compress(text), "h.bz2": bz2.compress(text),
        "i.xz": lzma.compress(text), "j.zlib": zlib.compress(text),
    }
    seen = {}
    for path, data in items.items():
        for name, part in archives.members(path, data, 2, 4000):
            member, _, before = name.partition("@")
            so_far = seen.setdefault(member, b"")
            at, feeds, column = map(int, before.split(":")) if before else (0, 0, 0)
            assert (feeds, column) == (so_far.count(b"\n", 0, at), at - so_far.rfind(b"\n", 0, at) - 1)
            assert len(part) <= 4000 and at <= len(so_far) and part.startswith(so_far[at:])
            seen[member] = so_far[:at] + part
    assert set(seen) == {"x.zip!a.txt", "y.tar.gz!b.txt", "y.tar.gz!n.zip!a.txt", "z.asar!c.txt", "g.gz!g", "h.bz2!h", "i.xz!i", "j.zlib!j"}
    assert all(whole == text for whole in seen.values())
    cut = gzip.compress(text)[:-20]
    assert (("k.gz", cut) in archives.members("k.gz", cut)) and next(archives.members("k.gz", b"")) == ("k.gz!k", b"")


def _repo(path):
    def run(*args):
        subprocess.run(["git", "-C", str(path), "-c", "user.name=A B", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    path.mkdir()
    run("init", "-q", "-b", "main")
    for name, text in (("a.txt", "secret_1234\n"), ("a.txt", "secret_1234\nmore\n")):
        (path / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", "one")
    run("checkout", "-qb", "side", "HEAD~1")
    (path / "b.txt").write_text("secret_1234\nmore\n")
    run("add", "-A")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "side", "-m", "merge")
    (path / "c.txt").write_text("secret_1234\n")
    run("add", "-A")
    run("commit", "-qm", "again")
    return str(path)


def test_git_history(spark, tmp_path):
    repo = _repo(tmp_path / "r")
    commits, changes = git.read_history(spark, repo)
    introduced = git.first_seen(commits, changes)
    names = sorted((r["path"]) for r in introduced.collect())
    assert names == ["a.txt", "a.txt", "b.txt"]  # both branches introduce the longer text; the last commit brings nothing new
    found = git.from_history(git.read_objects(spark, repo), commits, introduced, repo)
    rows = matcher.scan(found, [SECRET]).collect()
    assert len(rows) == 2 and sorted(len(r["origins"]) for r in rows) == [1, 2]
    shown = report.report_rows(matcher.scan(found, [SECRET])).collect()
    meta = shown[0]["matches"][0]["finding"]["git_metadata"]
    assert meta["commit"]["committer_email"] == "a@b.c" and " show " in meta["file"]["git_command"]


def test_dedup_across_files(spark):
    found = _scan(spark, [("a.txt", b"secret_1234\n"), ("b.txt", b"secret_1234\n")], [SECRET]).withColumn("kind", F.lit("file"))
    assert found.count() == 2
    first = dedup.first_per_secret(found, [blobs.path_of(), F.col("start")]).collect()
    assert len(first) == 1 and first[0]["origins"][0]["path"] == "a.txt"
    merged = dedup.merge_origins(found, ["fingerprint"], ["blob_id", "start"])
    assert merged.count() == 1 and dedup.one_row_per_origin(merged).count() == 2


def test_origins_containment_and_redundant_git(spark):
    rows = [("k", 0, 10), ("k", 2, 8), ("k", 5, 12), ("k", 0, 10), ("j", 3, 4)]
    got = dedup.inside_another(spark.createDataFrame(rows, "g string, start int, end int"), ["g"]).collect()
    assert sorted((r["g"], r["start"], r["end"], r["contained"]) for r in got) == [("j", 3, 4, False), ("k", 0, 10, False), ("k", 0, 10, True), ("k", 2, 8, True), ("k", 5, 12, False)]
    kind = "array<struct<kind:string,path:string,repo_path:string,commit:struct<commit_id:string>,blob_path:string>>"
    origins = [("git_repo", None, "r", None, None), ("git_repo", None, "r", ("c",), "p"), ("git_repo", None, "s", None, None), ("file", "f", None, None, None)]
    frame = spark.createDataFrame([(origins,)], f"o {kind}")
    left = frame.select(dedup.without_redundant_git(F.col("o")).alias("o")).first()["o"]
    assert [(o["kind"], o["repo_path"], o["commit"] is None) for o in left] == [("git_repo", "r", False), ("git_repo", "s", True), ("file", None, True)]


def test_dependencies(spark):
    items = [("a", b"key=abcdefg1 pair=abcd key=abcdefg2"), ("b", b"pair=zzzz pair=yxwv"), ("c", b"key=abcdefg3")]
    found = _scan(spark, items, [KEY, PAIR])
    deps = dependencies_table(spark, [KEY, PAIR])
    values = dependencies.dependency_values(found, deps)
    assert sorted((r["variable"], r["value"]) for r in values.collect()) == [("ID", "abcdefg1"), ("ID", "abcdefg2")]
    assert dependencies.missing_dependencies(found, deps).count() == 1
    simple, dependent = dependencies.split_phases(found, deps)
    assert simple.count() == 1 and dependent.count() == found.count() - 1


def test_nearest_value_matches_brute_force(spark):
    rng = random.Random(2)
    targets = [(i % 4, rng.randint(0, 60), i) for i in range(60)]
    values = [(rng.randint(0, 4), rng.randint(0, 60), f"v{i:02}") for i in range(50)]
    t = spark.createDataFrame(targets, "blob_id long, end long, n int")
    v = spark.createDataFrame(values, "blob_id long, start long, value string")
    got = {r["n"]: (r["value_start"], r["value"]) for r in dependencies.nearest_value(t, v).collect()}
    want = {}
    for b, end, n in targets:
        near = [(abs(s - end), s, x) for g, s, x in values if g == b]
        if near:
            want[n] = min(near)[1:]
    assert got == want


HTTP = {"type": "Http", "content": {"request": {"method": "GET", "url": "https://h.invalid/{{ TOKEN }}", "headers": {"X": "{{ ID }}", "Bad": "{{ A | nosuch }}"}, "response_matcher": [{"type": "StatusMatch", "status": [200]}]}}}


def _responding(request):
    if "fail" in request["url"]:
        raise OSError("down")
    return (200 if "good" in request["url"] else 403), {"Content-Type": "text/plain"}, "x" * 600


def test_validation_end_to_end(spark):
    rule = Rule("demo.http", "Demo Http", r"http_([a-z]{4})", validation=HTTP)
    broken = Rule("demo.broken", "Broken Http", r"brew_([a-z]{4})", validation={"type": "Http", "content": {"request": {"url": "nothing"}}})
    sure = Rule("demo.sure", "Sure", r"sure_([a-z]{4})", prevalidated=True)
    items = [("a", b"http_good http_evil http_good sure_abcd brew_abcd"), ("b", b"http_good http_fail pair=abcd")]
    rules = [rule, broken, sure, PAIR]
    found = _scan(spark, items, rules)
    requests = validate.plan_requests(found, rules)
    assert requests.count() == 4  # one for each distinct secret
    sent = validate.send(requests, _responding)
    outcome = validate.judge(requests, sent, rules)
    missing = dependencies.missing_dependencies(found, dependencies_table(spark, rules))
    done = validate.join_back(found, outcome, missing).collect()
    got = {(r["rule_id"], r["secret"]): (r["validation_success"], r["validation_status"], r["validation_body"][:22]) for r in done}
    assert len(done) == found.count()
    assert got[("demo.http", "good")][:2] == (True, 200) and got[("demo.http", "evil")][:2] == (False, 403)
    assert got[("demo.http", "fail")][:2] == (False, 502) and got[("demo.broken", "abcd")][:2] == (False, 400)
    assert got[("demo.sure", "abcd")] == (True, 200, "Prevalidated") and got[("demo.pair", "abcd")][:2] == (False, 428)


def test_multipart_and_one_retry(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"\xff\x00")
    parts = [
        {"name": "key", "type": "text", "content": "{{ TOKEN | upcase }}"}, {"name": "bad", "type": "text", "content": "{{ A | nosuch }}", "content_type": "a/b"},
        {"name": "file", "type": "file", "content": f"{tmp_path}/f"}, {"name": "none", "type": "file", "content": "/no/such"}, {"name": "other", "type": "x"},
    ]
    raw = {"method": "POST", "url": "https://h.invalid/{{ TOKEN }}", "multipart": {"parts": parts}}
    rule = Rule("demo.parts", "Parts", r"http_([a-z]{4})", validation={"type": "Http", "content": {"request": raw}})
    calls = str(tmp_path / "calls")

    def transport(request):
        with open(calls, "a") as file:
            file.write(request["url"][-4:] + "\n")
        before = open(calls).read().count(request["url"][-4:])
        kind = request["url"][-4:]
        if kind == "once" and before == 1:
            return 503, {}, "busy"
        if kind == "errs" and before == 1:
            raise OSError("down")
        return 504 if kind == "dead" else 200, {}, repr([(p["name"], p["content"], p["content_type"]) for p in request["multipart"]])

    found = _scan(spark, [("a", b"http_once http_errs http_dead http_good")], [rule])
    requests = validate.plan_requests(found, [rule])
    sent = validate.send(requests.coalesce(1), transport, pause=0).collect()
    assert sorted(r["status"] for r in sent) == [200, 200, 200, 504]
    made = lambda key: repr([("key", key, "text/plain"), ("bad", "", "a/b"), ("file", b"\xff\x00", "application/octet-stream"), ("none", b"", "application/octet-stream")])
    assert {r["body"] for r in sent} == {made(k) for k in ("ONCE", "ERRS", "DEAD", "GOOD")}
    assert sorted(open(calls).read().split()) == ["dead", "dead", "errs", "errs", "good", "once", "once"]


def test_variables_and_requests():
    captures = [{"name": None, "value": "whole"}, {"name": "user", "value": "u"}, {"name": None, "value": "one"}, {"name": None, "value": "two"}]
    assert validate.template_variables(captures) == {"USER": "u", "TOKEN": "two"}
    assert validate.template_variables(captures[:1]) == {"TOKEN": "whole"}
    made = validate.request_of(Rule("a", "abc", "abcde", validation=HTTP), {"TOKEN": "t", "ID": "1\r\n2"})
    assert made == {"method": "GET", "url": "https://h.invalid/t", "headers": {"X": "12"}}


@pytest.mark.parametrize(
    ("matchers", "status", "body", "want"),
    [
        ([{"type": "WordMatch", "words": ["test"], "match_all_words": True}], 200, "This is a test", True),
        ([{"words": ["no", "test"], "match_all_words": True}], 200, "This is a test", False),
        ([{"words": ["bad"], "negative": True}], 200, "This is a test", True),
        ([{"status": [200, 201], "match_all_status": True}], 200, "", False),
        ([{"status": [404], "negative": True}], 200, "", True),
        ([{"type": "HeaderMatch", "header": "Content-Type", "expected": ["JSON"]}], 200, "{}", True),
        ([{"type": "JsonValid"}], 200, "{oops", False), ([{"type": "JsonValid"}], 200, '{"a": [1]}', True),
        ([{"type": "XmlValid"}], 200, "<a><b/></a>", True), ([{"type": "XmlValid"}], 200, "text", False),
        ([], 200, "<html><body></body></html>", False), ([], 500, "fine", True), ([{"words": ["late"]}], 200, "x" * 512 + "late", False),
    ],
)
def test_response_matchers(spark, matchers, status, body, want):
    frame = spark.createDataFrame([(status, {"content-type": "application/json"}, body)], "s int, h map<string,string>, b string")
    assert frame.select(validate.response_matches(matchers, F.col("s"), F.col("h"), F.col("b")).alias("m")).first()["m"] is want


def test_cache_freshness(spark):
    cache = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS validated_at UNION ALL SELECT timestamp'2024-01-01 00:19:59'")
    assert validate.still_fresh(cache, F.lit("2024-01-01 00:20:00").cast("timestamp")).count() == 1


def test_reports(spark, tmp_path):
    found = _scan(spark, [("dir/a.py", b"key=abcdefg1\nkey=hijklmn2\n"), ("b", b"secret_1234")], [KEY, SECRET])
    shown = report.shown(found)
    parsed = json.loads(report.json_text(shown))
    assert [p["id"] for p in parsed] == ["demo.secret", "demo.key", "demo.key"]
    finding = parsed[1]["matches"][0]["finding"]
    assert finding["validation"] == {"status": "Not Attempted", "response": ""} and finding["path"] == "dir/a.py" and finding["entropy"] == "3.00"
    assert report.json_text(shown.where("false")) == ""
    report.write_json_lines(shown, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    raw = [bytes(r["value"]) for r in report.bson(shown).collect()]
    assert all(struct.unpack("<i", d[:4])[0] == len(d) and d[-1] == 0 for d in raw)
    sarif = json.loads(report.sarif_text(shown))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 3 and len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 2
    text = "\n".join(r["value"] for r in report.pretty(shown).collect())
    assert "DEMO KEY => [DEMO.KEY]" in text and "Response" not in text
    assert [tuple(r) for r in report.count_by_rule(shown).collect()] == [("Demo Key", 2), ("Demo Secret", 1)]
    assert report.exit_code(found).first()[0] == 200 and report.exit_code(found.where("false")).first()[0] == 0
    good = found.withColumns({"validation_success": F.lit(True), "validation_status": F.lit(200)})
    assert report.exit_code(good).first()[0] == 205 and report.shown(good, only_valid=True).count() == 3 and report.shown(found, only_valid=True).count() == 0
    timings = spark.createDataFrame([("r", "b1", 1.0), ("r", "b2", 3.0), ("q", "b1", 2.0)], "rule_id string, blob_id string, seconds double")
    assert [tuple(r) for r in report.rule_statistics(timings).collect()] == [("r", 2, 4.0, 2.0, 3.0, 1.0, "b2"), ("q", 1, 2.0, 2.0, 2.0, 2.0, "b1")]


def test_result_does_not_depend_on_partitions(spark):
    items = [(str(i), f"secret_{1000 + i % 7} key=abcdefg{i % 3}".encode()) for i in range(40)]
    whole = blobs.from_bytes(spark, items)
    runs = []
    for n in (1, 17):
        found = matcher.scan(whole.repartition(n), [SECRET, KEY]).withColumn("kind", F.lit("file"))
        first = dedup.first_per_secret(found, [blobs.path_of(), F.col("start")])
        runs.append(sorted((r["rule_id"], r["secret"], r["p"]) for r in first.withColumn("p", blobs.path_of()).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 10


def test_file_stream(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    (source / "a.txt").write_bytes(b"secret_1234")
    found = matcher.scan(streaming.file_stream(spark, str(source)), [SECRET])
    for name in (None, "b.txt"):
        if name:
            (source / name).write_bytes(b"secret_5678")
        assert streaming.write_findings(found, str(out), str(state), once=True).awaitTermination(120)
    assert sorted(r["secret"] for r in spark.read.parquet(str(out)).collect()) == ["1234", "5678"]


def test_stream_with_watermark_tells_a_secret_once(spark, tmp_path):
    schema = "text string, at timestamp, id long"
    rows = [("secret_1234", "2024-01-01 00:00:00", 1), ("secret_1234", "2024-01-01 00:01:00", 2), ("secret_9876", "2024-01-01 00:02:00", 3)]
    frame = spark.createDataFrame(rows, "text string, at string, id long").withColumn("at", F.to_timestamp("at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.table_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "text", "at", "id")
    query = streaming.write_findings(streaming.scan_stream(stream, [SECRET]), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120)
    assert sorted(r["secret"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1234", "9876"]
    counted = streaming.counts_per_window(spark.read.parquet(str(tmp_path / "out")))
    assert counted.agg(F.sum("findings")).first()[0] == 2 and time.time() > 0
