"""Files scanned by ranges: the same as in one piece, whatever the ranges."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.operators import matcher
from gleaner.sources import archives, blobs, ranges
from gleaner.sources.rules import Rule

RULES = [
    Rule("demo.key", "Key", r"key=([a-z0-9]{6,400})\b"), Rule("demo.long", "Long", r"BEGIN[A-Za-z0-9\n]+?END", min_entropy=-1.0), Rule("demo.two", "Two", r"(?<name>ab)(c+)\n", min_entropy=-1.0),
]
FIELDS = ("rule_id", "start", "end", "secret", "line_start", "column_start", "line_end", "column_end", "fingerprint")


def _text(rng, n):
    parts = []
    while sum(map(len, parts)) < n:
        parts.append(rng.choice(["x" * rng.randrange(1, 50), "\n", "key=" + "".join(rng.choices("abc123xyz9", k=rng.choice([6, 8, 90]))) + " ", "BEGIN" + "aB3\n" * rng.randrange(1, 40) + "END", "abccc\n", "é"]))
    return "".join(parts).encode()


@pytest.mark.parametrize(("size", "around"), [(64, 256), (1000, 300), (1 << 20, 1 << 10)])
def test_results_do_not_depend_on_ranges(spark, tmp_path, size, around):
    rng = random.Random(size)
    for name, n in (("a.txt", 6000), ("b b.txt", 900), ("c.txt", 1)):
        (tmp_path / name).write_bytes(_text(rng, n))
    (tmp_path / "empty.txt").write_bytes(b"")
    whole = matcher.scan(blobs.from_files(spark, [str(tmp_path)]), RULES)
    told = lambda df: sorted(tuple(r["origins"][0]["path"].split("/")[-1].replace("%20", " ") if f == "path" else r[f] for f in ("path", *FIELDS)) for r in df.collect())
    want = [r[:-1] for r in told(whole)]
    got = [r[:-1] for r in told(ranges.scan_files(spark, [str(tmp_path)], RULES, size, around))]
    assert got == want and len(got) > 60


def test_a_sparse_file_beyond_the_limit_of_a_row(spark, tmp_path):
    """3 GB, most of it a hole, with a key at each end and one across a cut."""
    size = 3 << 30
    with open(tmp_path / "large.bin", "wb") as file:
        file.write(b"key=a1b2c3d4 \n\n")
        file.seek(ranges.SIZE - 6)
        file.write(b" key=x9y8z7w6 \n")
        file.seek(size)
        file.write(b"\nkey=e5f6g7h8 ")
    got = {r["secret"]: (r["start"], r["line_start"], r["column_start"]) for r in ranges.scan_files(spark, [str(tmp_path)], RULES[:1]).collect()}
    assert got == {"a1b2c3d4": (4, 1, 4), "x9y8z7w6": (ranges.SIZE - 1, 3, ranges.SIZE - 16), "e5f6g7h8": (size + 5, 5, 4)}


@pytest.mark.parametrize("piece", [700, 2500])
def test_members_in_pieces_give_the_findings_of_the_whole(spark, piece):
    rng, rows = random.Random(piece), []
    for i, n in enumerate((9000, 3000, 40)):
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("in/m.txt", _text(rng, n))
        rows.append((f"a{i}.zip", file.getvalue()))
    packed = blobs.from_table(spark.createDataFrame(rows, "p string, c binary"), "c", F.col("p"))
    told = lambda df: sorted(tuple([r["origins"][0]["path"], *(r[f] for f in FIELDS), [(c["start"], c["end"]) for c in r["captures"]]]) for r in df.collect())
    whole = told(matcher.scan(archives.expand(packed), RULES))
    pieces = matcher.scan(archives.expand(packed, piece=piece), RULES)
    overlap = min(archives.OVERLAP, piece // 2)
    got = told(archives.joined(pieces, overlap))
    assert [w for w in whole if w not in got] == [] == [g for g in got if g not in whole]
    assert got == whole and len(whole) > 60
    assert pieces.count() > len(whole)
