"""Hard negatives, periodic runs and fingerprints: brute force and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import digests, hard_negatives, periodic, registry

# hard negatives


def _mined(rows, k, many, band):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for at, (anchor, q, label) in enumerate(good):
        if anchor % 10:
            continue
        others = sorted((-score(q, v), i) for p, (i, v, own) in enumerate(good) if p != at and own == label)[:k]
        for s, positive in others:
            fit = sorted((-n, i) for i, v, own in good if own != label for n in [score(q, v)] if band[0] * -s <= band[2] * n <= band[1] * -s)
            out += [(anchor, positive, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit[:many])]
    return sorted(out)


@pytest.mark.parametrize("block, group, pivots", [(7, 3, 4), (16384, 8192, 24)])
def test_hard_negatives_are_exact(spark, block, group, pivots):
    rng = random.Random(block)
    rows = [(i, [float(rng.randint(-5, 9)) for _ in range(5)], str(rng.choice("aaab cd"))) for i in range(150)]
    rows += [(200 + i, [3.0, 4.0, 1.0, 0.0, 2.0], "a" if i % 3 else "b") for i in range(30)]  # ties, and a label with much of all rows
    rows += [(300, None, "a"), (301, [1.0, None], "a"), (302, [float("nan")] * 5, "b"), (303, [], "a"), (310, [0.0] * 5, "a"), (311, [2.0], "b"), (None, [1.0] * 5, "a")]
    rows += [(320, [1.0] * 5, None), (20, [9.0] * 5, "a"), (20, [9.0] * 5, "a")]  # repeated rows
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>, label string").withColumn("uid", F.lit(1)).withColumn("far", F.lit("x")).repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, positives=4, negatives=3, band=(70, 95, 100), block=block, group=group, pivots=pivots)
    assert sorted(map(tuple, got.collect())) == _mined(rows, 4, 3, (70, 95, 100))


def test_hard_negatives_of_small_tables_and_large_numbers(spark):
    kind = "vec_id long, v array<double>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], kind), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [float(2**31), 1.0], 1), (1, [float(2**30), 3.0], 1), (2, [float(2**30), 2.0], 2), (3, [float(2**30), 4.0], 2)], kind)
    assert sorted(map(tuple, hard_negatives.hard_negatives(big, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 2**61 + 3, 2**61 + 2)]


def test_brackets_hold_and_prune_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16)) * 200
    x = np.floor(centre[np.arange(3000) % 30] + rng.normal(size=(3000, 16)) * 6)
    table = hard_negatives.pivot_table(x[:500], 24, float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-12))
    q, far = x[:50], table.rows(x)
    low, high = table.brackets(np.linalg.norm(q, axis=1), table.anchors(q), far, far)
    assert ((low <= q @ x.T) & (q @ x.T <= high)).all()
    rows = [(i, [float(c) for c in v], int(i) % 4) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(4)
    _, found = hard_negatives.solve(frame, F.col("vec_id") % 100 == 0, "vec_id", "v", "label", 5, 5, (80, 100, 100), 24, 500, 300, 10)
    assert found.where("quid = -1").agg(F.sum("score")).first()[0] < 0.3 * 30 * 2250


# periodic runs


def _runs(words, least=periodic.LEAST):
    seen, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e - b, q) for (b, e), q in seen.items() if e - b >= max(least, 2 * q))


def _periodic(rng, k, n):
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(2):
        if n > 3 and rng.random() < 0.6:
            a = rng.randrange(n)
            e, p = rng.randint(a, n), rng.randint(1, max(1, (n - a) // 2))
            words[a:e] = [words[a + i % p] for i in range(e - a)]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        words = _periodic(rng, rng.choice([1, 2, 3, 6]), rng.randint(0, 70))
        assert [tuple(r) for r in periodic.runs(np.array(words, np.int64)).tolist()] == _runs(words), words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_runs_of_texts_that_share_a_tree(texts):
    ids = np.concatenate([np.array(w, np.int64) + 10 * i for i, w in enumerate(texts)] or [np.zeros(0, np.int64)])
    own = np.repeat(np.arange(len(texts)), [len(w) for w in texts]).astype(np.int64)
    found = periodic.runs_of_texts(ids, own, len(texts))
    assert [[tuple(r) for r in f.tolist()] for f in found] == [_runs(w) for w in texts]


def _op12(doc_id, text):
    """The query's row, word by word."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _runs(words)
    gone = {i for b, length, q in found for i in range(b + q, b + length)}
    best = min(((-length, b, q) for b, length, q in found), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{b},{length},{q}\n" for b, length, q in found)
    return (doc_id, len(found), *top, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "a", "a " * 30, " x " * 13, "é b c\tb\r" * 9, "x\x1cy " * 12]
    texts += [" ".join(f"w{w}" for w in _periodic(rng, rng.choice([2, 4, 50]), rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t, "x", 1, [1]) for i, t in enumerate(texts)] + [(5, "p q " * 20, "x", 1, [1])] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int, runs array<int>")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(_op12(r[0], r[1])) for r in rows)
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_runs_of_a_very_long_text():
    """A million words: a period of 300,000, one word over and over, and words that never repeat."""
    n = 1_000_000
    assert periodic.runs(np.resize(np.arange(300_000), n)).tolist() == [[0, n, 300_000]]
    assert periodic.runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert not periodic.runs_of_texts(np.arange(n), np.zeros(n, np.int64), 1)[0].size
    text = "a bb ccc " * 400_000
    numbered = periodic.Numbered(text)
    assert len(numbered.ids) == 1_200_000 and numbered.digest(None) == hashlib.sha256(text.strip().encode()).hexdigest()


# fingerprints


def _digest(text):
    """A fingerprint from its definition, one triplet at a time."""
    raw = text.encode()
    counts = [0] * 256
    for at in range(len(raw)):
        for i, (b, c) in enumerate(((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))):
            if at + c < len(raw):
                h = (raw[at] * 0x9E3779B1 + raw[at + b] * 0x85EBCA77 + raw[at + c] * 0xC2B2AE3D + i * 0x27D4EB2F) % 2**32
                h ^= h >> 15
                h = h * 0x2C1B3C6D % 2**32
                counts[(h ^ h >> 13) % 256] += 1
    cuts = [sorted(counts)[k] for k in (63, 127, 191)]
    own = [sum(n > c for c in cuts) for n in counts]
    steps = sum(t <= len(raw) for t in digests.LENGTHS)
    return f"{steps:02x}" + "".join(f"{4 * a + b:x}" for a, b in zip(own[::2], own[1::2], strict=True))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200), st.integers(0, 60))
def test_fingerprints_follow_their_definition(text, settled):
    assert digests.fingerprint(text) == _digest(text)
    raw = text.encode()
    head = digests.bucket_counts(raw[:settled])
    assert (head + digests.bucket_counts(raw, len(raw[:settled])) == digests.bucket_counts(raw)).all()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "".join(random.Random(4).choices("abcdefgh éß", k=5000))
    whole = digests.fingerprint(text)
    monkeypatch.setattr(digests, "_AT_ONCE", 97)
    assert digests.fingerprint(text) == whole


def test_likeness_is_bounded_and_symmetric(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    prose = " ".join(rng.choices(words, k=400))
    other = " ".join(rng.choices([f"лес{i}" for i in range(400)], k=400))
    near = digests.likeness_of(digests.fingerprint(prose), digests.fingerprint(prose.replace("word7 ", "word8 ")))
    far = digests.likeness_of(digests.fingerprint(prose), digests.fingerprint(other))
    assert 0 <= far < 0.3 < 0.8 < near < 1 == digests.likeness_of(digests.fingerprint(prose), digests.fingerprint(prose))
    a, b = digests.fingerprint(prose), digests.fingerprint(other)
    rows = spark.createDataFrame([(a, b), (b, a), (a, None)], "a string, b string")
    assert [r[0] for r in rows.select(digests.likeness(F.col("a"), F.col("b"))).collect()] == [far, far, None]


def _chain(rows):
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: r[:2])
    out = []
    for at, (known, i, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][2]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        prints = [digests.fingerprint(t) for t in (text, edited, following)]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i if known else None, len(text), sha, *prints[:2], digests.likeness_of(prints[0], prints[1]), digests.likeness_of(prints[0], prints[2])))
    return sorted(map(repr, out))


@pytest.mark.parametrize("count", [0, 1, 2, 300])
def test_edited_chain(spark, count):
    rng = random.Random(count)
    rows = [(i * 7 % 1000 - 50, "".join(rng.choices("abcde é\U0001f600", k=rng.choice([0, 1, 3, 4, 40, 900])))) for i in range(count)]
    if count > 2:
        rows[3] = (rows[3][0], None)
        rows[4] = (None, "no id")
        rows += [rows[5], rows[5]]  # repeated rows follow each other
        rows.append((2000, "z" * 300_000))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("range", F.lit("x")).withColumn("border", F.lit(1)).repartition(5)
    got = digests.edited_chain(frame)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _chain(rows)
    alone = digests.fingerprints(frame)
    assert sorted(map(repr, map(tuple, alone.collect()))) == sorted(repr((i, len((t or "").encode()), digests.fingerprint(t))) for i, t in rows)


def test_edited_chain_with_one_id_for_a_third_of_the_rows(spark):
    rows = [(5 if i % 3 == 0 else i, f"text number {i} " * (i % 9)) for i in range(400)]
    got = digests.edited_chain(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.count() == 400 and got.where("id = 5").count() == sum(r[0] == 5 for r in rows)


def test_edits_are_told_from_neighbours(spark):
    """On the documents: the edited text is liker than the next one, where that is another text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = digests.edited_chain(docs).where("near_next < 1 and n_chars > 200").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.98 * len(rows) > 100
    assert np.median([r["near_edited"] for r in rows]) > 0.7 and np.median([r["near_next"] for r in rows]) < 0.5
