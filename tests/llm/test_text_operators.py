"""Classifiers, near-duplicates, licences and packing: brute force, held-out accuracy and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import components, langid, licenses, packing, quality, simhash, toxicity
from gleaner.llm.common import checkpoint, crc_mod, tables

SF = "/root/testdata/sf0.01"
LONG = "the quick brown fox jumps over it " * 12_000
#: Nulls in every column, empty and blank texts, repeated rows, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, uid long, score string, label int, length int, y int, fp long"
ODD = [
    (1, "Guten Tag und auf Wiedersehen, lieber Freund", "de", "s", 10, 7, 7, "x", 1, 1, 1, 1),
    (2, None, None, None, None, None, None, None, None, None, None, None),
    (None, "hello there my old friend", "en", "s", 1, 1, 1, "x", 1, 1, 1, 1),
    (3, "", "en", None, 0, 1, 1, "x", 1, 1, 1, 1),
    (4, " \n\t ", "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (5, LONG, "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (6, "1234 5678 !!", "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (7, "same text here for two rows", "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (7, "same text here for two rows", "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (8, "same text here for two rows", "en", "s", 0, 1, 1, "x", 1, 1, 1, 1),
    (None, None, None, None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_components_match_union_find(spark, held, monkeypatch):
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    rows = spark.createDataFrame([*links, (None, 4), (7, None)], "p long, q long").repartition(5)
    got = components.connected_components(rows, "p", "q").collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.connected_components(rows.where("p < 0"), "p", "q").count() == 0


def test_language_of_odd_rows(spark, odd, empty):
    (docs,) = tables(spark, SF, "documents")
    model = langid.train(docs.limit(400), per_lang=60, clusters=2)
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd, model).collect()}
    assert got[(2, None)]["lang_pred"] == got[(3, "")]["lang_pred"] == got[(6, "1234 5678 !!")]["lang_pred"] == "und"
    assert got[(2, None)]["score"] == 0 and got[(2, None)]["rejected"]
    assert got[(5, LONG)]["lang_pred"] in ("en", "de", "fr", "es") and 0 < got[(5, LONG)]["score"] <= 1
    assert got[(5, LONG)]["source"] == "s" and langid.identify(odd, model).count() == len(ODD)
    assert langid.identify(empty, model).count() == 0
    assert langid.train(empty).langs == []
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    from gleaner.llm.registry import op1_language_id

    (docs,) = tables(spark, SF, "documents")
    got = op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)])
def test_classifiers_on_held_out_documents(spark, name, label, least):
    from gleaner.llm import queries

    docs, labels = tables(spark, SF, "documents", "labels")
    got = queries()[name](spark, SF)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held["predicted"] == held[label]).mean() >= least
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, empty, module):
    docs = spark.createDataFrame([(i, f"good calm prose number {i}" if i % 2 else f"idiot scum trash {i} idiot!!") for i in range(40)], "doc_id long, text string")
    rows = [(i, i % 2, 1 - i % 2) for i in range(40)] + [(3, None, None), (None, 1, 1), (5, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = module.train(docs, labels)
    got = module.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    scores = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(scores) == 1  # null, empty and blank texts alike
    assert module.classify(empty, model).count() == 0
    for few in (labels.where("doc_id < 0"), labels.where("quality = 1 and toxic = 0")):
        got = module.classify(odd, module.train(docs, few)).collect()
        assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1


def test_words_are_seen_to_their_end():
    vectors = toxicity.Vectors({"scum*": 0, "idio*": 1}, np.ones(2), 0.1)
    for text in ("x" * 64 + "scum" + " idiocy", "\u8a9e" * 128 + "idiocy scum", "_" * 64 + "scum" + "_" * 60 + "idiots"):
        terms, weights = vectors(text)
        assert terms.tolist() == [0, 1, 2] and weights.all()
    shapes = lambda text: {int(f) for f in quality.Indicators()(text) if f < quality.SHAPES}
    plain, words = shapes("x" * 256 + "aaaa"), shapes("x" * 256 + "99!?")
    assert plain != words and shapes("x" * 256 + "99!? b") == shapes("x" * 256 + " 99!? b")
    assert shapes("one\x1ctwo\x85three\u3000four") == shapes("one two three four")


def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)

    def vector():
        t = np.append(np.sort(rng.choice(59, int(rng.integers(0, 6)), replace=False)), 59)
        w = rng.integers(1, 4, len(t)).astype(float)
        return t, w / np.sqrt(w @ w)

    for n in (0, 1, 9, 400):
        examples = [vector() for _ in range(n)]
        dense = np.zeros((n, 60))
        for i, (t, w) in enumerate(examples):
            dense[i, t] = w
        index = toxicity.BlockMaxIndex(examples, 60, block=16)
        for _ in range(60):
            t, w = vector()
            query = np.zeros(60)
            query[t] = w
            want = np.sort(dense @ query)[::-1][:7]
            _, got = index.search(t, w, 7)
            assert np.allclose(got, want[want > 0])


def _plain_neighbours(model, text, words):
    """(example, similarity, share) of the k nearest documents to a text, by dictionaries; ties for the last places share them."""
    query = dict(zip(*(a.tolist() for a in words(text)), strict=True))
    sims = [sum(query.get(t, 0.0) * w for t, w in zip(ts.tolist(), ws.tolist(), strict=True)) for ts, ws in model.vectors]
    order = sorted((i for i, s in enumerate(sims) if s > 1e-12), key=lambda i: -sims[i])
    out, left, at = [], model.k, 0
    while at < len(order) and left > 0:
        tied = [i for i in order[at:] if sims[i] > sims[order[at]] - 1e-9]
        docs = sum(model.docs[i] for i in tied)
        out += [(i, sims[i], min(1.0, left / docs)) for i in tied]
        left, at = left - docs, at + len(tied)
    return out


def test_toxicity_scores_match_brute_force(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001", "documents", "labels")
    model = toxicity.train(docs, labels, per_class=120)
    assert len(model.vocabulary) > 3
    got = {r["doc_id"]: r for r in toxicity.classify(docs, model).collect()}
    vectors = toxicity.Vectors(model.vocabulary, model.idf, model.background)
    for r in docs.collect():
        near = _plain_neighbours(model, r["text"] or "", vectors)
        w = [min(s, 1.0) ** model.power * model.weight[i] * share for i, s, share in near]
        score = (sum(v * model.toxic[i] for v, (i, _, _) in zip(w, near, strict=True)) + model.shrink * model.prior) / (sum(w) + model.shrink)
        row = got[r["doc_id"]]
        assert abs(row["score"] - score) < 1e-9
        assert np.allclose(row["similarity"], [s for _, s, _ in near][: model.k], atol=1e-9)


def test_toxicity_ties_do_not_know_the_labels(spark):
    """Of 40 equal examples half of which are toxic, all vote, whatever their ids."""
    plain = [(i, f"calm words about nothing {i}", 0) for i in range(100, 160)] + [(i, f"idiot words about nothing {i}", 1) for i in range(200, 260)]
    tied = [(i, "same old text", i % 2) for i in range(40)]
    rows = spark.createDataFrame([*plain, *tied], "doc_id long, text string, toxic int")
    model = toxicity.train(rows, rows.select("doc_id", "toxic"))
    got = toxicity.classify(spark.createDataFrame([(1, "same old text")], "doc_id long, text string"), model).first()
    swapped = rows.withColumn("toxic", F.when(F.col("doc_id") < 40, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.classify(spark.createDataFrame([(1, "same old text")], "doc_id long, text string"), toxicity.train(rows, swapped.select("doc_id", "toxic"))).first()
    assert abs(got["score"] - 0.5) < 0.02 and got["score"] == other["score"]


def test_quality_scores_match_brute_force(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001", "documents", "labels")
    model = quality.train(docs, labels, per_class=150)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, model).collect()}

    def mixed(*parts):
        out = 0
        for p in parts:
            out = (out ^ p) * 0x9E3779B97F4A7C15 % 2**64
            out ^= out >> 29
        return out

    for r in docs.collect():
        words = re.findall(r"\S{1,256}", r["text"] or "") if max(map(len, (r["text"] or "").split()), default=0) > 256 else (r["text"] or "").split()
        case = lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx" if m[0][0].isupper() else "xX"
        shapes = [zlib.crc32(re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", case, w)).encode()) for w in words]
        names = [zlib.crc32(w.lower().encode()) >> 1 for w in words]
        shapes = [1 if i and words[i - 1].lower() == w.lower() and shapes[i - 1] == shapes[i] else shapes[i] for i, w in enumerate(words)]
        features = {mixed(*shapes[i : i + k]) % quality.SHAPES for k in (1, 2, 3) for i in range(len(words) - k + 1)}
        features |= {quality.SHAPES + mixed(*names[i : i + k]) % quality.WORDS for k in (1, 2) for i in range(len(words) - k + 1)}
        margin = sum(float(np.float32(model.weights[f])) for f in features) / (len(features) + 1) ** 0.5 + model.bias
        want = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -50, 50)))
        assert abs(got[r["doc_id"]] - want) < 1e-4


def test_languages_match_brute_force(spark):
    (docs,) = tables(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs, per_lang=40)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}

    def grams(text):
        text, counts = text.lower(), {}
        signs = re.sub("\0+", "\0", "\0" + "".join(c if c.isalpha() else "\0" for c in text))
        signs = signs if text and not text[-1].isalpha() else signs + "\0"
        # a mark at either end, runs of other signs being one mark
        signs = ["\0", *("".join(c if c.isalpha() else "\0" for c in text)), "\0"]
        kept = [signs[0]] + [c for i, c in enumerate(signs[1:-1], 1) if c != "\0" or (i > 1 and signs[i - 1] != "\0")] + [signs[-1]]
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                h = 0
                for m, c in enumerate(kept[i : i + n], 1):
                    h = (h * 0x100000001B3 % 2**64) ^ (ord(c) + m)
                cell = (h * 0x9E3779B97F4A7C15 % 2**64) >> 51
                counts[cell] = counts.get(cell, 0) + 1
        return counts

    for r in docs.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        v = np.zeros(langid.SIZE)
        for cell, n in grams(r["text"]).items():
            v[cell] = np.log1p(n) * model.idf[cell]
        v /= np.linalg.norm(v)
        cosine = model.centroids.astype(float) @ v
        best = {}
        for lang, c in zip(model.langs, cosine, strict=True):
            best[lang] = max(best.get(lang, 0), c)
        row = got[r["doc_id"]]
        assert abs(row["score"] - max(best.values())) < 1e-4 and best[row["lang_pred"]] > max(best.values()) - 1e-4


def test_grams_do_not_depend_on_slices(monkeypatch):
    texts = ["ab  c1d ee", " x", "x ", "1 2", "a", "ab", "abc 12 def, ghi" * 20, "\U00030001\U0003134a word", ""]
    want = [langid.Grams()(t) for t in texts]
    assert want[3] is None and want[-1] is None and want[-2] is not None
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_SLICE", size)
        for t, w in zip(texts, want, strict=True):
            g = langid.Grams()(t)
            assert (g is None and w is None) or (g == w).all()


def test_rare_letters_and_many_languages(spark):
    rows = [(i, "\U00030001\U00030002\U00030003 " * 5, "rare") for i in range(30)] + [(100 + i, f"plain words {i}", "en") for i in range(30)]
    rows += [(1000 + i, chr(0x4E00 + i) * 3, f"l{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, clusters=2)
    assert len(set(model.langs)) == 1202
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[0] == "rare" and got[100] == "en"
    assert sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


def test_columns_of_any_name_are_left_alone(spark):
    names = ["_found", "_judged", "_id", "_hash", "_n", "_score", "score2", "fp", "component", "salt", "rows"]
    docs = spark.createDataFrame([(1, "good words here", *names), (2, "idiot words there", *names), (2, "idiot words there", *names)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (
        langid.identify(docs, langid.train(docs.withColumn("lang", F.lit("en")))), toxicity.classify(docs, toxicity.train(docs, labels)),
        quality.classify(docs, quality.train(docs, labels)), simhash.representatives(docs),
    ):
        kept = out.select(*names).collect()
        assert kept and all(list(r) == names for r in kept)
    assert simhash.representatives(docs).columns == docs.columns and simhash.representatives(docs).count() == 2


def test_very_long_texts(spark):
    rows = [(1, "word " * 900_000), (2, "x" * 4_000_000), (3, "idiot " * 700_000), (4, "語" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labelled = spark.createDataFrame([(i, f"good calm prose number {i}" if i % 2 else f"idiot scum trash {i} idiot!!") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.classify(docs, toxicity.train(labelled, labels)).where("doc_id = 3").collect()} == {1}
    assert quality.classify(docs, quality.train(labelled, labels)).where("score between 0 and 1").count() == 4
    assert langid.identify(docs, langid.train(labelled.withColumn("lang", F.lit("en")))).where("lang_pred = 'en'").count() >= 2
    assert simhash.near_duplicates(docs).select("fp").distinct().count() == 4


def _plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition():
    texts = [None, "", "One", "a B c", "ÀÉ Ab  c d e\x0bf g", *(r[1] for r in ODD[:1]), "x y z " * 50, "\x1c a b c d e"]
    for text in texts:
        assert simhash.fingerprint(text) == _plain_fingerprint(text)


@pytest.mark.parametrize("dense", [2, 64])
def test_simhash_components_match_brute_force(spark, dense, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64)
    values = []
    for b in base:
        at = b
        for _ in range(int(rng.integers(1, 25))):  # chains that wander, and clouds around a centre
            bits = rng.choice(64, int(rng.integers(0, 6)), replace=False).astype(np.uint64)
            at = (b if rng.random() < 0.5 else at) ^ np.bitwise_or.reduce(np.uint64(1) << bits) if len(bits) else at
            values.append(at)
    values = np.unique(np.array(values, np.uint64))
    parent = np.arange(len(values))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 4) + i + 1:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = components.connected_components(simhash.fingerprint_links(fps, dense=dense), "fp", "other").collect()
    of = {r["node"]: r["component"] for r in got}
    signed = values.view(np.int64).tolist()
    want, have = {}, {}
    for i, v in enumerate(signed):
        want.setdefault(root(i), set()).add(v)
        have.setdefault(of.get(v, v), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    blank = [r for r in got if r["fp"] == 0]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {2}  # null, empty, blank
    same = [r["component_id"] for r in got if r["id"] in (7, 8)]
    assert same == [7, 7, 7]
    lone = [r for r in got if r["id"] is None and r["fp"] != 0]
    assert len(lone) == 1 and lone[0]["component_id"] is None
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "5", "6", "7"])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def _plain_licenses(text, least=0.8):
    folded = "".join(c.lower() if c.isascii() else c for c in text)
    blocks = re.split("\n[ \t\r]*\n", folded)
    bare = lambda b: "\n".join(x for x in b.split("\n") if not re.search("^[^a-z0-9]*copyright[^a-z].*[0-9]{4}", x))
    units = [("line", i, x) for i, x in enumerate(folded.split("\n"))] + [("block", i, bare(b)) for i, b in enumerate(blocks) if "\n" in b]
    units += [("text", 0, bare(folded))] if len(blocks) > 1 else []
    for unit, no, body in units:
        words = re.findall("[a-z0-9]+", body)
        own = set(zip(words, words[1:], strict=False))
        best = []
        for name, template in licenses.TEMPLATES.items():
            grams = {tuple(g.split(" ")) for g in licenses.bigrams(template)}
            best.append((-2 * len(own & grams) / (len(own) + len(grams)), name))
        if own and -min(best)[0] >= least:
            yield unit, no, min(best)[1], round(-min(best)[0], 6)


def test_license_scan_matches_brute_force(spark, odd, empty):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    half = mit.split(" ")
    texts = [
        "prose\nReleased under the MIT License.\nmore prose", f"Copyright (c) 2020 Some Body\n{mit[:400]}\n{mit[400:]}\n\nunrelated words here",
        f"Copyright (C) 1999 A\n\n{apache[:300]}\n\n{apache[300:]}", " ".join(half[: len(half) // 3]), "licensed UNDER the apache license version 2.0", "of the of the of the",
        "This work is licensed under the GNU General Public License, version 3.", LONG,
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, unit string, n int")
    got = sorted((r["id"], r["unit"], r["unit_no"], r["license"], round(r["dice"], 6)) for r in licenses.scan(docs).collect())
    want = sorted((i, *hit) for i, t in enumerate(texts) for hit in _plain_licenses(t))
    assert got == want and {g[3] for g in got} >= {"MIT", "MIT-line", "Apache-2.0-header", "Apache-2.0-line", "GPL-3.0-line"}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def _plain_runs(text, known, least):
    """Runs of blocks by brute force: for each template, of the runs that overlap the best one."""
    blocks = re.split("\n[ \t\r]*\n", text.lower())
    bare = ["\n".join(x for x in b.split("\n") if not re.search("^[^a-z0-9]*copyright[^a-z].*[0-9]{4}", x)) for b in blocks]
    words = [(no, w) for no, b in enumerate(bare) if (w := re.findall("[a-z0-9]+", b))]
    found = {}
    for name, grams in sorted(known.items()):
        runs = []
        for i in range(len(words)):
            for j in range(i, len(words)):
                own = [w for _, block in words[i : j + 1] for w in block]
                own = {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}
                dice = 2 * len(own & set(grams)) / (len(own) + len(grams))
                if own and dice >= least:
                    runs.append((-dice, j - i, i, j))
        kept = []
        for _, size, i, j in (r for r in sorted(runs)):
            if all(j < a or b < i for a, b, _ in kept):
                kept.append((i, j, size))
        for i, j, size in kept:
            if size and (i or j < len(words) - 1):
                dice = -next(r[0] for r in runs if r[2:] == (i, j))
                found[(i, j)] = min(found.get((i, j), (0, "")), (-dice, name))
    return sorted((words[i][0], name, round(-less, 6)) for (i, _), (less, name) in found.items())


def test_license_notice_of_several_blocks_within_a_document(spark):
    words = licenses.TEMPLATES["MIT"].split(" ")
    at = [words.index("The"), words.index("THE")]
    mit = "\n\n".join(" ".join(words[a:b]) for a, b in zip([0, *at], [*at, None], strict=True))
    gpl = licenses.TEMPLATES["GPL-3.0-header"].replace("version. This", "version.\n  \nThis").replace("PURPOSE. See", "PURPOSE.\n\nSee")
    prose = "\n\n".join(f"Some paragraph number {k} of a guide that says nothing at all of rights" for k in range(30))
    texts = [f"{prose}\n\nCopyright (c) 2020 A\n\n{mit}\n\n{prose}\n\n{gpl}\n\n{prose}", mit, prose, f"Released under\n\nthe MIT License.\n\n{prose}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(docs).where("unit = 'run'").orderBy("id", "unit_no").collect()]
    assert [g[:4] for g in got] == [(0, "run", 31, "MIT"), (0, "run", 64, "GPL-3.0-header"), (3, "run", 0, "MIT-line")]
    assert all(g[4] > 0.99 for g in got)


def test_complete_license_files_are_found(spark):
    """Files as they lie in repositories: title, copyright line, the licence's own blocks; the short ones also within other text."""
    prose = "\n\n".join(f"Some paragraph number {k} of a guide that says nothing at all of rights" for k in range(25))
    titles = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MIT": "MIT License", "ISC": "ISC License"}
    rows, want = [], {}
    for name in [*licenses.TEXTS, "MIT"]:
        text = licenses.TEMPLATES[name]
        head = f"{titles[name]}\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" if name in titles else ""
        rows.append((len(rows), head + text))
        want[rows[-1][0]] = ("text" if "\n\n" in head + text else "block", name)
        if name in titles:
            rows.append((len(rows), f"{prose}\n\nCopyright (c) 2021, Some Body\n\n{text}\n\n{prose}"))
            want[rows[-1][0]] = ("run", name)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["id"], set()).add((r["unit"], r["license"]))
    for i, (unit, name) in want.items():
        assert any(n == name and (u == unit or unit == "run") for u, n in got.get(i, ())), (i, unit, name, got.get(i))


def test_license_runs_match_brute_force(spark):
    rng = random.Random(8)
    templates = {"A": "a b c d e f g h", "B": "a b c d e f g x y", "C": "c a c b c d", "D": "a b"}
    known = {name: licenses.bigrams(t) for name, t in templates.items()}
    texts = []
    for k in range(400):
        words = [w for _ in range(rng.randrange(1, 5)) for w in rng.choice([*templates.values(), "c d q", "u v", "a b"]).split(" ")]
        words = [w if rng.random() < 0.96 else rng.choice("abcuv") for w in words]
        text = "".join(w + rng.choice([" ", " ", "\n", "\n\n", "\n \n\n"] if k % 2 else [" ", " ", " ", "\n\n"]) for w in words)
        texts.append(text + rng.choice(["", "\n\n!\n\nCopyright 1999\n\na b c", "\n\n" + text]))
    for least in (0.6, 0.8):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = licenses.scan(docs, least=least, templates=templates).where("unit = 'run'").collect()
        got = sorted((r["id"], r["unit_no"], r["license"], round(r["dice"], 6)) for r in rows)
        assert got == sorted((i, *hit) for i, t in enumerate(texts) for hit in _plain_runs(t, known, least)) and len(got) > 100


def test_packing_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tokenizer, encode, end = Tokenizer.from_file(path), packing.ByteBpe(path), "<|endoftext|>"
    texts = ["", "a  b   c \n d", " lead", "trail ", "don't 'll 12", "日本 é\x00", "\x1c x \x85y", "naïve ²Ⅷ", f"a {end} b", f"{end} x", f"x  {end}", end, end * 3]
    texts += [f"{end}a{end}", f"  {end}\n\n{end} 's", "<|endoftext", "<|<|endoftext|>|>", f"é{end}日"]
    rng = random.Random(4)
    parts = [end, " ", "  ", "\n", "word", "'s", "12", "é", "<|", "|>", "endoftext", "日本"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(400)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[8] == [64, 220, 50256, 275]
    block = packing.BLOCK
    for size in (block, 7, 50):  # blocks begin and end within and around the special string
        try:
            packing.BLOCK = size
            assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want
            text = f"some words  and\n more é {end} " * 40
            assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        finally:
            packing.BLOCK = block


def test_special_strings_within_pieces(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    texts = [(1, "one <|endoftext|> two"), (2, "<|endoftext|>" * 3000), (3, "word " * 5000 + "<|endoftext|>")]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), with_ids=True).collect()
    for doc_id, text in texts:
        got = [i for r in sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"]) for i in r["ids"]]
        assert got == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, 3000) if seed else rng.choice([5, 33, 40, 60, 64], 900), minlength=65)
    planned = packing.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for pattern, n in planned.items():
        assert sum(pattern) <= 64 and n > 0
        np.add.at(used, list(pattern), n)
    assert (used == counts).all()
    best_fit = sum(packing._best_fit(counts, 64).values())
    assert sum(planned.values()) <= best_fit * 1.01 + 1
    assert packing.plan(np.zeros(65, np.int64), 64) == {}


def _check_packed(rows, docs, capacity, encode):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text in docs:
        ids = encode(text or "") + np.array([2], "<u4").tobytes()
        n, at, k = len(ids) // 4, 0, 0
        while at < n:
            size = (n % capacity or capacity) if k == 0 else capacity
            want.append((str(doc_id), k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            at, k = at + size, k + 1
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    return len(by_sequence), sum(w[3] for w in want)


def test_packing_of_odd_rows(odd, empty):
    encode = packing.ByteBpe(packing.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(odd, capacity=256, with_ids=True, max_groups=2).collect()
    sequences, tokens = _check_packed(rows, [(r[0], r[1]) for r in ODD], 256, encode)
    assert sequences == -(-tokens // 256)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(empty).count() == 0


def test_packing_of_the_documents(spark):
    (docs,) = tables(spark, SF, "documents")
    encode = packing.ByteBpe(packing.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    sequences, tokens = _check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024, encode)
    assert sequences <= -(-tokens // 1024) + 5


def test_crc_mod_of_nulls(spark):
    rows = spark.createDataFrame([(17,), (None,)], "i long").select(crc_mod(F.col("i"), 4).alias("m")).collect()
    assert rows[0]["m"] == zlib.crc32(b"17") % 4 and rows[1]["m"] is None


def _prose(rng, words):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words))


def test_complete_licences_within_longer_documents(spark):
    """Every licence text between as many words again of other paragraphs, two of them in one document, and one changed here and there."""
    rng, rows = random.Random(11), []
    for i, name in enumerate([*licenses.TEXTS, "MIT"]):
        text = licenses.TEMPLATES[name]
        half = len(text.split()) // 2
        around = ["\n\n".join(_prose(rng, min(60, half)) for _ in range(max(1, half // 60))) for _ in range(2)]
        rows.append((i, f"{around[0]}\n\n{text}\n\n{around[1]}", name))
    two = "\n\n".join(f"{licenses.TEMPLATES[n]}\n\n" + "\n\n".join(_prose(rng, 50) for _ in range(40)) for n in ("BSD-3-Clause", "LGPL-3.0", "MPL-2.0"))
    changed = [w if rng.random() > 0.04 else "changed" for w in licenses.TEMPLATES["CC0-1.0"].split(" ")]
    rows += [(50, two, None), (51, f"{_prose(rng, 300)}\n\n{' '.join(changed)}\n\n{_prose(rng, 300)}", "CC0-1.0"), (52, "\n\n".join(_prose(rng, 50) for _ in range(200)), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for held in (licenses.HELD, 3000):
        found = {}
        for r in licenses.scan(docs, held=held).where("unit <> 'text'").collect():
            found.setdefault(r["id"], set()).add(r["license"])
        for i, _, name in rows:
            assert name is None or name in found.get(i, ()), (held, i, name, found.get(i))  # MIT is one line here
        assert found[50] >= {"BSD-3-Clause", "LGPL-3.0", "MPL-2.0"} and 52 not in found


@pytest.mark.parametrize("held", [150, 900])
def test_texts_taken_apart_as_rows_give_the_same_units(spark, held):
    rng, rows = random.Random(held), []
    pieces = [*licenses.NOTICES.values(), *(licenses.TEMPLATES[n][:900] for n in ("MIT", "ISC")), "Copyright (c) 2020 A", "", "", " \t", "x", "plain words here", "MIT " * 90]
    for i in range(40):
        parts = [rng.choice(pieces).replace(". ", rng.choice([". ", ".\n", ".\n\n"])) for _ in range(rng.randint(1, 12))]
        rows.append((i, rng.choice(["\n", "\n\n", "\n\n\n"]).join(parts) + rng.choice(["", "\n", "\n\n"])))
    rows += [(100, None), (101, ""), (102, "\n" * 2000), (103, "\n\n" + licenses.NOTICES["Apache-2.0-header"] + "\n" * 900), (104, rows[0][1]), (104, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda h: sorted((str(r["id"]), r["unit"], r["unit_no"], r["license"], round(r["dice"], 9)) for r in licenses.scan(docs, held=h).where("unit <> 'run'").collect())
    whole = told(licenses.HELD)
    assert told(held) == whole and {u for _, u, *_ in whole} == {"line", "block", "text"}


def test_scored_runs_are_those_of_brute_force(spark):
    """Sums of scores, rises and coefficients worked out in Python."""
    rng, known = random.Random(3), {"a": [f"a{i} a{i + 1}" for i in range(40)], "b": [f"b{i} b{i + 1}" for i in range(30)]}
    rows, want = [], []
    for doc in range(30):
        blocks = []
        for _ in range(rng.randint(2, 14)):
            letter, at, n = rng.choice("aabx"), rng.randint(0, 25), rng.randint(1, 15)
            blocks.append([f"{letter}{at + k}" if rng.random() > 0.05 else "odd" for k in range(n)])
        rows += [(doc, doc, no, b) for no, b in enumerate(blocks)]
        kept = {}
        for name, grams in known.items():
            pairs = [set(f"{x} {y}" for x, y in zip(b, b[1:], strict=False)) for b in blocks]
            total, low, rises = 0, None, []
            for no, p in enumerate(pairs):
                if low is None or total < low:
                    low = total
                    rises.append([no, no, None, 0])
                total += 20 * len(p & set(grams)) - 14 * len(p)
                rises[-1][3] += len(p & set(grams))
                if rises[-1][2] is None or total > rises[-1][2]:
                    rises[-1][1:3] = no, total
                rises[-1].append(low)
            for i, j, top, hits, lowest, *_ in rises:
                if top <= lowest or j <= i or hits < min(licenses.admissible(len(grams), 0.6)) or (i == 0 and j == len(blocks) - 1):
                    continue
                words = [w for b in blocks[i : j + 1] for w in b]
                own = set(f"{x} {y}" for x, y in zip(words, words[1:], strict=False))
                dice = 2 * len(own & set(grams)) / (len(own) + len(grams))
                if dice >= 0.6:
                    kept[i, j] = min(kept.get((i, j), (0, "")), (-dice, name))
        want += [(doc, i, name, round(-less, 9)) for (i, _), (less, name) in kept.items()]
    frame = spark.createDataFrame(rows, "key long, id long, no int, words array<string>")
    got = licenses._scored_runs(frame, known, 0.6).select("id", "unit_no", "best.license", F.round(-F.col("best.less"), 9).alias("dice")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_runs_do_not_depend_on_how_texts_are_taken_apart(spark):
    """Templates of both kinds, runs over many groups of blocks, blocks of more than ``held`` characters, repeated blocks between."""
    rng = random.Random(17)
    templates = {"A": "a b c d e f g h", "B": "a b c d e f g x y", "C": "c a c b c d", "D": "a b", "E": "p q r s", "L": " ".join(f"l{k}" for k in range(450))}
    known, texts = {name: licenses.bigrams(t) for name, t in templates.items() if name != "L"}, []
    for k in range(24):
        parts = []
        for _ in range(rng.randrange(2, 14)):
            words = rng.choice([*list(templates.values())[:5], "c d", "u v", "z z z z", " ".join(f"n{rng.randrange(10**6)}" for _ in range(25))]).split(" ")
            parts.append("".join(w + rng.choice([" ", " ", "\n", "\n\n", "\n \n\n"]) for w in words) * rng.choice([1, 1, 1, 4]))
        texts.append("\n\n".join(parts))
    long = "".join(w + ("\n\n" if k % 90 == 70 else " ") for k, w in enumerate(templates["L"].split(" ")) if k % 40)
    other = "\n\n".join(" ".join(f"n{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    texts += [f"{other}\n\n{long}\n\nz\n\n{other}", "c d\n\n" * 30, "p q\n\n" + "y y\n\n" * 40 + "r s\n\nend of", "p q\n\n" + "y " * 200 + "\n\nr s\n\nend"]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[3]), (100, texts[3]), (None, texts[4])], "doc_id long, text string")
    told = lambda held: sorted((str(r["id"]), r["unit"], r["unit_no"], r["license"], round(r["dice"], 9)) for r in licenses.scan(docs, templates=templates, held=held).collect())
    whole = told(licenses.HELD)
    assert {(u, n) for _, u, _, n, _ in whole} >= {("run", n) for n in "ACEL"}
    for i, text in enumerate(texts[:24]):
        assert sorted(_plain_runs(text, known, 0.8)) == sorted((no, n, round(d, 6)) for key, u, no, n, d in whole if key == str(i) and u == "run")
    assert told(8) == whole


def test_of_runs_that_overlap_the_best_stay(spark):
    """Chains of equal runs, which depend on each other from first to last, and runs of all lengths."""
    rng, rows, want = random.Random(2), [], []
    for key in range(12):
        runs = {(i, i + 3): (-0.9, 3) for i in range(0, 60, 2)} if key % 3 == 0 else {}
        for _ in range(40 if key else 0):
            i, size = rng.randrange(60), rng.randrange(6)
            runs[i, i + size] = (-rng.choice([0.8, 0.9, 0.95]), size)
        kept = []
        for (i, j), _ in sorted(runs.items(), key=lambda r: (*r[1], *r[0])):
            if all(j < a or b < i for a, b in kept):
                kept.append((i, j))
        rows += [(key, "x", less, size, i, j) for (i, j), (less, size) in runs.items()]
        want += [(key, i, j) for i, j in kept]
    frame = spark.createDataFrame(rows, "key long, license string, less double, blocks int, i int, j int")
    assert sorted(tuple(r) for r in licenses._apart_runs(frame).select("key", "i", "j").collect()) == sorted(want)


def test_one_very_long_text_of_short_lines(spark):
    """Millions of lines in one text, with a licence in the midst."""
    text = "some line\n" * 400_000 + "\n" + licenses.TEMPLATES["MIT"] + "\n\n" + "other words\n" * 400_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r["unit"], r["license"]) for r in licenses.scan(docs).collect()}
    assert any(name == "MIT" for _, name in got)


def test_hubs_are_split_in_joins(spark):
    from gleaner.llm.common import split_join

    links = [(0, i) for i in range(1, 4000)] + [(i, i + 1) for i in range(5000, 5200)] + [(3999, 7000), (7000, 7001)]
    frame = spark.createDataFrame([(b, a) for a, b in links], "a long, b long").repartition(7)
    small = frame.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    joined = split_join(frame, small, "b", "a", "n", len(links))
    assert "salt" in joined._jdf.queryExecution().toString() and sorted(joined.columns) == ["a", "b", "m"]
    assert joined.count() == len(links) and joined.where("b = 0 and m = 1").count() == 3999
    edges = checkpoint(frame.select("a", "b"))
    star = sorted(map(tuple, components._star(edges, True, len(links)).collect()))
    assert len(star) == len(set(star)) and (7001, 3999) in star
    got = {r["node"]: r["component"] for r in components.connected_components(frame, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(4000)) and got[7001] == 0 and all(got[i] == 5000 for i in range(5000, 5201)) and len(got) == 4000 + 2 + 201


def test_scores_are_calibrated_on_documents_held_out(spark):
    """Of held-out documents with a score in each tenth, the share of label 1 is near the mean score (toxicity and quality)."""
    from gleaner.llm.common import crc_mod, tables

    docs, labels = tables(spark, "/root/testdata/sf0.1", "documents", "labels")
    for module, label, modulus, held in ((toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)):
        part = crc_mod(F.col("doc_id"), modulus)
        model = module.train(docs, labels, part != held, per_class=600)
        known = docs.where(part == held).join(labels.select("doc_id", F.col(label).alias("y")).dropDuplicates(["doc_id"]), "doc_id")
        rows = module.classify(known.select("doc_id", "text", "y"), model).select("score", "y").toPandas()
        error, n = 0.0, len(rows)
        for _, own in rows.groupby((rows["score"] * 10).clip(upper=9).astype(int)):
            error += len(own) / n * abs(own["score"].mean() - own["y"].mean())
        assert n > 500 and error < 0.05, (label, error)
        assert ((rows["score"] - rows["y"]) ** 2).mean() < 0.04
