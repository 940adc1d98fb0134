"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Compared are the lines of a text, its blocks (lines between blank ones, when there are two or
more lines), the whole text (when there are two or more blocks) and every run of consecutive
blocks, as a notice has its own blank lines.  Normalising folds
case and every run of other characters than a-z and 0-9 to one space; blocks, runs and whole
texts also lose their copyright lines, which differ from holder to holder.  The
coefficient of two sets of bigrams of sizes a and b is at most 2 min(a, b) / (a + b), so a
template of b bigrams needs to be compared only with units of t b / (2 - t) to
(2 - t) b / t bigrams, t being the least coefficient wanted.  These admissible sizes form
a small fixed table that is joined by equal size.

A unit that reaches t shares at least t b / (2 - t) bigrams with the template, so of any larger
share of a template's bigrams it has at least one.  A few words are chosen that touch
such a share of every template; a text (or unit) without any of them is left out before it is
taken apart, and can match nothing.

Runs that may be templates of more than 400 bigrams (the long licence texts) are found by scores: a block with g bigrams of
which h are the template's counts 20 h - 14 g, so it counts for the run if seven tenths are the template's.  Sums of blocks in order
rise through a licence and fall through anything else; each rise, from the lowest sum so far to the highest before a
lower one, is a run, and its coefficient is computed exactly.

Of the runs of the other templates that overlap and reach t for one template the best stays (of equal ones the one of fewer
blocks, then the first); one that is a single block or holds all words of the text is reported as such.  A run
whose first or last block adds no bigram of the template is never better than the one without that block, so
runs begin and end with blocks that add one.  A run thus ends before the bigrams that its first block
adds are found again, which keeps the work in proportion to the text times the bigrams of a template.

Texts of more than ``held`` characters are cut into pieces at line ends and taken apart as rows: lines, blocks by a running count of
the blank lines between, bigrams of units that are too long for one row as distinct rows; so no row holds more than about ``held`` characters.
Their runs are the same: those of the short templates begin in groups of consecutive blocks, which see as much of what follows as any run may
hold, and the ones that overlap, which may be a chain through the whole text, are settled in rounds.

Everything is built-in DataFrame functions.
"""

from __future__ import annotations

import math
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint

#: Public licence notices and a short licence text, without copyright lines.
NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-line": "Released under the BSD License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-line": "This is free and unencumbered software released into the public domain.",
}

#: Complete public licence texts, each a file of that name.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
TEMPLATES = NOTICES | {name: files("gleaner.llm").joinpath(f"license_texts/{name}.txt").read_text("utf-8") for name in TEXTS}

LEAST = 0.8
#: Runs of blocks that may be templates of more bigrams are found by scores.
RUN_MOST = 400
#: What a block counts for a run: for each of its bigrams, and for each that is the template's.
_COST, _HIT = 14, 20
#: Texts and units of more characters are taken apart as rows, in pieces of at most ``_PIECE``.
HELD, _PIECE = 1 << 20, 1 << 18
_COPYRIGHT = "^[^a-z0-9]*copyright[^a-z].*[0-9]{4}"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def admissible(size: int, least: float) -> range:
    """Sizes of sets that can reach ``least`` against a set of ``size``."""
    return range(max(1, math.ceil(least * size / (2 - least) - 1e-9)), math.floor((2 - least) * size / least + 1e-9) + 1)


def anchors(grams: list[list[str]], least: float) -> list[str]:
    """Words of five letters or more (any, where these do not do) of which every unit that matches has one."""
    left = []
    for own in grams:
        shared = math.ceil(least * len(own) / (2 - least) - 1e-9)
        left.append((set(own), len(own) - shared + 1))
    chosen: list[str] = []
    for shortest in (5, 1):
        while True:
            gain: dict[str, int] = {}
            for own, need in left:
                for gram in own if need > 0 else ():
                    for word in set(gram.split(" ")):
                        if len(word) >= shortest:
                            gain[word] = gain.get(word, 0) + 1
            if not gain:
                break
            word = min(gain, key=lambda w: (-gain[w], w))
            chosen.append(word)
            left = [({g for g in own if word not in g.split(" ")}, need - sum(word in g.split(" ") for g in own)) for own, need in left]
    # a word within another makes the longer one needless
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def telling(grams: list[list[str]], least: float) -> tuple[list[str], int]:
    """Words, and how many of them every unit that matches one of the templates has at least.

    Of each template those words of five letters or more (of any length, where these do not do) are taken that are in most
    of its bigrams.  All bigrams of a word that is not there are missing, and a match misses at most b - t b / (2 - t) of b.
    """
    words: dict[str, None] = {}
    fewest = None
    for own in grams:
        slack = len(own) - math.ceil(least * len(own) / (2 - least) - 1e-9)
        for shortest in (5, 1):
            holds: dict[str, set[str]] = {}
            for gram in own:
                for word in gram.split(" "):
                    if len(word) >= shortest:
                        holds.setdefault(word, set()).add(gram)
            weight, counted, chosen = [], set(), []
            for word in sorted(holds, key=lambda w: (-len(holds[w]), w)):
                # a bigram of two of the words counts with the first only
                weight.append(len(holds[word] - counted))
                counted |= holds[word]
                chosen.append(word)
                if len(counted) >= 1.5 * slack + 1:
                    break
            if len(counted) > slack:
                break
        present, left = 0, len(counted) - slack
        for w in sorted(weight, reverse=True):
            if left <= 0:
                break
            present, left = present + 1, left - w
        words |= dict.fromkeys(chosen)
        fewest = present if fewest is None else min(fewest, present)
    return list(words), fewest or 0


def _has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def _constant(strings: list[str]) -> Column:
    """A constant array, as one literal that is taken apart when the query is planned."""
    return F.split(F.lit("\n".join(strings)), "\n")


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")


def _bare(text: Column) -> Column:
    """A lower-case text without its copyright lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(_COPYRIGHT)), "\n")


def _units(text: Column) -> Column:
    """array<struct<unit, unit_no, body>> of a lower-case text; lines, blocks and the whole count from 0."""
    lower = text
    lines = F.split(lower, "\n", -1)
    blocks = F.split(lower, "\n[ \t\r]*\n", -1)

    def unit(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda body, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("unit_no"), body.alias("body")))

    many = F.transform(blocks, lambda b: F.when(b.contains("\n"), _bare(b)))
    whole = F.when(F.size(blocks) > 1, F.array(_bare(lower)))
    none = F.array().cast("array<struct<unit:string,unit_no:int,body:string>>")
    return F.concat(unit("line", lines), unit("block", many), F.coalesce(unit("text", whole), none))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _tail(items: Column, first: Column | int) -> Column:
    return F.slice(items, F.lit(first), F.greatest(F.size(items) - first + 1, F.lit(0)))


def _ends(seen: Column, i: Column, size: Column, license: Column, least: float) -> Column:
    """array<struct<less, blocks, i, j, license>>: runs from block i that reach ``least`` for a template of ``size`` bigrams.

    ``seen`` has j and hit of the distinct bigrams from i on, in order: the block that completes one, whether it is the template's.
    """
    scored = F.transform(
        F.array_distinct(F.filter(seen, lambda x: x["hit"])["j"]),
        lambda j: F.struct(
            (-2.0 * F.size(F.filter(seen, lambda x: x["hit"] & (x["j"] <= j))) / (F.size(F.filter(seen, lambda x: x["j"] <= j)) + size)).alias("less"),
            (j - i).alias("blocks"), i.alias("i"), j.alias("j"), license.alias("license"),
        ),
    )
    return F.filter(scored, lambda r: -r["less"] >= least)


def _runs_of(known: Column, toks: Column, grams: Column, at: Column, least: float) -> Column:
    """array<struct<less, blocks, i, j, license>>: what stays of the runs of blocks i to j that reach ``least`` for one template."""
    shared_grams = F.array_distinct(F.array_sort(F.filter(grams, lambda x: F.array_contains(known["grams"], x["gram"]))))

    def limits(hits: Column) -> Column:
        """(i, limit): a run from block i adds a bigram by it only if it ends before the block ``limit``."""

        def of(x: Column, k: Column) -> Column:
            # hits are in order of bigram and block, and have at most two of the same bigram and first block
            after, second = F.get(hits, k + 1), F.get(hits, k + 2)
            other = F.when((after["gram"] == x["gram"]) & (after["i"] == x["i"]), second).otherwise(after)
            found = F.when(other["gram"] == x["gram"], other["j"])
            return F.struct(x["i"].alias("i"), (-F.coalesce(found, F.size(at) - 1)).alias("less"))

        ordered = F.array_sort(F.transform(hits, of))
        firsts = lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["i"] != x["i"]))
        return _let(ordered, firsts)

    def from_start(start: Column) -> Column:
        low, end = F.get(at, start["i"]), F.get(at, -start["less"])
        window = F.slice(grams, low + 1, F.greatest(end - 1 - low, F.lit(0)))
        # bigrams beyond the largest admissible number make no difference
        near = lambda w: _let(F.slice(w, F.lit(1), 4 * known["most"]), lambda part: F.when(F.size(F.array_distinct(part["gram"])) > known["most"], part).otherwise(w))

        def ends(w: Column, named: Column) -> Column:
            first = F.transform(
                F.slice(F.array_distinct(named), F.lit(1), known["most"] + 1),
                lambda g: F.struct(
                    F.get(w, (F.array_position(named, g) - 1).cast("int"))["j"].alias("j"), F.array_contains(known["grams"], g).alias("hit")
                ),
            )
            return _let(first, lambda seen: _ends(seen, start["i"], F.size(known["grams"]), known["license"], least))

        return _let(_let(window, near), lambda w: _let(w["gram"], lambda named: ends(w, named)))

    def apart(runs: Column) -> Column:
        overlap = lambda a, b: (a["i"] <= b["j"]) & (b["i"] <= a["j"])
        many = F.filter(runs, lambda r: r["blocks"] > 0)
        # single blocks count only where a run could be instead
        rivals = _let(many, lambda m: F.array_sort(F.filter(runs, lambda r: F.exists(m, lambda q: overlap(q, r)))))
        best = lambda a: F.aggregate(
            a, F.slice(a, F.lit(1), F.lit(0)),
            lambda kept, r: F.when(F.exists(kept, lambda q: overlap(q, r)), kept).otherwise(F.concat(kept, F.array(r))),
        )
        return F.filter(_let(rivals, best), lambda r: r["blocks"] > 0)

    starts = _let(shared_grams, limits)
    return _let(F.flatten(F.transform(starts, from_start)), apart)


def _runs(folded: DataFrame, known: dict[str, list[str]], least: float) -> DataFrame:
    """(id, unit, unit_no, best): runs of two or more blocks that reach ``least``, as ``run`` with the number of the first block."""
    known = {name: grams for name, grams in known.items() if 0 < len(grams) <= RUN_MOST}
    if not known:
        return folded.select("id", F.lit("run").alias("unit"), F.lit(0).alias("unit_no"), F.lit(None).cast("struct<less:double,license:string>").alias("best")).where("false")
    every = list(dict.fromkeys(g for grams in known.values() for g in grams))
    templates = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"), _constant(grams).alias("grams"),
                F.lit(min(admissible(len(grams), least))).alias("least"), F.lit(max(admissible(len(grams), least))).alias("most"),
            )
            for name, grams in sorted(known.items())
        )
    )
    blocks = F.filter(
        F.transform(
            F.split("folded", "\n[ \t\r]*\n", -1),
            lambda b, no: F.struct(no.cast("int").alias("no"), F.filter(_words(_bare(b)), lambda w: w != "").alias("words")),
        ),
        lambda b: F.size(b["words"]) > 0,
    )
    pairs = lambda words: F.array_distinct(F.zip_with(words, _tail(words, 2), lambda a, b: F.concat_ws(" ", a, b)))
    shared = lambda words: F.array_intersect(pairs(words), _constant(every))
    wanted = lambda hits: F.filter(templates, lambda c: F.size(F.array_intersect(c["grams"], hits)) >= c["least"])

    apart = folded.where(F.col("folded").rlike("\n[ \t\r]*\n")).select("id", F.explode(F.array(blocks)).alias("b")).where(F.size("b") > 1)
    chosen = apart.select("id", "b", F.explode(F.array(_let(_let(F.flatten("b.words"), shared), wanted))).alias("wanted"))
    chosen = chosen.where(F.size("wanted") > 0)

    def found(toks: Column) -> Column:
        numbered = F.transform(toks, lambda t, p: F.struct(t["d"].alias("d"), p.alias("p")))
        begins = _let(numbered, lambda a: F.filter(a, lambda t, k: (k == 0) | (F.get(a, k - 1)["d"] != t["d"]))["p"])
        at = F.concat(begins, F.array(F.size(toks)))
        grams = F.zip_with(
            F.slice(toks, F.lit(1), F.size(toks) - 1), _tail(toks, 2),
            lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("gram"), a["d"].alias("i"), b["d"].alias("j")),
        )
        each = lambda g, a: F.flatten(F.transform("wanted", lambda c: _runs_of(c, toks, g, a, least)))
        return _let(grams, lambda g: _let(at, lambda a: each(g, a)))

    def best(runs: Column) -> Column:
        same = lambda q, r: (q["i"] == r["i"]) & (q["j"] == r["j"])
        better = lambda q, r: (q["less"] < r["less"]) | ((q["less"] == r["less"]) & (q["license"] < r["license"]))
        return F.filter(runs, lambda r: ~F.exists(runs, lambda q: same(q, r) & better(q, r)))

    toks = F.flatten(
        F.transform("b", lambda x, d: F.transform(x["words"], lambda w: F.struct(w.alias("w"), d.alias("d"))))
    )
    runs = chosen.select("id", "b", F.explode(_let(_let(toks, found), best)).alias("r"))
    runs = runs.where((F.col("r.i") > 0) | (F.col("r.j") < F.size("b") - 1))
    return runs.select(
        "id", F.lit("run").alias("unit"), F.get("b", F.col("r.i"))["no"].alias("unit_no"),
        F.struct(F.col("r.less").alias("less"), F.col("r.license").alias("license")).alias("best"),
    )


def _nonempty_words(text: Column) -> Column:
    return F.filter(_words(text), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), _tail(words, 2), lambda a, b: F.concat_ws(" ", a, b))


def _owners(frame: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """(gram, owners): the templates' own bigrams, which are fixed, and the places of their templates by name."""
    grams: dict[str, list[int]] = {}
    for i, name in enumerate(sorted(known)):
        for gram in known[name]:
            grams.setdefault(gram, []).append(i)
    return F.broadcast(frame.sparkSession.createDataFrame(list(grams.items()), "gram string, owners array<int>"))


def _singles(parts: DataFrame, unit: list[str]) -> DataFrame:
    """``unit`` columns, ``gram``: every bigram of a unit once, however often and in however many rows it occurs.

    ``parts`` has the unit's columns, ``ord`` and ``words``: the words of a unit in order, in as many rows as it takes.
    """
    order = Window.partitionBy(*unit).orderBy("ord")
    worded = parts.where(F.size("words") > 0).withColumn("after", F.lead(F.get("words", F.lit(0))).over(order))
    ends = F.when(F.col("after").isNotNull(), F.array(F.concat_ws(" ", F.element_at("words", -1), "after"))).otherwise(F.array().cast("array<string>"))
    return worded.select(*unit, F.explode(F.array_distinct(F.concat(_pairs(F.col("words")), ends))).alias("gram")).distinct()


def _counted(single: DataFrame, unit: list[str], known: dict[str, list[str]]) -> DataFrame:
    """``unit`` columns, n (bigrams of the unit) and hits: (owner, shared) for each template that shares one."""
    owned = single.join(_owners(single, known), "gram", "left").select(*unit, F.posexplode_outer("owners").alias("k", "owner"))
    # a bigram of several templates counts once for the size of the unit
    counted = owned.groupBy(*unit, "owner").agg(F.count("*").alias("shared"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("once"))
    return counted.groupBy(*unit).agg(F.sum("once").alias("n"), F.collect_list(F.when(F.col("owner").isNotNull(), F.struct("owner", "shared"))).alias("hits"))


def _measured(parts: DataFrame, unit: list[str], known: dict[str, list[str]]) -> DataFrame:
    """``unit`` columns, ``scores``: (less, license) for each template that shares a bigram with the unit; ``parts`` as for ``_singles``."""
    names = sorted(known)
    sizes, named = F.array(*(F.lit(len(known[n])) for n in names)), _constant(names)
    score = lambda x: F.struct((-2.0 * x["shared"] / (F.col("n") + F.get(sizes, x["owner"]))).alias("less"), F.get(named, x["owner"]).alias("license"))
    return _counted(_singles(parts, unit), unit, known).select(*unit, F.transform("hits", score).alias("scores"))


def _scored_runs(blocks: DataFrame, known: dict[str, list[str]], least: float, wide: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, unit, unit_no, best): runs of two or more blocks that reach ``least``, found by the sums of their blocks' scores.

    ``blocks`` has key, id, no (numbers of blocks in order) and words.  ``wide`` has the blocks that are too long for one row: as parts
    (key, id, no, ord, words), and their bigrams (key, id, no, gram), each once.
    """
    templates = F.array(*(F.struct(F.lit(name).alias("license"), _constant(grams).alias("grams"), F.lit(min(admissible(len(grams), least))).alias("least")) for name, grams in sorted(known.items())))
    own = F.array_distinct(_pairs(F.col("words")))
    count = lambda c: F.struct(c["license"].alias("license"), c["least"].alias("least"), F.size(F.array_intersect(F.col("own"), c["grams"])).alias("h"))
    told = blocks.where(F.size("words") > 0).withColumn("own", own)
    told = told.select("key", "id", "no", F.size("own").cast("long").alias("g"), F.explode(F.transform(templates, count)).alias("t"))
    worded = blocks.select("key", F.struct("no", F.lit(0).cast("long").alias("line"), F.lit(0).alias("k")).alias("ord"), "words")
    if wide:
        parts, single = wide
        # a block of one word has no bigrams
        counted = parts.select("key", "id", "no").distinct().join(_counted(single.drop("id"), ["key", "no"], known), ["key", "no"], "left")
        shared = lambda c, k: F.get(F.filter("hits", lambda x: x["owner"] == k), F.lit(0))["shared"]
        number = lambda c, k: F.struct(c["license"].alias("license"), c["least"].alias("least"), F.coalesce(shared(c, k), F.lit(0)).cast("int").alias("h"))
        told = told.unionByName(counted.select("key", "id", "no", F.coalesce("n", F.lit(0)).cast("long").alias("g"), F.explode(F.transform(templates, number)).alias("t")))
        worded = worded.unionByName(parts.select("key", F.struct("no", F.col("ord.no").alias("line"), "ord.k").alias("ord"), "words"))
    told = told.select("key", "id", "no", "g", "t.*").withColumn("s", _HIT * F.col("h").cast("long") - _COST * F.col("g"))
    order = Window.partitionBy("key", "license").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    summed = told.withColumn("sum", F.sum("s").over(order)).withColumn("before", F.col("sum") - F.col("s"))
    lowest = summed.withColumn("low", F.min("before").over(order)).withColumn("edge", F.min("no").over(order))
    whole = Window.partitionBy("key", "license")
    lowest = lowest.withColumn("final", F.max("no").over(whole))
    rises = lowest.groupBy("key", "license", "low").agg(
        F.first("id").alias("id"), F.min(F.when(F.col("before") == F.col("low"), F.col("no"))).alias("i"), F.min_by("no", F.struct(-F.col("sum"), "no")).alias("j"),
        F.max("sum").alias("top"), F.sum("h").alias("hits"), F.first("least").alias("least"), F.min("edge").alias("edge"), F.max("final").alias("final"),
    )
    rises = rises.where((F.col("top") > F.col("low")) & (F.col("j") > F.col("i")) & (F.col("hits") >= F.col("least")) & ((F.col("i") > F.col("edge")) | (F.col("j") < F.col("final"))))
    runs = rises.select("key", "id", "license", "i", "j")
    covered = runs.join(worded, "key").where("ord.no between i and j")
    found = _measured(covered, ["key", "id", "license", "i", "j"], known)
    found = found.select("key", "id", "i", F.filter("scores", lambda x: (x["license"] == F.col("license")) & (-x["less"] >= least)).alias("scores"), "j")
    # of templates that the same run reaches, the best
    best = found.where(F.size("scores") > 0).groupBy("key", "id", "i", "j").agg(F.min(F.get("scores", F.lit(0))).alias("best"))
    return best.select("id", F.lit("run").alias("unit"), F.col("i").cast("int").alias("unit_no"), "best")


def _leaps(members: DataFrame) -> DataFrame:
    """(key, license, i, j): of runs of equal number of blocks, in chains that overlap, the first and then always the next beyond.

    ``members`` has key, license, blocks, i, j and chain (where it begins).  The next of each is looked up once, then leaps double.
    """
    run = ["key", "license", "i", "j"]
    told = members.select(*run, "blocks", "chain", F.col("j").alias("at"), F.lit(None).cast("int").alias("found"))
    told = told.unionByName(told.withColumn("at", F.col("i")).withColumn("found", F.col("i")))
    beyond = Window.partitionBy("key", "license", "blocks", "chain").orderBy(F.desc("at"), F.col("found").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hop = told.withColumn("n", F.last("found", ignorenulls=True).over(beyond)).where("found is null and n is not null").select(*run, "n")
    hop, on = checkpoint(hop), checkpoint(members.where(F.col("chain") == F.col("i")).select(*run))
    before = -1
    while (now := on.count()) > before:
        before = now
        reached = on.join(hop, run).select("key", "license", F.col("n").alias("i"), (F.col("n") + F.col("j") - F.col("i")).alias("j"))
        on = checkpoint(on.union(reached).distinct())
        further = hop.select("key", "license", F.col("i").alias("n"), F.col("j").alias("m"), F.col("n").alias("after"))
        hop = hop.withColumn("m", F.col("n") + F.col("j") - F.col("i")).join(further, ["key", "license", "n", "m"])
        hop = checkpoint(hop.select(*run, F.col("after").alias("n")))
    return on


def _apart_runs(runs: DataFrame) -> DataFrame:
    """Of runs (key, license, less, blocks, i, j) of one template that overlap the best ones stay: less, blocks, i in order.

    Each round settles the runs that meet none of less or fewer blocks, except beyond one of their like that meets such a run.
    """
    run = ["key", "license", "less", "blocks", "i", "j"]
    # two runs overlap if both cover the later start, so starts are all the places that count
    begin = runs.select("key", "license", F.col("i").alias("at")).distinct()
    begin = begin.select("key", "license", "at", F.lit(0).alias("last"), *(F.lit(None).cast(t).alias(c) for c, t in (("less", "double"), ("blocks", "int"), ("i", "int"), ("j", "int"))))
    ends = begin.unionByName(runs.select(*run, F.col("j").alias("at"), F.lit(1).alias("last")))
    upto = Window.partitionBy("key", "license").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, 0)
    placed = ends.withColumn("hi", F.sum(1 - F.col("last")).over(upto)).where("last = 1")
    placed = placed.withColumn("lo", F.dense_rank().over(Window.partitionBy("key", "license").orderBy("i")).cast("long"))
    left = checkpoint(placed.select(*run, "lo", "hi"))
    kept = left.select(*run).where("false")
    there = Window.partitionBy("key", "license", "p")
    alike = Window.partitionBy("key", "license", "less", "blocks").orderBy("i")
    so_far = alike.rowsBetween(Window.unboundedPreceding, 0)
    while not left.isEmpty():
        at = left.withColumn("p", F.explode(F.sequence("lo", "hi"))).withColumn("like", F.struct("less", "blocks"))
        judged = at.withColumn("top", F.min("like").over(there)).groupBy(*left.columns).agg(F.min((F.col("like") == F.col("top")).cast("int")).alias("free"))
        met = F.coalesce(F.lag("j").over(alike) >= F.col("i"), F.lit(False))
        chained = judged.withColumn("met", met).withColumn("chain", F.last(F.when(~F.col("met"), F.col("i")), ignorenulls=True).over(so_far))
        in_chain = Window.partitionBy("key", "license", "less", "blocks", "chain").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        sure = checkpoint(chained.withColumn("free", F.min("free").over(in_chain)).where("free = 1"))
        won = _leaps(sure)
        marked = left.join(won.withColumn("won", F.lit(1)), ["key", "license", "i", "j"], "left")
        gone = marked.withColumn("p", F.explode(F.sequence("lo", "hi"))).withColumn("gone", F.max("won").over(there))
        gone = checkpoint(gone.groupBy(*left.columns).agg(F.max("won").alias("won"), F.max("gone").alias("gone")))
        kept = kept.union(gone.where("won = 1").select(*run))
        left = gone.where("gone is null").select(*left.columns)
    return kept


def _runs_of_rows(blocks: DataFrame, known: dict[str, list[str]], least: float) -> DataFrame:
    """What ``_runs`` gives, of texts whose blocks are rows: key, id, no, own (bigrams, or as many as no template can have in a run), first and last (words).

    Blocks in order make groups of about four times the bigrams that a run may have at most.  A run that begins in a group ends before
    the end of the next group of more distinct bigrams than that, and before all its first block adds is found again; so beyond its group only
    the first distinct bigrams count, and no row holds more than these and a group.
    """
    names = sorted(known)
    sizes, named = F.array(*(F.lit(len(known[n])) for n in names)), _constant(names)
    fewest, largest = (F.array(*(F.lit(f(admissible(len(known[n]), least))) for n in names)) for f in (min, max))
    most = max(max(admissible(len(grams), least)) for grams in known.values())
    by_no = Window.partitionBy("key").orderBy("no")
    told = blocks.withColumn("own", F.slice("own", 1, most + 1)).withColumn("d", F.row_number().over(by_no) - 1).withColumn("next", F.lead("first").over(by_no))
    filled = F.sum(F.size("own") + 1).over(by_no.rowsBetween(Window.unboundedPreceding, 0)) - F.size("own") - 1
    told = told.withColumn("part", F.floor(filled / (4 * most)).cast("int"))
    across = F.concat_ws(" ", "last", "next")
    inner = F.transform("own", lambda g: F.struct(g.alias("gram"), F.col("d").alias("j")))
    border = F.when(F.col("next").isNotNull() & ~F.array_contains("own", across), F.array(F.struct(across.alias("gram"), (F.col("d") + 1).alias("j"))))
    told = checkpoint(told.withColumn("grams", F.concat(inner, F.coalesce(border, F.array().cast("array<struct<gram:string,j:int>>")))))
    each = told.select("key", "part", F.col("d").alias("i"), F.explode("grams").alias("g")).select("key", "part", "i", "g.*")
    same = Window.partitionBy("key", "gram").orderBy("i")

    # a run from block i ends before the block ``stop``
    hits = each.join(_owners(blocks, known), "gram").withColumn("stop", F.lead("j").over(same)).withColumn("until", F.lead("part").over(same))
    hits = checkpoint(hits.select("key", "part", "gram", "i", F.explode("owners").alias("t"), F.coalesce("stop", F.lit(2**31 - 1)).alias("stop"), F.coalesce("until", F.lit(2**31 - 1)).alias("until")))
    starts = hits.groupBy("key", "part", "t", "i").agg(F.max("stop").alias("stop"), F.max("until").alias("until"))
    shared = hits.groupBy("key", "part", "t").agg(F.count_distinct("gram").alias("shared"))
    parts = told.groupBy("key", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("own")))).alias("n"))
    later = Window.partitionBy("key").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumn("wall", F.min(F.when(F.col("n") > most, F.col("part"))).over(later)).withColumn("end", F.max("part").over(Window.partitionBy("key")))
    reach = starts.groupBy("key", "part").agg(F.max("until").alias("until")).join(parts, ["key", "part"])
    reach = reach.select("key", "part", F.explode(F.sequence("part", F.least("until", F.coalesce("wall", "end"), "end"))).alias("k"))
    # templates of which there are enough bigrams
    near = reach.join(shared.withColumnRenamed("part", "k"), ["key", "k"]).groupBy("key", "part", "t").agg(F.sum("shared").alias("shared"))
    near = checkpoint(near.where(F.col("shared") >= F.get(fewest, F.col("t"))).select("key", "part", "t"))
    starts = starts.join(near, ["key", "part", "t"], "left_semi").groupBy("key", "part").agg(F.collect_list(F.struct("t", "i", "stop")).alias("starts"))
    reach = checkpoint(reach.join(near, ["key", "part"], "left_semi"))

    needed = each.withColumnRenamed("part", "k").join(reach.select("key", "k").distinct(), ["key", "k"], "left_semi")
    needed = needed.withColumn("before", F.coalesce(F.lag("i").over(same), F.lit(-1))).withColumn("left", F.coalesce(F.lag("k").over(same), F.lit(-1)))
    needed = needed.join(_owners(blocks, known), "gram", "left").select("key", "k", "i", "j", "before", "left", "owners")
    around = reach.join(needed, ["key", "k"]).where((F.col("k") == F.col("part")) | (F.col("left") <= F.col("part")))
    around = around.withColumn("beyond", F.col("k") > F.col("part"))
    ordered = Window.partitionBy("key", "part", "beyond").orderBy("i", "j")
    around = around.withColumn("r", F.row_number().over(ordered)).where(~F.col("beyond") | (F.col("r") <= most + 1))
    rows = around.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("i", "j", "before", "owners"))).alias("grams")).join(starts, ["key", "part"])

    def from_start(x: Column) -> Column:
        new = F.filter("grams", lambda g: (g["i"] >= x["i"]) & (g["j"] < x["stop"]) & (g["before"] < x["i"]))
        hit = lambda g: F.coalesce(F.array_contains(g["owners"], x["t"]), F.lit(False))
        seen = F.transform(F.slice(new, F.lit(1), F.get(largest, x["t"]) + 1), lambda g: F.struct(g["j"].alias("j"), hit(g).alias("hit")))
        return _let(seen, lambda s: _ends(s, x["i"], F.get(sizes, x["t"]), F.get(named, x["t"]), least))

    found = rows.select("key", F.explode(F.flatten(F.transform("starts", from_start))).alias("r")).select("key", "r.*")
    found = _apart_runs(found.select("key", "license", "less", "blocks", "i", "j")).where("blocks > 0")
    # of templates that the same run reaches, the best
    best = found.groupBy("key", "i", "j").agg(F.min(F.struct("less", "license")).alias("best"))
    begins = told.select("key", "id", "no", F.col("d").alias("i"))
    final = told.groupBy("key").agg(F.max("d").alias("final"))
    best = best.join(begins, ["key", "i"]).join(final, "key").where((F.col("i") > 0) | (F.col("j") < F.col("final")))
    return best.select("id", F.lit("run").alias("unit"), F.col("no").cast("int").alias("unit_no"), "best")


def _long_texts(docs: DataFrame, held: int, least: float, known: dict[str, list[str]], compare) -> DataFrame:
    """(id, unit, unit_no, best) of texts (key, id, text) that are too long for one row; ``compare`` takes units as ``_units`` gives them."""
    piece = min(_PIECE, held)
    # pieces end at a line's end; a longer line is a piece of its own
    cut = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?s).{{0,{piece}}}\n|[^\n]+(?:\n|\z)"), F.lit(0))
    pieces = docs.select("key", "id", F.posexplode(cut).alias("piece", "body"))
    feeds = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    order = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(feeds).over(order), F.lit(0)))
    pieces = pieces.withColumn("more", F.lead("piece").over(Window.partitionBy("key").orderBy("piece")).isNotNull())
    # the line feed at the end of a piece begins a line only if it is the text's last character
    lines = F.split(F.when(F.col("more"), F.regexp_replace("body", r"\n\z", "")).otherwise(F.col("body")), "\n", -1)
    lines = pieces.select("key", "id", "base", F.posexplode(lines).alias("k", "line")).select("key", "id", (F.col("base") + F.col("k")).alias("no"), "line")

    # a blank line between others ends a block; of several in a row every second does
    by_line = Window.partitionBy("key").orderBy("no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("line").rlike("^[ \t\r]*$")
    full = F.coalesce(F.max(F.when(~blank, F.col("no"))).over(so_far), F.lit(-1))
    parted = lines.withColumn("border", blank & (F.col("no") > 0) & ((F.col("no") - F.greatest(full + 1, F.lit(1))) % 2 == 0) & F.lead("no").over(by_line).isNotNull())
    parted = parted.withColumn("block", F.sum(F.col("border").cast("int")).over(so_far))
    size = lambda *by: F.sum(F.length("line") + 1).over(Window.partitionBy(*by))
    inside = parted.where("not border").withColumn("chars", size("key", "block")).withColumn("many", F.count("*").over(Window.partitionBy("key", "block")) > 1)
    inside = checkpoint(inside.withColumn("bare", ~F.col("line").rlike(_COPYRIGHT)))

    unit = lambda kind, no, body: F.struct(F.lit(kind).alias("unit"), no.cast("int").alias("unit_no"), body.alias("body"))
    short_lines = inside.where(F.length("line") <= held).select("id", unit("line", F.col("no"), F.col("line")).alias("u"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("bare"), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    blocks = inside.where(F.col("chars") <= held + 1).groupBy("key", "id", "block", "many").agg(joined.alias("body"))
    short_blocks = blocks.where("many").select("id", unit("block", F.col("block"), F.col("body")).alias("u"))

    # units of more than ``held`` characters, in rows that end between words
    several = inside.groupBy("key").agg(F.max("block").alias("last")).where("last > 0").select("key")
    kinds = F.array_compact(
        F.array(
            F.when(F.length("line") > held, F.struct(F.lit("line").alias("unit"), F.col("no").cast("int").alias("unit_no"))),
            F.when(F.col("many") & (F.col("chars") > held + 1) & F.col("bare"), F.struct(F.lit("block").alias("unit"), F.col("block").cast("int").alias("unit_no"))),
        )
    )
    large = inside.select("key", "id", "no", "line", F.explode(kinds).alias("u")).select("key", "id", "no", "line", "u.*")
    whole = inside.where("bare").join(several, "key", "left_semi").select("key", "id", "no", "line", F.lit("text").alias("unit"), F.lit(0).alias("unit_no"))
    split = F.regexp_extract_all("line", F.lit(rf"(?s).{{0,{piece}}}(?:[^a-z0-9]|\z)|[a-z0-9]+"), F.lit(0))

    def parts_of(units: DataFrame, *unit: str) -> DataFrame:
        parts = units.select("key", "id", *unit, F.col("no").alias("at"), F.posexplode(split).alias("k", "part"))
        return parts.select("key", "id", *unit, F.struct(F.col("at").alias("no"), "k").alias("ord"), _nonempty_words(F.col("part")).alias("words"))

    measured = _measured(parts_of(large.unionByName(whole), "unit", "unit_no"), ["key", "id", "unit", "unit_no"], known).select("id", "unit", "unit_no", F.array_min("scores").alias("best"))
    best = compare(short_lines.unionByName(short_blocks)).unionByName(measured)

    # runs: blocks of one row each, and those of more than ``held`` characters
    of_blocks = blocks.select("key", "id", F.col("block").alias("no"), _nonempty_words(F.col("body")).alias("words")).where(F.size("words") > 0)
    wide = parts_of(inside.where((F.col("chars") > held + 1) & F.col("bare")), "block").withColumnRenamed("block", "no").where(F.size("words") > 0)
    wide = checkpoint(wide)
    single = checkpoint(_singles(wide, ["key", "id", "no"]))
    brief = {name: grams for name, grams in known.items() if len(grams) <= RUN_MOST}
    if brief:
        most = max(max(admissible(len(grams), least)) for grams in brief.values())
        ends = [F.get("words", F.lit(0)).alias("first"), F.element_at("words", -1).alias("last")]
        told = of_blocks.select("key", "id", "no", F.array_distinct(_pairs(F.col("words"))).alias("own"), *ends)
        edges = wide.groupBy("key", "id", "no").agg(F.min_by(F.get("words", F.lit(0)), "ord").alias("first"), F.max_by(F.element_at("words", -1), "ord").alias("last"))
        # with more bigrams than any run may have, no run holds the block
        some = single.withColumn("r", F.row_number().over(Window.partitionBy("key", "no").orderBy("gram"))).where(F.col("r") <= most + 1)
        some = some.groupBy("key", "no").agg(F.collect_list("gram").alias("own"))
        edges = edges.join(some, ["key", "no"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
        best = best.unionByName(_runs_of_rows(told.unionByName(edges), brief, least))
    if len(brief) < len(known):
        best = best.unionByName(_scored_runs(of_blocks, {name: grams for name, grams in known.items() if name not in brief}, least, (wide, single)))
    return best


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
    templates: dict[str, str] | None = None, held: int = HELD,
) -> DataFrame:
    """(id, unit, unit_no, license, dice): the best template of every unit that reaches ``least``.

    A unit is a line, block, text, or a run of consecutive blocks, which has the number of its first.
    Equal coefficients go to the first licence by name.  Null and empty texts, and units of fewer than
    two words, have no bigrams and match nothing.  Repeated rows give repeated results, an empty table none.  Texts of any
    length are read whole; columns other than the two named play no part, whatever their names.  ``held`` changes how texts are
    taken apart, never a result.
    """
    known = {name: bigrams(text) for name, text in (templates or TEMPLATES).items()}
    known = {name: grams for name, grams in sorted(known.items()) if grams}
    # units from this many bigrams on may match a long template; those below are compared with the others only
    long = [min(admissible(len(grams), least)) for grams in known.values() if len(grams) > RUN_MOST]
    border = min(long, default=None)
    few = {name: grams for name, grams in known.items() if border is None or min(admissible(len(grams), least)) < border or len(grams) <= RUN_MOST}
    many = {name: grams for name, grams in known.items() if border is not None and max(admissible(len(grams), least)) >= border}
    words = anchors(list(few.values()), least)
    # n bigrams need more than twice as many characters
    told, fewest = telling(list(many.values()), least) if many else ([], 0)
    enough = lambda text: F.size(F.array_intersect(F.split(text, "[^a-z0-9]+"), _constant(told))) >= fewest

    def compare(units: DataFrame) -> DataFrame:
        """Units (id, u) against all templates."""
        out = _best(units.where(_has_any(F.col("u.body"), words)), few, least, None, border)
        return out.unionAll(_best(units.where((F.length("u.body") > 2 * border) & enough(F.col("u.body"))), many, least, border, None)) if many else out

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = texts.where(F.length("text") <= held)
    # as a filtered array of one, so that a text is folded once and not for each word
    kept = F.filter(F.array(F.lower("text")), lambda text: _has_any(text, words))
    folded = short.select("id", F.explode(kept).alias("folded"))
    units = folded.select("id", F.explode(_units(F.col("folded"))).alias("u")).where(_has_any(F.col("u.body"), words))
    best = _best(units, few, least, None, border)
    best = best.unionAll(_runs(folded, few, least))
    if many:
        kept = F.filter(F.array(F.lower("text")), enough)
        # few texts have enough of the words; they are written once, as blocks and runs use them too
        large = checkpoint(short.where(F.length("text") > 2 * border).select("id", F.explode(kept).alias("folded")))
        units = large.select("id", F.explode(_units(F.col("folded"))).alias("u")).where(F.length("u.body") > 2 * border)
        best = best.unionAll(_best(units, many, least, border, None))
        apart = large.where(F.col("folded").rlike("\n[ \t\r]*\n")).select(F.monotonically_increasing_id().alias("key"), "id", "folded")
        blocks = apart.select("key", "id", F.posexplode(F.split("folded", "\n[ \t\r]*\n", -1)).alias("no", "b"))
        blocks = checkpoint(blocks.select("key", "id", "no", _nonempty_words(_bare(F.col("b"))).alias("words")))
        # runs that may be other templates are those of ``_runs``, so that no run comes twice
        best = best.unionAll(_scored_runs(blocks, {name: grams for name, grams in many.items() if len(grams) > RUN_MOST}, least))
    if not texts.where(F.length("text") > held).isEmpty():
        apart = texts.where((F.length("text") > held) & (_has_any(F.lower("text"), words) | F.lit(bool(many))))
        keyed = checkpoint(apart.withColumn("key", F.monotonically_increasing_id()))
        best = best.unionAll(_long_texts(keyed, held, least, known, compare))
    return best.where(-F.col("best.less") >= least).select(
        "id", "unit", "unit_no", "best.license", (-F.col("best.less")).alias("dice")
    )


def _best(
    units: DataFrame, known: dict[str, list[str]], least: float, start: int | None, stop: int | None
) -> DataFrame:
    """(id, unit, unit_no, best): the nearest of the templates whose admissible sizes hold a unit's number of
    bigrams, for units of ``start`` to below ``stop`` bigrams."""
    names, sizes = list(known), [len(grams) for grams in known.values()]
    by_size: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        for n in admissible(size, least):
            if (start is None or n >= start) and (stop is None or n < stop):
                by_size.setdefault(n, []).append(i)
    # one row for each admissible size: fixed by the templates
    sized = F.broadcast(units.sparkSession.createDataFrame(sorted(by_size.items()), "n int, candidates array<int>"))
    every = F.array(*map(_constant, known.values()))
    name_of, size_of = _constant(names), F.array(*map(F.lit, sizes))
    low, high = min(by_size), max(by_size)

    worded = units.select("id", "u.unit", "u.unit_no", _words(F.col("u.body")).alias("words"))
    # more words than this have too many bigrams only if they are distinct, so the upper bound waits
    worded = worded.where(F.size("words") > low)
    paired = worded.select(
        "id", "unit", "unit_no",
        F.array_distinct(
            F.zip_with(
                F.slice("words", F.lit(1), F.size("words") - 1),
                F.slice("words", F.lit(2), F.size("words") - 1),
                lambda a, b: F.concat_ws(" ", a, b),
            )
        ).alias("own"),
    ).withColumn("n", F.size("own")).where(F.col("n").between(low, high))
    scores = F.transform(
        "candidates",
        lambda c: F.struct(
            (-2.0 * F.size(F.array_intersect("own", F.get(every, c))) / (F.col("n") + F.get(size_of, c))).alias("less"),
            F.get(name_of, c).alias("license"),
        ),
    )
    return paired.join(sized, "n").select("id", "unit", "unit_no", F.array_min(scores).alias("best"))


def oracle(least: float = LEAST) -> str:
    """The same scan of ``documents`` in DuckDB."""
    rows = ", ".join(
        f"('{name}', {len(grams)}, [{', '.join(repr(g) for g in grams)}])" for name, grams in sorted((k, bigrams(v)) for k, v in TEMPLATES.items())
    )
    return f"""
WITH templates(license, size, grams) AS (VALUES {rows}),
folded AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines,
    regexp_split_to_array(t, '\\n[ \\t\\r]*\\n') AS blocks FROM folded),
units AS (
    SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS unit_no, unnest(lines) AS body FROM split
    UNION ALL
    SELECT doc_id, 'block', no, array_to_string(list_filter(string_split(b, chr(10)),
        lambda x: NOT regexp_matches(x, '{_COPYRIGHT}')), chr(10))
    FROM (SELECT doc_id, unnest(range(len(blocks))) AS no, unnest(blocks) AS b FROM split) WHERE contains(b, chr(10))
    UNION ALL
    SELECT doc_id, 'text', 0, array_to_string(list_filter(lines,
        lambda x: NOT regexp_matches(x, '{_COPYRIGHT}')), chr(10))
    FROM split WHERE len(blocks) > 1),
worded AS (SELECT doc_id, unit, unit_no,
    string_split(trim(regexp_replace(body, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
paired AS (SELECT doc_id, unit, unit_no,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
    FROM worded WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, unit_no, license,
    2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + size) AS dice FROM paired
    JOIN templates ON 2 * least(len(own), size) >= {least} * (len(own) + size) - 0.000001
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) AS r
    FROM scored WHERE dice >= {least})
SELECT doc_id, unit, unit_no::INT AS unit_no, license, round(dice, 6) AS dice FROM ranked WHERE r = 1
"""
