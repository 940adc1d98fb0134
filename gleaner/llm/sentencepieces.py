"""SentencePiece encoding and decoding, with giant texts cut into chunks.

The tokens are those of the sentencepiece library.  A sequence of tokens is the greedy
BPE encoding of its text exactly when each pair of neighbours is: if encoding the two
together gives the two back, no merge crosses their border, whatever surrounds them.  So
encoding is a path problem over the states "token t covers the cut", with weight 0 for
pairs that agree and minus infinity for the rest, and a giant text can be solved in
pieces:

1. The text is cut into chunks of equal length, wherever that falls.  The states of a cut are the
   vocabulary's tokens that hold the character before it: those that end at it or span it.
2. Each chunk, by itself, yields the max-plus matrix from the states of its left cut to those
   of its right one.  An entry is 0 if encoding the text from the one token to the other
   begins and ends with them, else minus infinity.  Where the chunk has a border that no piece of the
   vocabulary spans (most white space is one), every path goes through it, so both sides are tested by themselves,
   on the few characters up to it; without one, pairs of states are tested on the whole chunk.
3. The matrices of a text are combined by an associative max-plus product (prefixes and
   suffixes by doubling); the one state of each cut on a path of weight 0 is the token there.
4. Each chunk is encoded on its own between the ends of its two tokens.

Texts of one chunk have no inner cut and are encoded where they are, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner.llm.common import checkpoint, in_slices
from gleaner.llm.packing import tokenizer_path

CHUNK = 32_768
#: Characters within which the encodings from different states usually come together.
MEET = 192
#: Appended to a serialized model, this field merges into its normalizer settings: add_dummy_prefix = false.
_NO_PREFIX = b"\x1a\x02\x18\x00"
NEVER = -np.inf


class Model:
    """A BPE model without the prefix it puts before a text; callers add that space themselves."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            self.processor = sentencepiece.SentencePieceProcessor(model_proto=file.read() + _NO_PREFIX)
        p = self.processor
        self.pieces = {p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.longest = max(map(len, self.pieces))
        self.inside = {s[i : i + 2] for s in self.pieces for i in range(len(s) - 1)}
        self.spellings = [self._spelling(i) for i in range(p.get_piece_size())]

    def _spelling(self, i: int) -> bytes:
        p = self.processor
        if p.is_byte(i):
            return bytes([int(p.id_to_piece(i)[1:-1], 16)])
        return b"" if p.is_control(i) else p.decode([i]).encode("utf-8") if p.is_unknown(i) else p.id_to_piece(i).replace("▁", " ").encode("utf-8")

    def spell(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the ids' text, its prefix included."""
        return b"".join(map(self.spellings.__getitem__, ids.tolist()))

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.processor.encode_as_numpy(text), np.int32) if text else np.zeros(0, np.int32)

    def ends(self, text: str) -> list[int]:
        """Where each token of the text ends; the bytes of one character count as one token."""
        out, at = [], 0
        for piece in self.processor.encode_as_proto(text).pieces if text else ():
            at += len(piece.surface)
            if piece.surface:
                out.append(at)
        return out

    def sure(self, text: str, at: int) -> bool:
        """Whether no piece spans the border before ``at`` (a place within the text)."""
        return 0 < at < len(text) and text[at - 1 : at + 1].replace(" ", "▁") not in self.inside

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of every token that may hold the last character before ``at``; at a sure border
        that is left open, as (at, at)."""
        if at in (0, len(text)) or self.sure(text, at):
            return [(at, at)]
        plain = text[max(0, at - self.longest) : at + self.longest].replace(" ", "▁")
        shift = max(0, at - self.longest)
        return [
            (s, e)
            for s in range(max(shift, at - self.longest), at)
            for e in range(at, min(len(text), s + self.longest) + 1)
            if e - s == 1 or plain[s - shift : e - shift] in self.pieces
        ]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _begins(ends: list[int], token: tuple[int, int], base: int) -> bool:
    return token[0] == token[1] or (bool(ends) and ends[0] + base == token[1])


def _closes(ends: list[int], token: tuple[int, int], base: int) -> bool:
    start = ends[-2] + base if len(ends) > 1 else base
    return token[0] == token[1] or (bool(ends) and start == token[0])


def transfer(model: Model, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> np.ndarray:
    """Max-plus matrix from the states of a left cut to those of a right one (positions in ``text``)."""
    out = np.full((len(left), len(right)), NEVER)
    if len(left) == len(right) == 1 and left[0][0] == left[0][1] and right[0][0] == right[0][1]:
        out[0, 0] = 0.0
        return out
    first, last = max(e for _, e in left), min(s for s, _ in right)
    begin = next((b for b in range(first, last + 1) if model.sure(text, b)), None)
    if begin is not None:
        stop = next(b for b in range(last, begin - 1, -1) if model.sure(text, b))
        heads = [_begins(model.ends(text[t[0] : begin]), t, t[0]) for t in left]
        tails = [_closes(model.ends(text[stop : t[1]]), t, stop) for t in right]
        out[np.ix_(np.flatnonzero(heads), np.flatnonzero(tails))] = 0.0
        return out
    far = min(e for _, e in right) - max(s for s, _ in left) > 4 * MEET + 4 * model.longest

    def starts(token: tuple[int, int]) -> bool:
        # some border lies in this window, and what is encoded up to it must begin with the token
        stop = token[0] + MEET
        return not far or any(
            _begins(model.ends(text[token[0] : b]), token, token[0]) for b in range(stop, stop + model.longest)
        )

    def finishes(token: tuple[int, int]) -> bool:
        stop = token[1] - MEET
        return not far or any(
            _closes(model.ends(text[a : token[1]]), token, a) for a in range(stop, stop - model.longest, -1)
        )

    rows = [i for i, t in enumerate(left) if starts(t)]
    columns = [j for j, t in enumerate(right) if finishes(t)]
    for i in rows:
        for j in columns:
            ends = model.ends(text[left[i][0] : right[j][1]])
            if _begins(ends, left[i], left[i][0]) and _closes(ends, right[j], left[i][0]):
                out[i, j] = 0.0
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive prefix products in a logarithmic number of rounds of independent products."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [product(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


def choose_states(matrices: list[np.ndarray]) -> list[int]:
    """The state of each inner cut on the path of weight 0."""
    forward = _scan(matrices)
    backward = [m.T for m in _scan([m.T for m in reversed(matrices)])][::-1]
    chosen = []
    for before, after in zip(forward[:-1], backward[1:], strict=True):
        through = before[0, :] + after[:, 0]
        if through.max() == NEVER:
            raise ValueError("no path: the model is not a plain BPE model")
        chosen.append(int(through.argmax()))
    return chosen


def _prefixed(text: str | None) -> str:
    return f" {text}" if text else ""


def cuts_of(length: int, chunk: int) -> list[int]:
    """Borders of the fewest chunks of at most ``chunk`` characters, all about equally long."""
    n = max(1, -(-length // chunk))
    return [k * length // n for k in range(n + 1)]


def _giant_chunks(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(uid, id, k, n, base, lo, hi, text): chunks with ``longest`` characters around them; lo and hi are
    the cuts, base the place of ``text``, all in the prefixed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for rows in in_slices(batches, "text"):
            out = []
            for uid, doc_id, raw in zip(rows["uid"], rows["id"], rows["text"], strict=True):
                text = _prefixed(raw)
                cuts = cuts_of(len(text), chunk)
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    base = max(0, lo - model.longest)
                    out.append((uid, doc_id, k, len(cuts) - 1, base, lo, hi, text[base : hi + model.longest]))
            yield pd.DataFrame(out, columns=["uid", "id", "k", "n", "base", "lo", "hi", "text"])

    return docs.mapInPandas(run, "uid long, id long, k int, n int, base long, lo long, hi long, text string")


def _local_states(model: Model, row) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """States of both cuts of a chunk row, as positions in its text."""
    lo, hi = int(row.lo - row.base), int(row.hi - row.base)
    left = model.states(row.text, lo) if row.k else [(lo, lo)]
    right = model.states(row.text, hi) if row.k < row.n - 1 else [(hi, hi)]
    return left, right


def _resolved(chunks: DataFrame, path: str) -> DataFrame:
    """(uid, k, from, to): where the tokens of each chunk begin and end in the prefixed text."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for rows in in_slices(batches, "text"):
            out = []
            for row in rows.itertuples():
                left, right = _local_states(model, row)
                m = transfer(model, row.text, left, right)
                out.append((row.uid, row.k, [e + row.base for _, e in left], [e + row.base for _, e in right], m.ravel()))
            yield pd.DataFrame(out, columns=["uid", "k", "left", "right", "m"])

    def solved(rows: list) -> pd.DataFrame:
        left, right = [r.left for r in rows], [r.right for r in rows]
        ms = [np.asarray(r.m).reshape(len(r.left), len(r.right)) for r in rows]
        ends = [right[k][s] for k, s in enumerate(choose_states(ms))]
        begin, stop = [left[0][0], *ends], [*ends, right[-1][0]]
        return pd.DataFrame({"uid": rows[0].uid, "k": [r.k for r in rows], "begin": begin, "stop": stop})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a text has at most 2^31 / chunk rows here, each a few numbers
        own: list = []
        for batch in batches:
            done = []
            for row in batch.itertuples():
                if own and own[0].uid != row.uid:
                    done.append(solved(own))
                    own = []
                own.append(row)
            if done:
                yield pd.concat(done)
        if own:
            yield solved(own)

    small = chunks.repartition("uid", "k").mapInPandas(
        matrices, "uid long, k int, left array<long>, right array<long>, m array<double>"
    )
    ordered = small.repartition("uid").sortWithinPartitions("uid", "k")
    return ordered.mapInPandas(solve, "uid long, k int, begin long, stop long")


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """(uid, id, k, n, ids): the ids of chunk k of n of each text; in order of k they are the text's encoding.

    ``uid`` tells rows apart, also where ids repeat or are null.  Null and empty texts
    have one chunk without ids; repeated rows are encoded each for itself; an empty table gives an empty result; columns
    other than the two named play no part, whatever their names.  Texts of more than ``chunk`` characters are cut;
    ``chunk`` decides how the work is divided, never what the ids are.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for part in in_slices(batches, "text", 2 << 20):
            ids = [model.ids(_prefixed(t)) for t in part["text"]]
            yield pd.DataFrame({"uid": part["uid"], "id": part["id"], "k": 0, "n": 1, "ids": ids})

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for part in in_slices(batches, "text", 2 << 20):
            ids = [model.ids(r.text[int(r.begin - r.base) : int(r.stop - r.base)]) for r in part.itertuples()]
            yield pd.DataFrame({"uid": part["uid"], "id": part["id"], "k": part["k"], "n": part["n"], "ids": ids})

    schema = "uid long, id long, k int, n int, ids array<int>"
    whole = rows.where(~giant).mapInPandas(short, schema)
    chunks = checkpoint(_giant_chunks(rows.where(giant), path, chunk))
    solved = chunks.join(_resolved(chunks, path), ["uid", "k"]).mapInPandas(long, schema)
    return whole.unionByName(solved)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with text: what the ids of each chunk spell (the prefix of the first chunk taken off)."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    @pandas_udf("string")
    def spell(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load(path)
        for ids, ks in batches:
            texts = [model.spell(i).decode("utf-8", "replace") for i in ids]
            yield pd.Series([t[1:] if k == 0 else t for t, k in zip(texts, ks, strict=True)], dtype=object)

    return encoded.withColumn("text", spell("ids", "k"))


def _times(matrix: tuple[int, ...], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return total


@lru_cache(maxsize=64)
def _zeros(power: int) -> tuple[int, ...]:
    """What 2^power zero bits do to a CRC-32 register, as a matrix over two elements."""
    if not power:
        return (0xEDB88320, *(1 << i for i in range(31)))
    half = _zeros(power - 1)
    return tuple(_times(half, row) for row in half)


def _shift(crc: int, zeros: int) -> int:
    """The CRC-32 register after ``zeros`` zero bytes."""
    bits = zeros * 8
    for power in range(bits.bit_length()):
        if bits >> power & 1:
            crc = _times(_zeros(power), crc)
    return crc


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per text: id, n_chunks, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers),
    text_crc32 and n_chars of what the ids decode to."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for rows in batches:
            out = []
            for uid, doc_id, k, n, ids in zip(rows["uid"], rows["id"], rows["k"], rows["n"], rows["ids"], strict=True):
                raw = model.spell(ids)[1 if k == 0 else 0 :]
                chars = len(raw.decode("utf-8", "replace"))
                out.append((uid, doc_id, k, n, len(ids), zlib.crc32(ids.astype("<i4").tobytes()), len(raw), zlib.crc32(raw), chars))
            yield pd.DataFrame(out, columns=["uid", "id", "k", "n_chunks", "n_tokens", "ids_crc32", "bytes", "text_crc32", "n_chars"])

    kinds = "uid long, id long, k int, n_chunks int, n_tokens long, ids_crc32 long, bytes long, text_crc32 long, n_chars long"
    # a few numbers for each chunk, used twice below: kept, so that the texts are encoded once
    parts = checkpoint(encoded.mapInPandas(sums, kinds))

    @pandas_udf("ids_crc32 long, text_crc32 long")
    def joined(groups: pd.Series) -> pd.DataFrame:
        out = []
        for group in groups:
            a = b = 0
            for part in sorted(group, key=lambda p: p["k"]):
                a = _shift(a, 4 * part["n_tokens"]) ^ part["ids_crc32"]
                b = _shift(b, part["bytes"]) ^ part["text_crc32"]
            out.append((a, b))
        return pd.DataFrame(out, columns=["ids_crc32", "text_crc32"])

    names = ["id", "n_chunks", "n_tokens", "ids_crc32", "text_crc32", "n_chars"]
    one = parts.where("n_chunks = 1").select(*names)
    many = (
        parts.where("n_chunks > 1").groupBy("uid", "id", "n_chunks")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"),
             F.collect_list(F.struct("k", "n_tokens", "ids_crc32", "bytes", "text_crc32")).alias("parts"))
        .withColumn("both", joined("parts"))
        .select("id", "n_chunks", "n_tokens", "both.ids_crc32", "both.text_crc32", "n_chars")
    )
    return one.unionByName(many)
