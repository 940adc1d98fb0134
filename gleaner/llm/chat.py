"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its
turns are intersected with the token spans by binary search: a token is under the loss
mask when it overlaps the text of an assistant turn.

Template: an assistant turn is ``<s>text</s>``, any other ``[INST]role\\ntext[/INST]``.
Control strings inside texts and roles get a backslash after their first character (one
more where some stand there already), so no text can open or close a turn, and
taking one backslash away restores it.  Control strings are single tokens of their
own, so no token straddles the border of a turn.

Long conversations are cut at turn borders into segments of about ``segment``
characters; since no token spans a turn border, their ids in order are those of the
whole.  Memory is bounded by the segment and the longest single turn, also when one
conversation holds a large part of all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.packing import byte_bpe, tokenizer_path

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
SEGMENT = 1 << 20
#: Control strings, and the one special string of the vocabulary, after any number of backslashes.
_GUARDED = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|\|endoftext\|>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|\|endoftext\|>)")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.DOTALL)
SCHEMA = "conv_id long, segment int, n_turns long, text string, ids array<int>, begin array<int>, stop array<int>, mask array<byte>"


def escape(text: str) -> str:
    return _GUARDED.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns, and the ascending (begin, stop, loss) spans of their texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        loss = role == LOSS_ROLE
        head, tail = ("<s>", "</s>") if loss else (f"[INST]{_escape_role(role)}\n", "[/INST]")
        body = escape(text)
        parts += (head, body, tail)
        spans.append((at + len(head), at + len(head) + len(body), loss))
        at += len(head) + len(body) + len(tail)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 3)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [
        (LOSS_ROLE, unescape(m[1])) if m[1] is not None else (_unescape_role(m[2]), unescape(m[3]))
        for m in _TURN.finditer(formatted)
    ]


class Encoder:
    """Ids and character spans of rendered texts, those that ``tokenizer`` gives, several times as fast.

    Control strings are single tokens; what stands between them is encoded by itself, and the lengths of its tokens in bytes
    give their places.  A token that holds part of a character spans the whole of it.
    """

    def __init__(self, path: str) -> None:
        self.bpe = byte_bpe(path)
        self.between = re.compile(f"({'|'.join(map(re.escape, CONTROLS))})")
        self.ids = {c: np.array([self.bpe.size + i], np.int32) for i, c in enumerate(CONTROLS)}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, begins, stops, at = [], [], [], 0
        for k, part in enumerate(self.between.split(text)):
            if k % 2:
                ids.append(self.ids[part])
                begins.append([at])
                stops.append([at + len(part)])
            elif part:
                own = np.frombuffer(self.bpe(part), "<i4")
                end = np.cumsum(self.bpe.lengths[own])
                raw = part.encode("utf-8", "replace")
                if len(raw) == len(part):
                    begin, stop = end - self.bpe.lengths[own], end
                else:
                    seen = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    begin, stop = seen[end - self.bpe.lengths[own]] - 1, seen[end - 1]
                ids.append(own)
                begins.append(at + begin)
                stops.append(at + stop)
            at += len(part)
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(begins).astype(np.int64), np.concatenate(stops).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return loaded


def token_mask(begin: np.ndarray, stop: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token span that overlaps a loss span; turn spans ascend and do not overlap."""
    if not len(spans):
        return np.zeros(len(begin), np.int8)
    # the last turn text that begins before the token stops
    at = np.searchsorted(spans[:, 0], stop, side="left") - 1
    own = spans[np.maximum(at, 0)]
    return ((at >= 0) & (begin < own[:, 1]) & (stop > own[:, 0]) & (own[:, 2] == 1)).astype(np.int8)


def loss_text(text: str, begin: np.ndarray, stop: np.ndarray, mask: np.ndarray) -> str:
    """What stands under the mask, unescaped; each run of masked tokens is one text."""
    on = np.flatnonzero(mask)
    if not len(on):
        return ""
    breaks = np.flatnonzero(np.diff(on) > 1)
    firsts, lasts = on[np.concatenate(([0], breaks + 1))], on[np.concatenate((breaks, [len(on) - 1]))]
    return "".join(unescape(text[b:e]) for b, e in zip(begin[firsts], stop[lasts], strict=True))


def format_conversations(
    rows: DataFrame, path: str | None = None, segment: int = SEGMENT, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation (per segment of a very long one), in order of segments within a
    partition: conv_id, segment, n_turns, text, ids, begin and stop (token spans), mask.

    Turns go by ``turn`` (nulls first), equal ones by role and text; repeated rows are
    turns of their own.  Null texts and roles are empty; rows without a conv_id form one
    conversation with a null id.  An empty table gives an empty result; columns other than the four named play no
    part, whatever their names.  Texts of any length are encoded whole.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    ordered = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        current, number, turns, size, ready = None, 0, [], 0, []

        def close() -> None:
            if turns:
                ready.append((current, number, list(turns)))

        def flush() -> pd.DataFrame:
            out = []
            for conv, k, own in ready:
                text, spans = render(own)
                ids, begin, stop = encode(text)
                out.append((conv, k, len(own), text, ids, begin, stop, token_mask(begin, stop, spans)))
            ready.clear()
            frame = pd.DataFrame(out, columns=["conv_id", "segment", "n_turns", "text", "ids", "begin", "stop", "mask"])
            return frame.astype({"conv_id": "Int64"})

        pending = 0
        for batch in batches:
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if turns and conv != current:
                    close()
                    number, size = 0, 0
                    turns.clear()
                elif size > segment:
                    close()
                    number, size = number + 1, 0
                    turns.clear()
                current = conv
                turns.append((role, text))
                size += len(text)
                pending += len(text)
                if pending > segment and ready:
                    yield flush()
                    pending = size
        close()
        if ready:
            yield flush()

    return ordered.mapInPandas(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted output: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.

    Takes the output of ``format_conversations`` as it is, segments of a conversation one
    after another in one partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        done, state = [], None

        def close() -> None:
            if state:
                conv, turns, seen, chars, lost, size, tokens, masked = state
                done.append((conv, turns, seen.hexdigest(), chars, lost.hexdigest(), size, tokens, masked))

        for batch in batches:
            for row in batch.itertuples():
                if row.segment == 0:
                    close()
                    conv = None if pd.isna(row.conv_id) else int(row.conv_id)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(row.text):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                lost = loss_text(row.text, row.begin, row.stop, row.mask)
                state[3] += len(lost)
                state[4].update(lost.encode("utf-8", "replace"))
                state[5] += len(row.text)
                state[6] += len(row.mask)
                state[7] += int(row.mask.sum())
            if len(done) > 5_000:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
                done.clear()
        close()
        yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    )
