"""Scalar functions over bytes, paths and findings, as Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import FloatType, StringType

# --- fixed values: lists and patterns that results depend on -------------------------------------

#: A value that matches one of these patterns (a line each) is a placeholder, not a secret.
SAFE_LIST = tuple(files("gleaner").joinpath("packs/safe_list.txt").read_text("utf-8").splitlines())
ZIP_FAMILY = (
    "zip", "zipx", "jar", "war", "ear", "aar", "jmod", "jhm", "jnlp", "nupkg", "vsix", "xap", "docx", "xlsx", "pptx",
    "odt", "ods", "odp", "odg", "odf", "epub", "gadget", "kmz", "widget", "xpi", "sketch", "pages", "key", "numbers",
)
OTHER_ARCHIVES = ("gz", "tgz", "bz2", "xz", "tar", "zlib", "asar")
MIME = {
    "txt": "text/plain", "md": "text/plain", "rst": "text/plain", "html": "text/html", "htm": "text/html",
    "css": "text/css", "js": "application/javascript", "json": "application/json", "xml": "application/xml",
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
}
LANGUAGES = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "c": "C", "cpp": "C++",
    "cc": "C++", "cxx": "C++", "go": "Go", "rb": "Ruby", "php": "PHP", "cs": "C#", "kt": "Kotlin", "kts": "Kotlin",
    "scala": "Scala", "swift": "Swift", "sh": "Shell", "pl": "Perl", "lua": "Lua", "hs": "Haskell", "r": "R",
}
LANGUAGE_MARKS = (
    ("<?php", "PHP"), ("package main", "Go"), ("public class", "Java"), ("#!/usr/bin/env bash", "Shell"),
    ("#!/bin/bash", "Shell"), ("#!/usr/bin/env python", "Python"),
)

# --- plain Python, shared with the matcher ---------------------------------------------------------

#: Most patterns hold an assignment or an address, so that every match has one of three characters; values without these need only the others.
_MARKED = tuple(p for p in SAFE_LIST if any(mark in p for mark in ("[:=", "[=:", "://", "//")))
_MARKS = re.compile(rb"[:=?]")
_SAFE, _PLAIN = (
    re.compile(b"|".join(f"(?:{p})".encode() for p in chosen), re.I) for chosen in (SAFE_LIST, [p for p in SAFE_LIST if p not in _MARKED])
)
_ANSI = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b[@-Z\\-_]")


def entropy_of(value: bytes) -> float:
    """Shannon entropy in bits per byte, in single precision; empty: 0."""
    if not value:
        return 0.0
    if len(value) <= 64:
        # values of one form have one entropy: the numbers of equal bytes, in order of the bytes, tell it
        return _entropy(tuple(map(value.count, sorted(set(value)))))
    counts = np.bincount(np.frombuffer(value, np.uint8))
    return _entropy.__wrapped__(counts[counts > 0])


@lru_cache(65_536)
def _entropy(counts: Sequence[int]) -> float:
    counts = np.asarray(counts)
    p = counts.astype(np.float32) / np.float32(counts.sum())
    return float(-(p * np.log2(p)).sum(dtype=np.float32)) + 0.0


def is_safe(value: bytes) -> bool:
    return (_SAFE if _MARKS.search(value) else _PLAIN).search(value) is not None


def fingerprint_of(value: bytes, kind: str, start: int, end: int) -> int:
    """XXH3-64 of value, origin kind and the offsets as little-endian 64-bit numbers."""
    return xxhash.xxh3_64_intdigest(value + kind.encode() + start.to_bytes(8, "little") + end.to_bytes(8, "little"))


def escape_unprintable(text: str) -> str:
    """Without ANSI colour, other control characters as ``\\u{..}``; white space stays."""
    bare = _ANSI.sub("", text).replace("\x1b", "")
    return "".join(c if c.isspace() or ord(c) >= 32 and not 127 <= ord(c) < 160 else f"\\u{{{ord(c):x}}}" for c in bare)


def aws_account(key_id: str) -> str | None:
    """The account number inside an AWS access key id; None for old or malformed ids."""
    import base64
    import binascii

    if len(key_id) != 20 or key_id[4] in "IJ":
        return None
    try:
        head = base64.b32decode(key_id[4:])[:6]
    except binascii.Error:
        return None
    return f"{(int.from_bytes(head, 'big') & 0x7FFFFFFFFF80) >> 7:012d}"


# --- Columns -----------------------------------------------------------------------------------------


@pandas_udf(FloatType())
def entropy(value: pd.Series) -> pd.Series:
    """Entropy of a binary column."""
    return pd.Series([None if v is None else entropy_of(bytes(v)) for v in value], dtype="float32")


@pandas_udf(StringType())
def fingerprint(value: pd.Series, kind: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    rows = zip(value, kind, start, end, strict=True)
    return pd.Series([str(fingerprint_of(bytes(v), k, int(s), int(e))) for v, k, s, e in rows])


@pandas_udf(StringType())
def escaped(text: pd.Series) -> pd.Series:
    return text.map(escape_unprintable, na_action="ignore")


@pandas_udf(StringType())
def aws_account_number(key_id: pd.Series) -> pd.Series:
    return key_id.map(aws_account, na_action="ignore")


def blob_id(content: Column) -> Column:
    """Git's object id of a blob."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def safe_listed(value: Column) -> Column:
    """Whether a text value is a known placeholder."""
    return value.rlike("(?i)" + "|".join(f"(?:{p.replace(chr(92) + 'Z', chr(92) + 'z')})" for p in SAFE_LIST))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, null without one (or only a leading one)."""
    found = F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
    return F.when(found != "", found)


def is_archive(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(ext.isin(*ZIP_FAMILY) | F.lower(ext).isin(*OTHER_ARCHIVES), F.lit(False))


def mime_type(path: Column) -> Column:
    """By extension; unknown ones are octet streams, no path is plain text."""
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    known = F.try_element_at(table, F.coalesce(F.lower(extension(path)), F.lit("")))
    return F.when(path.isNull(), "text/plain").otherwise(F.coalesce(known, F.lit("application/octet-stream")))


def language(path: Column, text: Column) -> Column:
    """By extension, else by marks in the text."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    marked = F.lit(None).cast("string")
    for mark, name in reversed(LANGUAGE_MARKS):
        marked = F.when(text.contains(mark), name).otherwise(marked)
    return F.coalesce(F.try_element_at(table, F.coalesce(F.lower(extension(path)), F.lit(""))), marked)


def charset(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8")


def looks_binary(content: Column) -> Column:
    """A NUL, or the signature of PNG or PDF, among the first 1024 bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    return head.rlike("^(..)*?00") | head.startswith("89504E47") | head.startswith("25504446")


def mostly_control(content: Column) -> Column:
    """More than four NULs, or over 0.3 control bytes (line ends and tabs aside); empty content is text."""
    head = F.decode(content, "ISO-8859-1")
    total = F.octet_length(content)
    nul = total - F.length(F.replace(head, F.lit("\x00"), F.lit("")))
    control = total - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""))
    return F.coalesce((nul > 4) | (control / F.greatest(total, F.lit(1)) > 0.3), F.lit(False))


def line_and_column(content: Column, offset: Column, compat: bool = False) -> tuple[Column, Column]:
    """Line (from 1) and column (from 0) of a byte offset.

    A newline belongs to the line after it, at column 0.  With ``compat``, columns on line 1 are 0
    wherever the content has a newline.
    """
    text = F.decode(content, "ISO-8859-1")  # a character for each byte
    before = F.substring(text, F.lit(1), offset.cast("int"))
    at_newline = F.substring(text, (offset + 1).cast("int"), F.lit(1)) == "\n"
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    start = F.length(F.substring_index(before, "\n", -1))
    column = F.when(at_newline, 0).otherwise(start)
    if compat:
        column = F.when((line == 1) & text.contains("\n"), 0).otherwise(column)
    return (line + at_newline.cast("int")).cast("int"), column.cast("int")


def is_base64(value: Column) -> Column:
    return (F.length(value) % 4 == 0) & value.rlike("^[A-Za-z0-9+/=]*$")


def redacted(value: Column, salt: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), F.substring(F.sha2(F.concat(salt, value), 256), 1, 8), F.lit("]"))


def repo_url(url: Column) -> Column:
    """``git@host:path`` as https, without a trailing ``.git``."""
    https = F.regexp_replace(url, r"^git@([^:/]+):", "https://$1/")
    return F.regexp_replace(https, r"\.git$", "")


def is_git_url(url: Column) -> Column:
    """https only, with a host, and without user, query, fragment or dots that climb."""
    return url.rlike(r"^https://[^/@?#\s]+(/[^?#@\s]*)?$") & ~url.contains("..")


def first_matching(conditions: Sequence[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for condition, label in reversed(conditions):
        out = F.when(condition, label).otherwise(out)
    return out


def has_scheme(value: Column, schemes: Sequence[str]) -> Column:
    """Whether a value is a URI of one of the schemes (those of a rule: ``Rule.schemes``); never without any."""
    return value.rlike(f"^({'|'.join(map(re.escape, schemes))})://") if schemes else F.lit(False)


def is_aws_pair(key_id: Column, secret: Column) -> Column:
    """Whether an access key id and a secret are worth trying: lengths and alphabets."""
    return key_id.rlike("^AKIA[A-Z0-9]{16}$") & secret.rlike("^[A-Za-z0-9/+]{40,}$")


def cache_key(service: str, *parts: Column) -> Column:
    """Key of a remembered outcome: the service's name and a SHA-1 of what identifies the request."""
    return F.concat(F.lit(f"{service}:"), F.sha1(F.concat_ws("\x00", *parts)))


def clone_folder(url: Column) -> Column:
    """A folder name for a clone: slashes and colons become underscores."""
    return F.translate(url, "/:", "__")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def finding_id(rule_sha1: Column, captures: Column) -> Column:
    """A positive 63-bit number, as text, of a rule's pattern and the captures of a match: the head of a SHA-1."""
    groups = F.to_json(F.struct(captures.alias("captures")), {"ignoreNullFields": "false"})
    digest = F.sha1(F.concat(rule_sha1.cast("binary"), F.unhex(F.lit("00")), groups.cast("binary")))
    low = F.conv(F.substring(digest, 2, 15), 16, 10).cast("long")
    head = F.conv(F.substring(digest, 1, 1), 16, 10).cast("long").bitwiseAND(F.lit(7))
    return (head * F.lit(1 << 60) + low).cast("string")


def git_url_path(url: Column) -> Column:
    """Where a repository's URL lies in a tree of clones: scheme/host[:port]/path."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1))
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/?(.*)$", 1)
    return F.concat_ws("/", F.regexp_extract(url, "^([a-z]+)://", 1), host, F.when(path != "", path))
