"""The rule table: YAML files or records, filtered, selected and checked."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from gleaner.functions.regexes import PatternError, compile_bytes, literal_clauses

PACK = Path(__file__).resolve().parent.parent / "packs"
CONFIDENCES = ("low", "medium", "high")
HTTP_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "TRACE", "CONNECT")
RULE_SCHEMA = (
    "rule_id string, rule_name string, pattern string, min_entropy float, confidence string, visible boolean, "
    "examples array<string>, negative_examples array<string>, references array<string>, prevalidated boolean, "
    "validation string, rule_sha1 string"
)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    min_entropy: float = 0.0
    confidence: str = "medium"
    visible: bool = True
    examples: tuple[str, ...] = ()
    negative_examples: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    prevalidated: bool = False
    depends_on: tuple[tuple[str, str], ...] = ()
    validation: dict[str, Any] | None = field(default=None, hash=False)
    #: Any match contains one of these (case aside); by default found from the pattern.
    keywords: tuple[str, ...] = ()
    #: For secrets that are URIs: the schemes they may have.
    schemes: tuple[str, ...] = ()

    @property
    def clauses(self) -> tuple[tuple[str, ...], ...]:
        """Lower-case literals in clauses: every match contains one of each; empty if none are known."""
        known = (tuple(sorted({k.lower() for k in self.keywords})), *literal_clauses(self.pattern)) if self.keywords else literal_clauses(self.pattern)
        return tuple(dict.fromkeys(known))

    @property
    def literals(self) -> tuple[str, ...]:
        """The most telling clause; empty if none is known."""
        return self.clauses[0] if self.clauses else ()

    @property
    def sha1(self) -> str:
        return hashlib.sha1(self.pattern.encode("utf-8")).hexdigest()

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Rule:
        """A rule from a mapping; unknown keys are ignored, required ones must be there."""
        missing = [k for k in ("id", "name", "pattern") if not raw.get(k)]
        if missing:
            raise ValueError(f"Failed to load rules: {raw.get('id', raw.get('name'))!r} lacks {', '.join(missing)}")
        confidence = str(raw.get("confidence") or "medium").lower()
        if confidence not in CONFIDENCES:
            raise ValueError(f"Failed to load rules: {raw['id']}: confidence {confidence!r}")
        validation = raw.get("validation")
        if validation and validation.get("type") == "Http":
            method = str(((validation.get("content") or {}).get("request") or {}).get("method", "GET"))
            if method.upper() not in HTTP_METHODS:
                raise ValueError(f"Failed to load rules: {raw['id']}: unsupported HTTP method {method!r}")
        depends = tuple((d["rule_id"], d["variable"]) for d in raw.get("depends_on_rule") or () if d)
        return cls(
            id=raw["id"], name=raw["name"], pattern=raw["pattern"], min_entropy=float(raw.get("min_entropy") or 0.0),
            confidence=confidence, visible=bool(raw.get("visible", True)), examples=tuple(raw.get("examples") or ()),
            negative_examples=tuple(raw.get("negative_examples") or ()), references=tuple(raw.get("references") or ()),
            prevalidated=bool(raw.get("prevalidated", False)), depends_on=depends, validation=validation,
            keywords=tuple(raw.get("keywords") or ()), schemes=tuple(raw.get("schemes") or ()),
        )


def parse_rules(text: str, name: str = "rules") -> list[Rule]:
    try:
        loaded = yaml.safe_load(text) or {}
    except yaml.YAMLError as error:
        raise ValueError(f"Failed to load rules from {name}: {error}") from error
    if not isinstance(loaded, dict) or not isinstance(loaded.get("rules", []), list):
        raise ValueError(f"Failed to load rules from {name}: no list of rules")
    return [Rule.of(r) for r in loaded.get("rules", [])]


def load_rules(paths: Iterable[str | Path] = (), builtins: bool = True) -> list[Rule]:
    """Rules of the built-in pack, then of files and folders (YAML files in order of path).

    A later rule replaces an earlier one of the same id.  The result is sorted by id.
    """
    files = sorted(PACK.glob("*.yml")) if builtins else []
    for path in map(Path, paths):
        if path.is_dir():
            files += sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml"))
        elif path.is_file():
            files.append(path)
        else:
            raise FileNotFoundError(f"Invalid input: {path}")
    return last_of_each(r for f in files for r in parse_rules(f.read_text("utf-8"), str(f)))


def last_of_each(rules: Iterable[Rule]) -> list[Rule]:
    return sorted({r.id: r for r in rules}.values(), key=lambda r: r.id)


def at_least(rules: Iterable[Rule], confidence: str = "medium") -> list[Rule]:
    floor = CONFIDENCES.index(confidence.lower())
    return [r for r in rules if CONFIDENCES.index(r.confidence) >= floor]


def select_rules(rules: Sequence[Rule], selectors: Iterable[str] = ("all",)) -> list[Rule]:
    """Rules named by id, by dotted prefix of their id, or by ``all``; an unknown selector is an error."""
    chosen: dict[str, Rule] = {}
    for selector in selectors:
        found = [r for r in rules if selector == "all" or r.id == selector or r.id.startswith(f"{selector}.")]
        if not found and selector != "all":
            raise ValueError(f"No rule matches {selector!r}")
        chosen |= {r.id: r for r in found}
    return sorted(chosen.values(), key=lambda r: r.id)


def with_min_entropy(rules: Iterable[Rule], value: float | None) -> list[Rule]:
    """All rules with this least entropy; None and negative values change nothing."""
    if value is None or value < 0:
        return list(rules)
    return [dataclasses.replace(r, min_entropy=value) for r in rules]


def compiled(rules: Sequence[Rule]) -> dict[str, Any]:
    """Byte regexes by rule id; all that fail are reported together, and no rule at all is an error."""
    if not rules:
        raise ValueError("No rules to compile")
    good, problems = {}, []
    for rule in rules:
        try:
            good[rule.id] = compile_bytes(rule.pattern)
        except Exception as error:  # noqa: BLE001 - whatever the compiler objects to is reported
            problems.append((rule.id, str(error)))
    if problems:
        raise PatternError(problems)
    return good


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    import json

    rows = [
        (r.id, r.name, r.pattern, float(r.min_entropy), r.confidence, r.visible, list(r.examples), list(r.negative_examples),
         list(r.references), r.prevalidated, json.dumps(r.validation) if r.validation else None, r.sha1)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def dependencies_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, dep_rule_id, variable): which rules need which others."""
    rows = [(r.id, d, v) for r in rules for d, v in r.depends_on]
    return spark.createDataFrame(rows, "rule_id string, dep_rule_id string, variable string")


def check_rules(rules: Iterable[Rule]) -> list[tuple[str, str, str]]:
    """(rule id, 'error' or 'warning', message) for everything that is wrong with the rules."""
    found = []
    for rule in rules:
        if len(rule.name) < 3:
            found.append((rule.id, "warning", "name is shorter than 3 characters"))
        if len(rule.pattern) < 5:
            found.append((rule.id, "warning", "pattern is shorter than 5 characters"))
        if not rule.examples:
            found.append((rule.id, "warning", "no examples"))
        try:
            regex = compile_bytes(rule.pattern)
        except Exception as error:  # noqa: BLE001
            found.append((rule.id, "error", f"pattern does not compile: {error}"))
            continue
        found += [(rule.id, "error", f"example {i + 1} does not match") for i, e in enumerate(rule.examples) if not regex.search(e.encode("utf-8"))]
        found += [(rule.id, "error", f"negative example {i + 1} matches") for i, e in enumerate(rule.negative_examples) if regex.search(e.encode("utf-8"))]
    return found
