"""Feature systems with their inventories, and models that users register at run time.

A Catalog is immutable: registering returns a new one, so a running job never sees a change.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from phonospark.functions import geometry as G
from phonospark.functions import tables
from phonospark.functions.resolver import Resolver, builtin_inventory, spelled

FORMAT_VERSION = 1
VERSION, DATA_PROFILE, UNICODE_VERSION = "0.2.0", "listed", "15.1.0"
INVENTORY = "system string, grapheme string, features array<string>, position int"


class ModelError(ValueError):
    """A model text that is refused, with a status and the line it is about."""

    def __init__(self, status: str, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Model:
    name: str
    rows: tuple[tuple[str, tuple[str, ...]], ...]
    manifest: dict = field(default_factory=dict)


GEOMETRY = "clements-hume"


def parse_model(text: str) -> Model:
    """Read the line format: @directives, `grapheme KEY FEATURE...`, `feature ...` rows without effect, `#` comments.

    A directive is its keyword and white space; whatever else a line holds is unknown. Strict validation
    (the default) refuses unknown lines, graphemes declared twice, labels that the geometry doesn't know
    and graphemes without a label that scores; permissive validation takes all of these. Other types and
    geometries, and newer formats, are unsupported.
    """
    if "\0" in text:
        raise ModelError("parse-error", "NUL in model text")
    head: dict[str, str] = {}
    rows: list[tuple[str, tuple[str, ...]]] = []
    unknown = ""
    for n, line in enumerate(text.split("\n"), 1):
        words = line.split(None, 1)
        if not words or words[0].startswith("#"):
            continue
        keyword, values = words[0], words[1].split() if len(words) > 1 else []
        if not values and line.strip(" \t\r\f\v") == keyword:
            keyword = ""  # a keyword alone is no directive
        first = values[0] if values else ""
        match keyword:
            case "@validation" if first not in ("strict", "permissive"):
                raise ModelError("parse-error", f"line {n}: @validation must be strict or permissive: {first}")
            case "@format_version" if not (first.isascii() and first.isdigit()) or int(first) < 1:
                raise ModelError("parse-error", f"line {n}: @format_version must be a positive integer: {first}")
            case "@format_version" if int(first) > FORMAT_VERSION:
                raise ModelError("unsupported-model", f"line {n}: format {first} is newer than {FORMAT_VERSION}")
            case "@type" if first != "categorical":
                raise ModelError("unsupported-model", f"line {n}: type {first}")
            case "@geometry" if first != GEOMETRY:
                raise ModelError("unsupported-model", f"line {n}: geometry {first}")
            case "grapheme" if len(values) < 2:
                raise ModelError("parse-error", f"line {n}: malformed grapheme row: {line.strip()[:60]}")
            case "grapheme":
                rows.append((spelled(first, True), tuple(values[1:])))
            case "@validation" | "@format_version" | "@model" | "@type" | "@geometry":
                head[keyword[1:]] = first
            case "feature":
                pass
            case _:
                unknown = unknown or f"line {n}: unrecognized line: {line.strip()[:60]}"
    lacking = [what for what, there in (("@model", head.get("model")), ("@type categorical", head.get("type")), ("a grapheme row", rows)) if not there]
    if lacking:
        raise ModelError("parse-error", "a model needs " + ", ".join(lacking))
    if head.get("validation", "strict") == "strict":
        counts = Counter(g for g, _ in rows)
        twice = min((g for g, k in counts.items() if k > 1), default=None)
        problems = [unknown, twice and f"grapheme declared more than once: {twice}"]
        problems += [f"unknown feature: {f}" for _, fs in rows for f in fs if not G.knows(f)]
        problems += [f"no feature that scores: {g}" for g, fs in rows if not G.scored_labels() & set(fs)]
        if found := next(filter(None, problems), None):
            raise ModelError("parse-error", f"strict validation: {found}")
    return Model(head["model"], tuple(rows), head)


MANIFEST = ("name", "version", "source", "interpretation", "license")


def check_manifest(manifest: dict, name: str) -> dict:
    missing = [k for k in MANIFEST if not manifest.get(k)]
    if missing or manifest["name"] != name:
        raise ModelError("invalid-argument", "manifest lacks " + ", ".join(missing) if missing else "manifest names another model")
    return dict(manifest)


def checked(status: str, detail: str = "") -> None:
    """Raise for a status other than ok, as a caller wants that reads one value at a time."""
    if status != "ok":
        raise ModelError(status, f"{status}: {detail}")


@dataclass(frozen=True)
class Catalog:
    """systems by name, in order of registration, each with its inventory in order."""

    systems: dict[str, G.System]
    inventories: dict[str, dict[str, tuple[str, ...]]]
    manifests: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def builtin(cls) -> Catalog:
        """The two categorical systems. Valued systems take their inventories from `with_inventory`."""
        known = G.builtin_systems()
        return cls({n: known[n] for n in ("descriptive", "distinctive")}, dict.fromkeys(("descriptive", "distinctive"), builtin_inventory()))

    def names(self) -> list[str]:
        return list(self.systems)

    def system(self, name: str = G.DEFAULT_SYSTEM) -> G.System:
        if name not in self.systems:
            raise KeyError(f"unknown-system: {name}")
        return self.systems[name]

    def resolver(self, name: str = G.DEFAULT_SYSTEM) -> Resolver:
        return Resolver(self.system(name), self.inventories[name])

    def with_inventory(self, name: str, rows: dict[str, tuple[str, ...]]) -> Catalog:
        """A system (built in by name, or one there already) with these rows, in byte order."""
        system = self.systems.get(name) or G.builtin_systems()[name]
        ordered = dict(sorted(rows.items(), key=lambda x: x[0].encode()))
        return Catalog({**self.systems, name: system}, {**self.inventories, name: ordered}, self.manifests)

    def with_model(self, text: str, manifest: dict | None = None) -> Catalog:
        """Register a model text; a refused one leaves the catalog as it is."""
        model = parse_model(text)
        if model.name in self.systems or model.name in G.builtin_systems():
            raise ModelError("duplicate-name", model.name)
        rows: dict[str, tuple[str, ...]] = {}
        for g, fs in model.rows:
            rows.setdefault(g, fs)
        held = {**self.manifests, model.name: check_manifest(manifest, model.name)} if manifest else self.manifests
        return Catalog({**self.systems, model.name: G.System(model.name, "categorical", "leaf")}, {**self.inventories, model.name: rows}, held)

    def inventory(self, spark: SparkSession, *names: str) -> DataFrame:
        """(system, grapheme, features, position) of the named systems (all by default)."""
        rows = [(n, g, list(f), i) for n in names or self.systems for i, (g, f) in enumerate(self.inventories[n].items())]
        return spark.createDataFrame(rows, INVENTORY)

    def table(self, spark: SparkSession) -> DataFrame:
        """(system, kind, scorer, width, listed) in order of registration."""
        return spark.createDataFrame([(i, s.name, s.kind, s.scorer, s.width, len(self.inventories[n])) for i, (n, s) in enumerate(self.systems.items())], "position int, system string, kind string, scorer string, width int, listed int")

    def fingerprint(self, name: str) -> tuple[str, str]:
        """(payload, SHA-256): key=value lines of all that a system's results depend on."""
        s = self.system(name)
        rows = "\n".join(g + "\t" + "|".join(sorted(f)) for g, f in sorted(self.inventories[name].items(), key=lambda x: x[0].encode()))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = {
            "system": s.name, "system_version": s.version, "kind": s.kind, "scorer": s.scorer, "columns": digest(";".join(s.vector_labels())),
            "inventory": digest(rows), "geometry": digest(tables.NODES + tables.LEAVES + tables.SCALES), "weights": digest(json.dumps(tables.PRESETS, sort_keys=True)),
            "diacritics": digest(tables.COMBINING + tables.SUFFIX + tables.PREFIX + tables.TONE_MARKS), "manifest": digest(json.dumps(self.manifests.get(name), sort_keys=True)), "engine": VERSION, "profile": DATA_PROFILE, "unicode": UNICODE_VERSION,
        }
        payload = "\n".join(f"{k}={v}" for k, v in lines.items())
        return payload, digest(payload)

    def operation_fingerprint(self, system: str = G.DEFAULT_SYSTEM, node_weights: str | None = None, tokenization_policy: str = "default", tone_policy: str = "default", comparison_policy: str = "default", missingness_policy: str = "default", geometry: dict | None = None, **options) -> tuple[str, str]:
        """(payload, SHA-256) of one operation: the system's fingerprint with all settings, as JSON with sorted keys.

        geometry: name, version and sha256 of a geometry of the user's own.
        """
        more = {**options, **({"geometry": geometry} if geometry else {})}
        told = {"system_payload": self.fingerprint(system)[0], "node_weights": node_weights, "tokenization_policy": tokenization_policy, "tone_policy": tone_policy, "comparison_policy": comparison_policy, "missingness_policy": missingness_policy, "options": more}
        payload = "schema=operation-fingerprint-v1\n" + json.dumps(told, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
        return payload, hashlib.sha256(payload.encode()).hexdigest()
