"""The feature tree with its weights: nodes, leaves, scales, dimensions, presets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from phonospark.functions import tables as T


def rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().split("\n")]


@dataclass(frozen=True)
class Dimension:
    """A binary dimension: labels that make it +1, labels that make it -1, a node and a weight."""

    name: str
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    node: str
    weight: float

    @property
    def divisor(self) -> float:
        return 2.0 if self.negative else 1.0


@dataclass(frozen=True)
class Scale:
    name: str
    node: str
    weight: float
    default: int | None
    levels: tuple[str, ...]

    def level(self, features) -> int | None:
        """The first level that is present, else the default."""
        return next((i for i, x in enumerate(self.levels) if x in features), self.default)


@cache
def parents() -> dict[str, str]:
    return {node: up for node, up in rows(T.NODES)}


def lineage(node: str) -> list[str]:
    """The node and all above it, up to Root."""
    out = [node]
    while out[-1] in parents():
        out.append(parents()[out[-1]])
    return out


def depth(node: str) -> int:
    return len(lineage(node))


def _labels(text: str) -> tuple[str, ...]:
    return () if text == "-" else tuple(text.split("|"))


@cache
def leaves() -> tuple[Dimension, ...]:
    out = []
    for name, positive, negative, node, *weight in rows(T.LEAVES):
        out.append(Dimension(name, _labels(positive), _labels(negative), node, float(weight[0]) if weight else 1 / depth(node)))
    return tuple(out)


@cache
def scales() -> tuple[Scale, ...]:
    return tuple(Scale(name, node, float(w), None if d == "-" else int(d), tuple(levels)) for name, node, w, d, *levels in rows(T.SCALES))


@cache
def dimensions() -> tuple[Dimension, ...]:
    """The scalar dimensions of the `distinctive` system."""
    by_leaf = {x.name: x.weight for x in leaves()}
    return tuple(Dimension(name, _labels(p), _labels(n), node, by_leaf[w] if w in by_leaf else float(w)) for name, node, p, n, w in rows(T.DIMENSIONS))


@cache
def groups() -> dict[str, tuple[str, ...]]:
    """Labels that score as sets at a node: mapped to one, but neither a leaf's nor a scale's label."""
    known = {x for leaf in leaves() for x in leaf.positive + leaf.negative} | {x for s in scales() for x in s.levels}
    out: dict[str, list[str]] = {}
    for feature, node in rows(T.FEATURE_NODES):
        if feature not in known:
            out.setdefault(node, []).append(feature)
    return {node: tuple(x) for node, x in out.items()}


@cache
def scored_labels() -> frozenset[str]:
    return frozenset({x for leaf in leaves() for x in leaf.positive + leaf.negative} | {x for s in scales() for x in s.levels} | {x for g in groups().values() for x in g} | set(feature_paths()))


def knows(label: str) -> bool:
    """Whether the label is metadata or scores anywhere."""
    return label in T.METADATA or label.startswith(T.METADATA_PREFIXES) or label in scored_labels()


@cache
def feature_paths() -> dict[str, tuple[str, ...]]:
    """Tree path of every leaf and of its labels: from Root to the leaf's node, the leaf, the label."""
    out: dict[str, tuple[str, ...]] = {}
    for leaf in leaves():
        for x in (leaf.name, *leaf.positive, *leaf.negative):
            out.setdefault(x, (*lineage(leaf.node)[::-1], leaf.name, x))
    return out


class UnknownPreset(ValueError):
    pass


def preset_weight(node: str, base: float, preset: str | None) -> float:
    """The weight under a preset: one for every dimension if flat, else times the node's multipliers."""
    if preset in (None, "", "None"):
        return base
    if preset not in T.PRESETS:
        raise UnknownPreset(preset)
    factors = T.PRESETS[preset]
    if factors is None:
        return 1.0
    for x in lineage(node):
        base *= factors.get(x, 1.0)
    return base


@dataclass(frozen=True)
class System:
    """What a feature system reads: its scorer's columns in order."""

    name: str
    kind: str  # categorical or valued
    scorer: str  # scalar, leaf or valued
    columns: tuple[tuple[str, str], ...] = ()  # (column, node) of a valued system
    version: str = "1.0.0"

    @property
    def binary(self) -> tuple[Dimension, ...]:
        if self.scorer == "valued":
            return tuple(Dimension(c, (f"{c}=+",), (f"{c}=-",), node, 1 / depth(node)) for c, node in self.columns)
        return dimensions() if self.scorer == "scalar" else leaves()

    @property
    def ordinal(self) -> tuple[Scale, ...]:
        return () if self.scorer == "valued" else scales()

    @property
    def grouped(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return tuple(groups().items()) if self.scorer == "leaf" else ()

    @property
    def width(self) -> int:
        return len(self.binary) + len(self.ordinal) + sum(len(x) for _, x in self.grouped)

    def vector_labels(self) -> list[str]:
        return [x.name for x in self.binary] + [s.name for s in self.ordinal] + [f"{node}={x}" for node, labels in self.grouped for x in labels]


def builtin_systems() -> dict[str, System]:
    out = {"descriptive": System("descriptive", "categorical", "leaf"), "distinctive": System("distinctive", "categorical", "scalar")}
    for name, text in T.VALUED_COLUMNS.items():
        out[name] = System(name, "valued", "valued", tuple(tuple(x.rsplit("@", 1)) for x in text.split("|")))
    return out


DEFAULT_SYSTEM = "distinctive"
