"""Distances under a geometry of the user's own, read from JSON.

This is another formula than the built-in leaf scorer's: every leaf is in the denominator, a label that
only one side has costs a half, presets aren't inherited and scales have no default level.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    leaves: tuple[tuple[str, str, str, float], ...]  # node, positive, negative, weight
    mapped: tuple[tuple[str, str], ...]  # feature, node
    scales: tuple[tuple[str, tuple[str, ...], float], ...]
    presets: dict

    @classmethod
    def read(cls, text: str) -> Geometry:
        """Parse and check: one root, every node named once, scales and presets over known nodes."""
        data = json.loads(text)
        up: dict[str, str | None] = {}
        leaves: list = []

        def walk(node: dict, parent: str | None, level: int) -> None:
            if "children" not in node:
                leaves.append((parent, node.get("positive", ""), node.get("negative", ""), float(node.get("weight", 1 / level))))
                return
            if not node.get("name") or node["name"] in up:
                raise ValueError(f"node named twice or not at all: {node.get('name')}")
            up[node["name"]] = parent
            for c in node["children"]:
                walk(c, node["name"], level + 1)

        walk(data["tree"], None, 0)
        scales = []
        for s in data.get("ordinal_scales", []):
            if s["node"] not in up or len(s["levels"]) < 2 or len(set(s["levels"])) < len(s["levels"]):
                raise ValueError(f"bad scale: {s.get('name')}")
            scales.append((s["node"], tuple(s["levels"]), float(s.get("weight", 1.0))))
        for name, preset in data.get("weight_presets", {}).items():
            if isinstance(preset, dict) and set(preset) - set(up):
                raise ValueError(f"preset {name} names unknown nodes")
            if isinstance(preset, dict) and not all(isinstance(w, int | float) and not isinstance(w, bool) and 0 <= w < float("inf") for w in preset.values()):
                raise ValueError(f"preset {name} has weights that aren't numbers of at least 0")
        for f, node in data.get("feature_to_node", {}).items():
            if node not in up:
                raise ValueError(f"feature {f} at an unknown node")
        return cls(tuple(leaves), tuple(data.get("feature_to_node", {}).items()), tuple(scales), data.get("weight_presets", {}))

    @classmethod
    def from_path(cls, path: str) -> Geometry:
        with open(path, encoding="utf-8") as f:
            return cls.read(f.read())

    def factor(self, node: str, preset: str | None) -> float:
        """A preset's weight of this very node; it isn't inherited."""
        if preset is None:
            return 1.0
        if preset not in self.presets:
            raise ValueError(f"unknown preset: {preset}")
        value = self.presets[preset]
        return float(value.get(node, 1.0)) if isinstance(value, dict) else 1.0


def distance(a: Column, b: Column, g: Geometry, preset: str | None = None) -> Column:
    """Weighted mean over all leaves, mapped labels (a leaf's always, others where a side has them) and
    scales on which both sides have a level."""
    num, den = F.lit(0.0), F.lit(0.0)
    has = lambda f, x: F.array_contains(f, x) if x else F.lit(False)
    labels = set()
    for node, p, n, base in g.leaves:
        w = base * g.factor(node, preset)
        on = lambda f, p=p, n=n: has(f, p) & ~has(f, n)
        opposite = (has(a, p) & has(b, n)) | (has(b, p) & has(a, n))
        num, den = num + F.when(on(a) != on(b), F.when(opposite, w).otherwise(w / 2)).otherwise(0.0), den + w
        labels |= {p, n}
    for f, node in g.mapped:
        w = g.factor(node, preset)
        used = F.lit(f in labels) | has(a, f) | has(b, f)
        num, den = num + F.when(has(a, f) != has(b, f), w / 2).otherwise(0.0), den + F.when(used, w).otherwise(0.0)
    for node, levels, base in g.scales:
        w = base * g.factor(node, preset)

        def level(f: Column, levels=levels) -> Column:
            return F.array_min(F.filter(F.array(*(F.when(has(f, x), float(i)) for i, x in enumerate(levels))), lambda v: v.isNotNull()))

        x, y = level(a), level(b)
        both = x.isNotNull() & y.isNotNull()
        num = num + F.when(both, w * F.abs(x - y) / (len(levels) - 1)).otherwise(0.0)
        den = den + F.when(both, w).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(0.0)
