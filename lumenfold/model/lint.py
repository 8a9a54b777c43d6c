"""Hints about a model that is valid: a list of (code, severity, place, message)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from lumenfold.functions import formula as f

from .schema import Model
from .validate import validate

#: Rules that stand on more than so many others are called a long chain.
LONG_CHAIN = 5
_RATIO = re.compile(r".*_(rate|ratio|pct)|cpc|cvr|aov|cpa|roas", re.I)


def lint(model: Model, tree: Mapping | None = None) -> list[tuple[str, str, str, str]]:
    """tree: the loaded YAML, which has the descriptions."""
    out: list[tuple[str, str, str, str]] = []
    if tree is not None:
        for code, kind, key in (("MC3001", "dimensions", "name"), ("MC3002", "measures", "name"), ("MC3003", "rules", "target_measure")):
            for x in tree.get(kind) or []:
                name = x.get(key) or x.get("target") or x.get("name")
                if not str(x.get("description") or "").strip():
                    out.append((code, "warning", f"{kind}.{name}", f"{kind[:-1]} {name} has no description"))
    if not model.goldens:
        out.append(("MC3004", "warning", "golden_tests", "the model has no golden tests"))
    for d in model.dimensions:
        h = d.hierarchy
        if not h or not h.edges:
            continue
        parents, children = {p for p, _, _ in h.edges}, {c for _, c, _ in h.edges}
        out += [("MC3005", "warning", f"dimensions.{d.name}.{e}", f"{e} is outside of the default hierarchy {h.name}") for e in d.elements if e not in parents | children]
        if len(roots := sorted(parents - children)) > 1:
            out.append(("MC3011", "warning", f"hierarchies.{h.name}", f"{h.name} has the roots {', '.join(roots)}"))
    reads = {r.target: f.names(f.parse(r.body)) for r in model.rules}

    def depth(name: str, path: tuple = ()) -> int:
        return 0 if name not in reads or name in path else 1 + max((depth(n, (*path, name)) for n in reads[name]), default=0)

    out += [("MC3006", "info", f"rules.{r.target}", f"{r.target} stands on {n} rules in a row") for r in model.rules if (n := depth(r.target)) > LONG_CHAIN]
    out += [("MC3007", "warning", f"measures.{m.name}", f"{m.name} is named like a ratio, but is summed") for m in model.measures if m.aggregation == "Sum" and _RATIO.fullmatch(m.name)]
    used = set().union(*reads.values(), {m.weight for m in model.measures if m.weight}, {v for g in model.goldens for v in g.get("coord", {}).values()})
    for role, code in (("Input", "MC3009"), ("Derived", "MC3010")):
        out += [(code, "info", f"measures.{m.name}", f"nothing reads the {role.lower()} measure {m.name}") for m in model.measures if m.role == role and m.name not in used]
    out += [(code, "warning", "dimensions", message) for code, message in validate(model) if code.startswith("MC3")]
    return sorted(out)
