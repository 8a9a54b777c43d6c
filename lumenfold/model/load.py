"""Models from YAML text."""

from __future__ import annotations

from pathlib import Path

import yaml

from .schema import Dimension, Hierarchy, Measure, Model, ModelError, ReferenceData, Rule

_OPERATORS = {"Add": "+", "Sub": "-", "Mul": "*", "Div": "/"}


def resolve(tree: object, root: Path) -> object:
    """Replace shared-dimension references by what the workspace's catalog holds; paths stay inside of it."""
    prefix = "workspace://shared_dimensions/"
    if isinstance(tree, list):
        return [resolve(x, root) for x in tree]
    if not isinstance(tree, dict):
        return tree
    ref = tree.get("$ref")
    if isinstance(ref, str) and ref.startswith(prefix):
        path = (root / "shared_dimensions" / f"{ref.removeprefix(prefix).removesuffix('.yaml')}.yaml").resolve()
        if not path.is_relative_to(root.resolve()):
            raise ModelError("MC2080", f"{ref} leaves the workspace")
        shared = yaml.safe_load(path.read_text())
        return {**{k: v for k, v in tree.items() if k != "$ref"}, **shared}
    return {k: resolve(v, root) for k, v in tree.items()}


def from_yaml(text: str, workspace: str | None = None) -> Model:
    tree = yaml.safe_load(text)
    return from_tree(resolve(tree, Path(workspace)) if workspace else tree)


def from_tree(tree: dict) -> Model:
    dimensions = []
    for d in tree.get("dimensions", []):
        elements = d.get("elements") or []
        dim = Dimension(d["name"], [e["name"] for e in elements], d.get("kind", "Standard"), granularity=d.get("granularity"))
        for e in elements:
            if e.get("scenario_meta"):
                dim.scenario_meta[e["name"]] = e["scenario_meta"]
            if e.get("version_state"):
                dim.version_state[e["name"]] = e["version_state"]
            dates = {k: e[k] for k in ("date", "period_start", "period_end_exclusive") if k in e}
            if dates:
                dim.time_meta[e["name"]] = dates
        dimensions.append(dim)
    by_name = {d.name: d for d in dimensions}
    shared = [(d["name"], h) for d in tree.get("dimensions", []) for h in d.get("hierarchies") or []]
    for h in [*tree.get("hierarchies", []), *({"dimension": n, **h} for n, h in shared)]:
        if h["dimension"] not in by_name:
            raise ModelError("MC2004", f"a hierarchy names the unknown dimension {h['dimension']}")
        edges = [(e["parent"], e["child"], float(e.get("weight", 1.0))) for e in h.get("edges", [])]
        by_name[h["dimension"]].hierarchies.append(Hierarchy(h["dimension"], edges, h.get("name", "default"), bool(h.get("default", False))))
    measures = []
    for m in tree.get("measures", []):
        indicator = m.get("indicator") or {}
        pair = (indicator.get("dimension") or m.get("dimension"), indicator.get("element") or m.get("element"))
        measures.append(Measure(m["name"], m.get("role", "Input"), m.get("aggregation", "Sum"), m.get("weight_measure"), str(m.get("data_type", "F64")), pair if all(pair) else None))
    rules = [Rule(r["target_measure"], formula_of(r["body"]), r.get("scope", "AllLeaves"), r.get("name", "")) for r in tree.get("rules", [])]
    return Model((tree.get("metadata") or {}).get("name", ""), dimensions, measures, rules, references(tree), tree.get("time_anchor"), tree.get("golden_tests", []), tree.get("canonical_inputs"))


def formula_of(body: object) -> str:
    """A formula string, also of a body written as a tree."""
    if isinstance(body, str):
        return body
    if isinstance(body, (int, float)):
        return repr(float(body))
    kind, inner = next(iter(body.items()))
    if kind in ("Const", "const"):
        value = inner["value"] if isinstance(inner, dict) else inner
        return formula_of(value if not isinstance(value, dict) else next(iter(value.values())))
    if kind in ("MeasureRef", "measure_ref"):
        return inner["measure"] if isinstance(inner, dict) else inner
    parts = list(inner.values()) if isinstance(inner, dict) else list(inner)
    if kind.capitalize() in _OPERATORS:
        parts = parts[0] if len(parts) == 1 and isinstance(parts[0], list) else parts
        return "(" + f" {_OPERATORS[kind.capitalize()]} ".join(formula_of(p) for p in parts) + ")"
    return f"{kind}({', '.join(formula_of(p) for p in parts)})"


def references(tree: dict) -> ReferenceData:
    refs = ReferenceData()
    for b in tree.get("benchmarks", []):
        refs.benchmarks[b["name"]] = {str(k): float(v) for k, v in (b.get("values") or {}).items()}
    for t in tree.get("lookup_tables", []):
        refs.lookups[t["name"]] = {"|".join(map(str, r["key"])) if isinstance(r.get("key"), list) else str(r["key"]): float(r["value"]) for r in t.get("rows", [])} or {str(k): float(v) for k, v in (t.get("values") or {}).items()}
    for t in tree.get("status_thresholds", tree.get("thresholds", [])):
        refs.thresholds[t["name"]] = [b.get("max") for b in t.get("bands", [])]
    for p in tree.get("parameters", []):
        refs.parameters[p["name"]] = float(p.get("value", p.get("default", 0.0)))
    for m in tree.get("fitted_models", []):
        means = {p["feature"]: p for p in (m.get("standardization") or {}).get("params", [])}
        transforms = m.get("transforms") or {}
        stock = {a["feature"]: a for a in transforms.get("adstock", [])}
        bends = {}
        for b in transforms.get("saturation", []):
            bends[b["feature"]] = {"kind": "hill", "slope": b["alpha"], "half": b["gamma"]} if str(b.get("kind", b.get("type", ""))).lower() == "hill" else {"kind": "log", "scale": b["scale"]}
        features = []
        for c in m.get("coefficients", []):
            name = c.get("feature", c.get("name"))
            features.append({"name": name, "coef": float(c.get("weight", c.get("value", 0.0))), "mean": means.get(name, {}).get("mean", 0.0), "std": means.get(name, {}).get("std", 0.0), "adstock": stock.get(name), "saturation": bends.get(name)})
        bound = m.get("output_bound") or {}
        refs.models[m["name"]] = {"intercept": float(m.get("intercept", 0.0)), "features": features, "link": str(m.get("link", "identity")).lower(), "bound": (bound.get("min"), bound.get("max"))}
    for c in tree.get("calibration_maps", []):
        refs.calibrations[c["name"]] = {"platt": (c["a"], c["b"])} if "a" in c else {"points": [(p["x"], p["y"]) if isinstance(p, dict) else tuple(p) for p in c["points"]]}
    return refs
