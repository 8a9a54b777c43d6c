"""Checks of a model before any data is read: a list of (code, message), errors first, then warnings from MC3001."""

from __future__ import annotations

from datetime import date

from lumenfold.functions import formula as f

from .schema import Model

TIME_FUNCTIONS = frozenset("prev lag cumulative rolling_avg extrapolate_last_value period_index is_past is_current is_future periods_since_anchor periods_to_end anchor_index".split())
ANCHORED = frozenset("is_past is_current is_future periods_since_anchor anchor_index".split())
#: Days that a period of a granularity may last.
GRANULARITIES = {"day": (1, 1), "week": (7, 7), "month": (28, 31), "quarter": (89, 92), "year": (365, 366)}
SCOPES = ("AllLeaves", "FutureLeaves", "PastLeaves", "CurrentLeaf")


def _twice(values: list) -> set:
    return {v for v in values if values.count(v) > 1}


def validate(model: Model) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    say = lambda code, message: out.append((code, message))
    dims = {d.name: d for d in model.dimensions}
    for n in sorted(_twice([d.name for d in model.dimensions])):
        say("MC2001", f"dimension {n} is declared twice")
    for d in model.dimensions:
        for e in sorted(_twice(d.elements)):
            say("MC2002", f"element {e} of {d.name} is declared twice")
        for h in d.hierarchies:
            known, child_of = set(d.elements), {}
            for parent, child, weight in h.edges:
                for e in (parent, child):
                    if e not in known:
                        say("MC2005", f"hierarchy {h.name} of {d.name} names the unknown element {e}")
                if child in child_of:
                    say("MC2006", f"{child} has two parents in {h.name}")
                child_of[child] = parent
                if not abs(weight) < float("inf"):
                    say("MC2006", f"the weight of {child} is not finite")
            for start in child_of:
                seen, at = set(), start
                while at in child_of and at not in seen:
                    seen.add(at)
                    at = child_of[at]
                if at in seen:
                    say("MC2007", f"hierarchy {h.name} of {d.name} has a cycle through {start}")
                    break
    names = [m.name for m in model.measures]
    for n in sorted(_twice(names)):
        say("MC2003", f"measure {n} is declared twice")
    targets = [r.target for r in model.rules]
    for n in sorted(_twice(targets)):
        say("MC2008", f"measure {n} has two rules")
    for m in model.measures:
        if m.role == "Derived" and m.name not in targets:
            say("MC2009", f"derived measure {m.name} has no rule")
        if m.role == "Input" and m.name in targets:
            say("MC2010", f"input measure {m.name} has a rule")
        if m.aggregation == "WeightedAverage" and (m.weight is None or m.weight not in names):
            say("MC2011", f"weighted average {m.name} has no known weight")
        if m.role == "Indicator":
            if m.name in targets:
                say("MC2063", f"indicator {m.name} has a rule")
            if not m.indicator:
                say("MC2064", f"indicator {m.name} needs a dimension and an element")
            elif m.indicator[0] not in dims:
                say("MC1023", f"indicator {m.name} names the unknown dimension {m.indicator[0]}")
            elif m.indicator[1] not in dims[m.indicator[0]].elements:
                say("MC1022", f"{m.indicator[0]} has no element {m.indicator[1]}")
    reads: dict[str, set[str]] = {}
    for r in model.rules:
        if r.scope not in SCOPES:
            say("MC1029", f"unknown scope {r.scope}")
        elif r.scope != "AllLeaves" and model.anchor is None:
            say("MC2069", f"the scope of {r.target} needs a time anchor")
        try:
            tree = f.parse(r.body)
        except f.FormulaError as e:
            say(e.code, str(e))
            continue
        reads[r.target] = f.names(tree)
        for n in sorted(reads[r.target] - set(names)):
            near = next((x for x in names if x.lower() == n.lower()), None)
            say("MC2003", f"the rule of {r.target} reads the unknown measure {n}" + (f"; did you mean {near}?" if near else ""))
        if pair := f.nested_cross(tree):
            say("MC1013", f"{pair[1]} inside {pair[0]} in the rule of {r.target}")
        if isinstance(tree, f.Text):
            say("MC2058", f"the rule of {r.target} gives text")
        _calls(model, r, tree, say)
    for start in reads:
        path, todo = set(), [start]
        while todo:
            for n in reads.get(todo.pop(), ()):
                if n == start:
                    say("MC2007", f"the rules of {start} form a cycle")
                    todo = []
                    break
                if n not in path:
                    path.add(n)
                    todo.append(n)
    _references(model, say)
    _time(model, say)
    return out


def _calls(model: Model, rule, tree, say) -> None:
    refs, dims = model.refs, {d.name: d for d in model.axes}
    text = lambda x: x.value if isinstance(x, f.Text) else getattr(x, "name", None)
    for node in f.walk(tree):
        if not isinstance(node, f.Call):
            continue
        n, a = node.name, node.args
        if n in TIME_FUNCTIONS and model.time is None:
            say("MC2036", f"{n} needs a time dimension")
        if n in ANCHORED and model.anchor is None:
            say("MC1017", f"{n} needs a time anchor")
        if n in f.OVER and text(a[1]) not in dims:
            say("MC1016", f"{n} names the unknown dimension {text(a[1])}")
        if n in f.OVER:
            for x in (a[0], *a[2:]):
                if isinstance(x, f.Name) and x.name not in {m.name for m in model.measures}:
                    say("MC1018", f"{n} names the unknown measure {x.name}")
        if n in ("current_element", "is_element") and text(a[0]) not in dims:
            say("MC1023", f"{n} names the unknown dimension {text(a[0])}")
        if n == "is_element" and text(a[0]) in dims and text(a[1]) not in dims[text(a[0])].elements:
            say("MC1022", f"{text(a[0])} has no element {text(a[1])}")
        if n == "actual_ref" and len(a) > 1 and (isinstance(a[1], f.Text) or (isinstance(a[1], f.Call) and a[1].name == "current_element")):
            say("MC2066", f"the fallback of actual_ref in {rule.target} is text")
        if n == "actual_ref" and model.default_scenario() is None:
            say("MC2037", "actual_ref needs a default scenario")
        if n == "scenario_ref" and (model.scenario is None or text(a[1]) not in model.scenario.elements):
            say("MC2065", f"unknown scenario {text(a[1])}")
        if n == "extrapolate_last_value" and rule.scope not in ("FutureLeaves",):
            say("MC2067", f"extrapolate_last_value in {rule.target} needs the scope FutureLeaves")
        known = {"lookup": (refs.lookups, "MC2039"), "benchmark": (refs.benchmarks, "MC2038"), "param": (refs.parameters, "MC2062"), "predict": (refs.models, "MC2053")}
        if n in known and text(a[0]) not in known[n][0] and text(a[0]) not in refs.frames:
            say(known[n][1], f"{n} names the unknown {text(a[0])}")
        if n == "bucket" and text(a[1]) not in refs.thresholds:
            say("MC2040", f"bucket names the unknown {text(a[1])}")
        if n == "calibrate" and text(a[1]) not in refs.calibrations:
            say("MC2054", f"calibrate names the unknown {text(a[1])}")
        if n == "predict" and text(a[0]) in refs.models and len(a) - 1 != len(refs.models[text(a[0])]["features"]):
            say("MC2057", f"predict of {text(a[0])} has {len(a) - 1} features")
        strings = [isinstance(x, f.Text) or (isinstance(x, f.Call) and x.name == "current_element") for x in a]
        if n in ("+", "-", "*", "/") and any(strings):
            say("MC1026", f"text in arithmetic in the rule of {rule.target}")
        if n in ("<", ">", "<=", ">=") and any(strings):
            say("MC1027", f"text is ordered in the rule of {rule.target}")
        if n in ("and", "or", "not", "if") and any(strings[:1] if n == "if" else strings):
            say("MC1028", f"text as a truth value in the rule of {rule.target}")


def _references(model: Model, say) -> None:
    refs = model.refs
    for name, bands in refs.thresholds.items():
        tops = [b for b in bands if b is not None]
        if len(bands) < 2 or tops != sorted(set(tops)) or None in bands[:-1]:
            say("MC2041", f"threshold {name} needs two ascending bands or more")
        if bands and bands[-1] is not None:
            say("MC2042", f"the last band of threshold {name} has an end")
    tables = [*refs.benchmarks, *refs.lookups, *refs.thresholds]
    for n in sorted(_twice(tables)):
        say("MC2037", f"reference table {n} is declared twice")
    elements, names = {e for d in model.dimensions for e in d.elements}, {m.name for m in model.measures}
    for p in refs.parameters:
        if p in names:
            say("MC2060", f"parameter {p} has the name of a measure")
        if p in elements:
            say("MC2061", f"parameter {p} has the name of an element")
    for name, table in refs.lookups.items():
        sizes = {k.count("|") for k in table}
        if len(sizes) > 1:
            say("MC2052", f"keys of lookup table {name} have different numbers of parts")
        if sizes - {0} and any("|" in e for e in elements):
            say("MC2051", f"lookup table {name} has keys of several parts, and elements hold their separator")
    for name, m in refs.models.items():
        low, high = m.get("bound", (None, None))
        if low is not None and high is not None and low >= high:
            say("MC2056", f"the bounds of {name} are reversed")
        for x in m["features"]:
            if (a := x.get("adstock")) and (not 0 <= a["rate"] <= 1 or a["max_lookback"] <= 0):
                say("MC2070", f"adstock of {x['name']} needs a rate from 0 to 1 and a lookback above 0")
            if (b := x.get("saturation")) and min(b.get("half", 1), b.get("slope", 1), b.get("scale", 1)) <= 0:
                say("MC2072" if b["kind"] == "hill" else "MC2073", f"saturation of {x['name']} needs parameters above 0")
    for name, c in refs.calibrations.items():
        if "points" in c:
            xs = [p[0] for p in c["points"]]
            if len(xs) < 2:
                say("MC2054", f"calibration {name} needs two points")
            elif xs != sorted(set(xs)):
                say("MC2055", f"the points of {name} don't ascend")


def _time(model: Model, say) -> None:
    time = model.time
    if sum(d.kind == "Time" for d in model.dimensions) > 1:
        say("MC2035", "two time dimensions")
    if model.anchor is not None and (time is None or model.anchor not in time.elements):
        say("MC2048", f"the anchor {model.anchor} is no time element")
    if not time:
        return
    spans = []
    for e in time.elements:
        meta = time.time_meta.get(e, {})
        for k in ("period_start", "period_end_exclusive"):
            if "T" in str(meta.get(k, "")) and not str(meta[k]).endswith("Z"):
                say("MC2044", f"{k} of {e} is no time of UTC")
        try:
            if "period_start" in meta:
                spans.append((date.fromisoformat(str(meta["period_start"])[:10]), date.fromisoformat(str(meta["period_end_exclusive"])[:10]), e))
            elif "date" in meta:
                date.fromisoformat(str(meta["date"]))
        except (ValueError, KeyError):
            say("MC2043", f"the dates of {e} are not ISO dates")
    least, most = GRANULARITIES.get(time.granularity or "", (0, 10**9))
    for start, end, e in spans:
        if not least <= (end - start).days <= most:
            say("MC2045", f"{e} lasts {(end - start).days} days, no {time.granularity}")
    leaves = set(time.leaves())
    spans = sorted(s for s in spans if s[2] in leaves)
    for (_, end, e), (start, _, nxt) in zip(spans, spans[1:], strict=False):
        if start > end:
            say("MC2046", f"a gap between {e} and {nxt}")
        if start < end:
            say("MC2047", f"{e} and {nxt} overlap")
    ordered = [time.time_meta[e].get("date") or time.time_meta[e].get("period_start") for e in time.elements if e in leaves and e in time.time_meta]
    if [str(x) for x in ordered] != sorted(str(x) for x in ordered):
        say("MC3016", "the leaves of time are not in the order of their dates")


def inspect(model: Model) -> dict:
    """Counts and lists that describe a model."""
    return {
        "name": model.name,
        "dimensions": {d.name: {"kind": d.kind, "elements": len(d.elements), "leaves": len(d.leaves()), "hierarchies": [h.name for h in d.hierarchies]} for d in model.dimensions},
        "measures": {m.name: {"role": m.role, "aggregation": m.aggregation, "weight": m.weight} for m in model.measures},
        "rules": {r.target: r.body for r in model.rules},
    }
