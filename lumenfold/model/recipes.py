"""Ingestion recipes: checked against a model before anything is read. Problems are (code, place, message)."""

from __future__ import annotations

import os.path
from collections.abc import Mapping

import yaml

from .schema import Model

DRIVERS = frozenset("csv sqlite duckdb postgres duckdb_postgres http_json mysql snowflake sqlserver bigquery".split())
#: How an area of the time zone database is written; the names themselves aren't looked up.
ZONES = ("Africa/", "America/", "Antarctica/", "Arctic/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/", "Etc/", "US/", "Canada/")
ABBREVIATED = {
    "EST": "America/New_York", "EDT": "America/New_York", "CST": "America/Chicago", "CDT": "America/Chicago", "MST": "America/Denver", "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles",
    "GMT": "Europe/London", "BST": "Europe/London", "CET": "Europe/Paris", "CEST": "Europe/Paris", "IST": "Asia/Kolkata", "JST": "Asia/Tokyo", "AEST": "Australia/Sydney", "AEDT": "Australia/Sydney",
}
TIMES = frozenset("date datetime timestamp".split())

Problems = list[tuple[str, str, str]]


def parse_recipe(text: str) -> tuple[dict, Problems]:
    """The recipe and what is wrong with its form: YAML, version, driver, fields that must be there."""
    try:
        tree = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return {}, [("MC5001", "/", f"no YAML: {e}")]
    if not isinstance(tree, dict):
        return {}, [("MC5001", "/", "a recipe is a mapping")]
    out: Problems = []
    for k in ("version", "name", "model", "source", "columns"):
        if k not in tree:
            out.append(("MC5007", f"/{k}", f"{k} is missing"))
    if "version" in tree and tree["version"] != 1:
        out.append(("MC5012", "/version", f"version {tree['version']} is not known, 1 is"))
    source, columns = tree.get("source", {}), tree.get("columns", [])
    if not isinstance(source, dict) or not isinstance(columns, list) or not all(isinstance(c, dict) for c in columns) or not isinstance(tree.get("defaults") or {}, dict):
        return tree, [*out, ("MC5001", "/", "source and defaults are mappings, columns a list of mappings")]
    if "source" in tree:
        if "driver" not in source:
            out.append(("MC5007", "/source/driver", "driver is missing"))
        elif source["driver"] not in DRIVERS:
            out.append(("MC5002", "/source/driver", f"unknown driver {source['driver']}"))
    out += [("MC5007", f"/columns/{i}/source", "source is missing") for i, c in enumerate(columns) if "source" not in c]
    return tree, out


def escapes(model_path: str, folder: str, workspace: str) -> bool:
    """Whether a path, taken from a folder, leaves the workspace. By its letters alone, without the file system."""
    root, at = os.path.normpath(workspace), os.path.normpath(os.path.join(folder, model_path))
    return at != root and not at.startswith(root.rstrip("/") + "/")


def validate_recipe(recipe: Mapping, model: Model, folder: str | None = None, workspace: str | None = None) -> Problems:
    """What is wrong with a recipe of good form, all of it in one pass."""
    out: Problems = []
    say = lambda code, place, message: out.append((code, place, message))
    if folder is not None and workspace is not None and escapes(recipe["model"], folder, workspace):
        say("MC5017", "/model", f"{recipe['model']} leaves the workspace")
    source = recipe["source"]
    if source.get("table") is not None and source.get("query") is not None:
        say("MC5003", "/source", "a table or a query, not both")
    dims, measures = {d.name: d for d in model.dimensions}, {m.name: m for m in model.measures}
    time = model.time.name if model.time else None
    first: dict[str, int] = {}
    mapped: dict[str, int] = {}
    for i, c in enumerate(recipe["columns"]):
        name, place, skipped = c["source"], f"/columns/{i}", c.get("skip") is True
        if name in first:
            say("MC5010", f"{place}/source", f"column {name} is mapped at /columns/{first[name]} already")
        first.setdefault(name, i)
        if skipped:
            continue
        d, m = c.get("dimension"), c.get("measure")
        if (d is None) == (m is None):
            say("MC5011", place, f"column {name} needs one target, a dimension or a measure")
        if d is not None:
            mapped.setdefault(d, i)
            if d not in dims:
                say("MC5004", f"{place}/dimension", f"unknown dimension {d}")
            elif d == time and c.get("type") in TIMES and not (c.get("time_format") or c.get("format")):
                say("MC5030", f"{place}/time_format", f"column {name} holds times: their format is needed")
        if m is not None:
            if m not in measures:
                say("MC5005", f"{place}/measure", f"unknown measure {m}")
            else:
                if measures[m].role != "Input":
                    say("MC5018", f"{place}/measure", f"{m} is no input")
                if (t := c.get("type")) is not None and str(t).lower() != measures[m].data_type.lower():
                    say("MC5006", f"{place}/type", f"{m} holds {measures[m].data_type}, not {t}")
            if source.get("format") == "long":
                say("MC5021", f"{place}/measure", "a long source names measures in its rows")
        zone = c.get("time_timezone")
        if zone is None and c.get("type") == "timestamp" and d == time and c.get("timezone_less"):
            say("MC5031", f"{place}/time_timezone", f"column {name} has times without a zone")
        if zone is not None and zone != "UTC" and not any(zone.startswith(z) and len(zone) > len(z) for z in ZONES):
            say("MC5032", f"{place}/time_timezone", f"{zone} is no zone's name; did you mean {ABBREVIATED.get(zone.upper(), 'America/New_York')}?")
    for d, e in (recipe.get("defaults") or {}).items():
        place = f"/defaults/{d}"
        if d in mapped:
            say("MC5016", place, f"{d} has a column, /columns/{mapped[d]}, and a default")
        elif d not in dims:
            say("MC5008", place, f"unknown dimension {d}")
        elif e not in (dims[d].elements if dims[d].kind != "Measure" else list(measures)):
            say("MC5009", place, f"{d} has no element {e}")
    return out
