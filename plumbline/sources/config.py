"""Configuration: reading, validating and resolving to frames.

Configurations are small and stay on the driver; what the plan needs of them
are two small frames.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.schemas import DEFAULT_BASELINES, DEFAULT_THRESHOLD, DEFAULT_WEIGHTS, HIGHER, LANGUAGE, LOWER, METRIC_CONFIG, METRICS, PROJECT_CONFIG

DEFAULT_PATH = "plumbline.config.json"


class ConfigError(Exception):
    """A configuration that can't be used; the command line ends with 2."""


@dataclass(frozen=True)
class EffectiveProject:
    name: str
    src_dir: str
    last_score: float
    threshold: float
    weights: dict[str, float] = field(hash=False)
    baselines: dict[str, dict[str, Any]] = field(hash=False)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")


def _extra(obj: dict, allowed: set[str], at: str, out: list[tuple[str, str]]) -> None:
    if unknown := [k for k in obj if k not in allowed]:
        out.append((at, "unrecognized keys: " + ", ".join(map(repr, unknown))))


def _join(*parts: str) -> str:
    return ".".join(p for p in parts if p)


def _check_weights(x: Any, at: str, partial: bool, out: list[tuple[str, str]]) -> None:
    if not isinstance(x, dict):
        out.append((at, "expected an object"))
        return
    _extra(x, {LANGUAGE}, at, out)
    inner = x.get(LANGUAGE)
    if inner is None and partial and LANGUAGE not in x:
        return
    if not isinstance(inner, dict):
        out.append((_join(at, LANGUAGE), "expected an object"))
        return
    _extra(inner, set(METRICS), _join(at, LANGUAGE), out)
    for m in METRICS:
        if m not in inner:
            if not partial:
                out.append((_join(at, LANGUAGE, m), "required"))
        elif not _number(inner[m]):
            out.append((_join(at, LANGUAGE, m), "expected a number"))


def _check_baselines(x: Any, at: str, partial: bool, out: list[tuple[str, str]]) -> None:
    if not isinstance(x, dict):
        out.append((at, "expected an object"))
        return
    _extra(x, set(METRICS), at, out)
    for m in METRICS:
        where = _join(at, m)
        if m not in x:
            if not partial:
                out.append((where, "required"))
            continue
        b = x[m]
        if not isinstance(b, dict):
            out.append((where, "expected an object"))
            continue
        _extra(b, {"good", "bad", "direction"}, where, out)
        out.extend((_join(where, k), "expected a number") for k in ("good", "bad") if not _number(b.get(k)))
        if b.get("direction") not in (LOWER, HIGHER):
            out.append((_join(where, "direction"), f"expected {LOWER!r} or {HIGHER!r}"))


def _check_project(p: Any, at: str, out: list[tuple[str, str]]) -> None:
    if not isinstance(p, dict):
        out.append((at, "expected an object"))
        return
    _extra(p, {"name", "srcDir", "lastScore", "threshold", "weights", "baselines"}, at, out)
    for k in ("name", "srcDir"):
        if not isinstance(p.get(k), str) or not p[k]:
            out.append((_join(at, k), "expected a string that isn't empty"))
    if not _number(p.get("lastScore")) or not 0 <= p["lastScore"] <= 10:
        out.append((_join(at, "lastScore"), "expected a number from 0 to 10"))
    if "threshold" in p and not _number(p["threshold"]):
        out.append((_join(at, "threshold"), "expected a number"))
    if "weights" in p:
        _check_weights(p["weights"], _join(at, "weights"), True, out)
    if "baselines" in p:
        _check_baselines(p["baselines"], _join(at, "baselines"), True, out)


def issues(raw: Any) -> list[tuple[str, str]]:
    """All faults of a configuration as (path, message)."""
    out: list[tuple[str, str]] = []
    if not isinstance(raw, dict):
        return [("(root)", "expected an object")]
    _extra(raw, {"language", "threshold", "weights", "baselines", "projects"}, "(root)", out)
    if raw.get("language") != LANGUAGE:
        out.append(("language", f"expected {LANGUAGE!r}"))
    if "threshold" in raw and not _number(raw["threshold"]):
        out.append(("threshold", "expected a number"))
    for key, check in (("weights", _check_weights), ("baselines", _check_baselines)):
        if key in raw:
            check(raw[key], key, False, out)
        else:
            out.append((key, "required"))
    projects = raw.get("projects")
    if not isinstance(projects, list) or not projects:
        out.append(("projects", "expected at least one project"))
        return out
    for i, p in enumerate(projects):
        _check_project(p, f"projects.{i}", out)
    names = [p.get("name") for p in projects if isinstance(p, dict)]
    out.extend((f"projects.{i}.name", f"name {n!r} is used more than once") for i, n in enumerate(names) if isinstance(n, str) and n in names[:i])
    return out


def load_config(raw: Any) -> dict:
    """The validated configuration with its defaults; ``ValueError`` lists all faults."""
    if isinstance(raw, dict) and ("srcDir" in raw or "lastScore" in raw) and "projects" not in raw:
        raise ValueError(
            "The flat configuration of one project is no longer supported: it has a top-level 'srcDir' or 'lastScore' and no 'projects'.\n"
            "Give a 'projects' list whose entries have 'name', 'srcDir' and 'lastScore' ('threshold', 'weights' and 'baselines' stay at the top as defaults), or run init to scaffold one."
        )
    if found := issues(raw):
        raise ValueError("Invalid configuration:\n" + "\n".join(f"  - {path}: {message}" for path, message in found))
    return {**raw, "threshold": raw.get("threshold", DEFAULT_THRESHOLD)}


def load_config_file(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"Cannot read config file: {path} (missing or unreadable).") from e
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"Config file is not valid JSON: {path} — {e}") from e
    try:
        return load_config(raw)
    except ValueError as e:
        raise ConfigError(f"Invalid config file: {path}\n{e}") from e


def resolve_config_path(path: str | None) -> str:
    return os.path.abspath(path or DEFAULT_PATH)


def resolve_projects(config: dict) -> list[EffectiveProject]:
    """Each project, in declared order, with its overrides over the shared values. The configuration isn't changed."""
    shared = config["weights"][LANGUAGE]
    return [
        EffectiveProject(
            p["name"], p["srcDir"], float(p["lastScore"]), float(p.get("threshold", config["threshold"])),
            {m: float(p.get("weights", {}).get(LANGUAGE, {}).get(m, shared[m])) for m in METRICS},
            {m: dict(p.get("baselines", {}).get(m, config["baselines"][m])) for m in METRICS},
        )
        for p in config["projects"]
    ]


def default_config(projects: list[dict]) -> dict:
    return {"language": LANGUAGE, "threshold": DEFAULT_THRESHOLD, "weights": {LANGUAGE: DEFAULT_WEIGHTS}, "baselines": DEFAULT_BASELINES, "projects": projects}


def config_frames(spark: SparkSession, projects: list[EffectiveProject]) -> tuple[DataFrame, DataFrame]:
    """(project_config, metric_config)."""
    head = [(p.name, i, p.src_dir, p.last_score, p.threshold) for i, p in enumerate(projects)]
    rows = [
        (p.name, i, k, m, float(p.baselines[m]["good"]), float(p.baselines[m]["bad"]), p.baselines[m]["direction"], p.weights[m])
        for i, p in enumerate(projects)
        for k, m in enumerate(METRICS)
    ]
    return spark.createDataFrame(head, PROJECT_CONFIG), spark.createDataFrame(rows, METRIC_CONFIG)
