"""Reports, job summaries and write-back. All of these are small and made on the driver."""

from __future__ import annotations

import json
import os
from typing import Any

from plumbline.functions.scalars import one_decimal, round_half_up_py
from plumbline.operators.gate import GateResult, gate_json
from plumbline.schemas import LABELS, METRICS


def _plain(x: Any) -> Any:
    """Whole numbers without a fraction, as JSON writers of other languages print them."""
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x


def to_json(value: Any, indent: int | None = None) -> str:
    return json.dumps(_plain(value), ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


# Fixed format: widths of labels and scores, and the order of blocks.
def format_report(result: Any) -> str:
    """A block a project, and the mean."""
    show = lambda x: "n/a" if x is None else one_decimal(x)
    blocks = [f"{p.name} — health score: {show(p.score)} / 10\n\n" + "\n".join(f"  {LABELS.get(m.metric, m.metric).ljust(18)}{show(m.sub_score).rjust(4)}" for m in p.breakdown) for p in result.projects]
    return "\n\n".join([*blocks, f"plumbline — mean health score: {show(result.score)} / 10"])


def format_json(result: Any, gates: dict[str, GateResult] | None = None) -> dict:
    projects = []
    for p in result.projects:
        element: dict[str, Any] = {"name": p.name, "score": p.score, "breakdown": {m.metric: m.sub_score for m in p.breakdown}}
        if gates and p.name in gates:
            element["gate"] = gate_json(gates[p.name])
        projects.append(element)
    return {"score": result.score, "projects": projects}


# Fixed format: columns, rule line and escapes of the summary.
def job_summary(raw: str, mode: str = "scan", config: str = "") -> str:
    """Markdown of a JSON report; what isn't JSON shows as no data."""
    try:
        report = json.loads(raw)
    except ValueError:
        report = {}
    report = report if isinstance(report, dict) else {}
    projects = report.get("projects") or []
    gated = any(p.get("gate") for p in projects)
    head = ["Project", "Score", *METRICS] + ["Gate", "Floor"] * gated
    rule = ["---------", "------:", "-------------:", "---------:", "-------------:", "-----------:", "---------:"] + ["------", "------:"] * gated
    out = [f"## plumbline — {mode} results", "", f"**Mean score:** {report.get('score', '')}  |  **Config:** `{config}`  |  **Mode:** {mode}", "", "| " + " | ".join(head) + " |", "|" + "|".join(rule) + "|"]
    for p in projects:
        scores = p.get("breakdown") or {}
        cells = [str(p.get("name", "")).replace("|", "&#124;"), p.get("score", ""), *[scores.get(m, "") for m in METRICS]]
        if gated:
            gate = p.get("gate") or {}
            decision = gate.get("decision", "")
            cells += ["FAIL" if decision and decision != "pass" else decision, gate.get("floor", "")]
        out.append("| " + " | ".join(map(str, cells)) + " |")
    if not projects:
        out.append("*(no project data)*")
    return "\n".join([*out, "", "<details><summary>Full JSON output</summary>", "", "```json", raw, "```", "", "</details>"])


def atomic_write(path: str, text: str) -> None:
    """Replace a file in one step; on any failure the old one stays and no temporary file does."""
    tmp = f"{path}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.remove(tmp)
        raise


# Fixed texts: "is not a JSON object" and "No project named" are what callers look for.


def _read_object(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        obj = json.load(f)
    if not isinstance(obj, dict):
        raise TypeError(f"{path} is not a JSON object")
    return obj


def write_last_scores(path: str, scores: dict[str, float]) -> None:
    """Store scores, one decimal, by project name. Order and other values stay; an unknown name writes nothing."""
    obj = _read_object(path)
    projects = obj.get("projects")
    if not isinstance(projects, list):
        raise TypeError(f"there is no list of projects in {path}")
    by_name = {p["name"]: p for p in projects if isinstance(p, dict) and isinstance(p.get("name"), str)}
    for name in scores:
        if name not in by_name:
            raise LookupError(f'No project named "{name}" in {path}')
    for p in projects:
        if isinstance(p, dict) and p.get("name") in scores:
            p["lastScore"] = round_half_up_py(scores[p["name"]], 1)
    atomic_write(path, to_json(obj, 2) + "\n")


def write_last_score(path: str, score: float) -> None:
    """Store the score of the first project, or of a flat configuration."""
    obj = _read_object(path)
    projects = obj.get("projects")
    holder = projects[0] if isinstance(projects, list) and projects and isinstance(projects[0], dict) else obj
    holder["lastScore"] = round_half_up_py(score, 1)
    atomic_write(path, to_json(obj, 2) + "\n")
