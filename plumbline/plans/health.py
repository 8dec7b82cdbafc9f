"""The health plan: all projects of a configuration scored in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import round_half_up_py
from plumbline.operators import gate as gates
from plumbline.operators import graph, metrics
from plumbline.scratch import materialize
from plumbline.sources import config as cfg
from plumbline.sources.tool_json import Registry, ToolCommands, ToolOutput, default_registry


@dataclass(frozen=True)
class MetricScore:
    metric: str
    raw_p75: float
    sub_score: float
    weight: float


@dataclass(frozen=True)
class ProjectResult:
    name: str
    score: float | None
    breakdown: tuple[MetricScore, ...]


@dataclass(frozen=True)
class ProjectsResult:
    projects: tuple[ProjectResult, ...]
    score: float | None


def metrics_of(tools: ToolOutput) -> DataFrame:
    """The five metrics of all projects. The edges are read from their source once; nodes and structure both start from the table made of them."""
    edges = materialize(graph.distinct_edges(tools.edges))
    nodes = graph.build_nodes(tools.modules, edges, tools.file_stats)
    return metrics.compute_metrics(nodes, graph.structure(edges, nodes))


def score_frames(tools: ToolOutput, metric_config: DataFrame) -> DataFrame:
    """project_scores of the frames of all projects."""
    return metrics.project_scores(metrics.metric_scores(metrics_of(tools), metric_config))


def scan_projects(spark: SparkSession, config: dict, registry: Registry | None = None, runner: Callable[[list[str], str], str] | None = None) -> ProjectsResult:
    """Score every project of a validated configuration; the results, a row a project, come to the driver in declared order.

    ``runner`` runs the commands of the default registry.
    """
    projects = cfg.resolve_projects(config)
    tools = (registry or (Registry([ToolCommands(run=runner)]) if runner else default_registry())).resolve(config["language"]).read(spark, projects)
    _, metric_config = cfg.config_frames(spark, projects)
    rows = score_frames(tools, metric_config).orderBy("proj_ord").collect()
    out = tuple(ProjectResult(r.project, r.score, tuple(MetricScore(b.metric, b.raw_p75, b.sub_score, b.weight) for b in r.breakdown)) for r in rows)
    known = [p.score for p in out if p.score is not None]
    return ProjectsResult(out, round_half_up_py(sum(known) / len(out)) if len(known) == len(out) and out else None)


def scan_one(spark: SparkSession, config: dict, name: str, registry: Registry | None = None) -> ProjectResult:
    """Score the project called ``name``."""
    only = {**config, "projects": [p for p in config["projects"] if p["name"] == name]}
    if not only["projects"]:
        raise LookupError(f'No project named "{name}".')
    return scan_projects(spark, only, registry).projects[0]


def scan_with_raw_config(spark: SparkSession, raw: Any, registry: Registry | None = None) -> ProjectsResult:
    return scan_projects(spark, cfg.load_config(raw), registry)


def gate_frame(scores: DataFrame, project_config: DataFrame) -> DataFrame:
    """Gate rows of project_scores, by project name."""
    new = scores.select("project", F.col("score").alias("new_score"))
    return gates.evaluate_gate(project_config.join(new, "project", "left").select("project", "proj_ord", "new_score", "last_score", "threshold"))


def gate_results(result: ProjectsResult, projects: list[cfg.EffectiveProject]) -> dict[str, gates.GateResult]:
    last = {p.name: p for p in projects}
    return {p.name: gates.gate_one(p.score, last[p.name].last_score, last[p.name].threshold) for p in result.projects}
