"""Readers of the two JSON documents of a project: file metrics and module graph."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import is_code_language, is_external
from plumbline.schemas import EDGES, FILE_GROUPS, FILE_STATS, LANGUAGE, MODULE_GRAPH, MODULES


class ToolError(Exception):
    """A tool that failed, or output that isn't what it should be."""


class UnknownLanguageError(ToolError):
    pass


class CommandError(ToolError):
    def __init__(self, command: list[str], cwd: str, status: int | None, stderr: str) -> None:
        super().__init__(f"{' '.join(command)} failed in {cwd} with status {status}: {stderr.strip()}")
        self.command, self.cwd, self.status, self.stderr = command, cwd, status, stderr


@dataclass
class ToolOutput:
    """Frames of all projects: file_stats, modules and edges."""

    file_stats: DataFrame
    modules: DataFrame
    edges: DataFrame


class Source(Protocol):
    id: str
    languages: tuple[str, ...]

    def read(self, spark: SparkSession, projects: list) -> ToolOutput: ...


def run_command(command: list[str], cwd: str, limit: int = 64 << 20) -> str:
    """Standard output of a command, of at most ``limit`` bytes."""
    # What the command complains of goes to a file, so that it can't stop while its output is read, which is up to the limit only.
    with tempfile.TemporaryFile() as complaints:
        try:
            process = subprocess.Popen(command, cwd=cwd, stdout=subprocess.PIPE, stderr=complaints)
        except OSError as e:
            raise CommandError(command, cwd, None, str(e)) from e
        with process:
            out = process.stdout.read(limit + 1)
            if len(out) > limit:
                process.kill()
                raise CommandError(command, cwd, None, f"more than {limit} bytes of output")
        if process.returncode:
            complaints.seek(0)
            raise CommandError(command, cwd, process.returncode, complaints.read().decode(errors="replace"))
    return out.decode()


# --- documents in frames: (project, json, base_dir) --------------------------


def _require(df: DataFrame, ok: Column, what: str, then: Column | None = None) -> DataFrame:
    """Fail the job on the first row where ``ok`` is not true; of the others keep those where ``then`` is.

    Both are one condition, so that no filter can come before the check.
    """
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True) if then is None else then).otherwise(F.raise_error(F.concat(F.lit(f"{what} of project "), F.col("project"))).cast("boolean")))


def relative_path(path: Column, base: Column) -> Column:
    """``path`` as seen from the folder ``base``, where both are absolute; other paths stay."""
    a = F.array_remove(F.split(base, "/"), "")
    b = F.array_remove(F.split(path, "/"), "")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0))))
    return F.when(path.startswith("/") & base.startswith("/"), F.array_join(parts, "/")).otherwise(path)


def parse_file_stats(docs: DataFrame) -> DataFrame:
    """file_stats of (project, json, base_dir): code files, absolute paths seen from ``base_dir``, in document order.

    Only a list of groups with names and files, each file with a name, code and
    complexity, is accepted, of whatever language.
    """
    d = docs.select("project", "base_dir", F.try_parse_json("json").alias("v"), F.from_json("json", FILE_GROUPS).alias("groups"))
    d = _require(d, F.schema_of_variant("v").startswith("ARRAY"), "file metrics that aren't a list,")
    groups = d.select("project", "base_dir", F.posexplode("groups").alias("g", "group"))
    whole = F.col("group.Name").isNotNull() & F.forall("group.Files", lambda f: f["Filename"].isNotNull() & f["Code"].isNotNull() & f["Complexity"].isNotNull())
    groups = _require(groups, whole, "file metrics without names, files, code or complexity,", is_code_language("group.Name"))
    files = groups.select("project", "base_dir", "g", F.posexplode("group.Files").alias("f", "file"))
    path = F.coalesce("file.Location", "file.Filename")
    return files.select(
        "project", relative_path(path, F.coalesce("base_dir", F.lit(""))).alias("path"),
        F.col("file.Code").alias("loc"), F.col("file.Complexity").alias("complexity"),
        (F.col("g").cast("long") * (1 << 32) + F.col("f")).alias("ord"),
    )


def parse_modules(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, edges) of (project, json): external modules and dependencies left out, edges distinct."""
    d = docs.select("project", F.from_json("json", MODULE_GRAPH).alias("d"))
    d = _require(d, F.col("d.modules").isNotNull(), "a graph without modules,")
    mods = d.select("project", F.explode("d.modules").alias("m"))
    whole = F.col("m.source").isNotNull() & F.forall("m.dependencies", lambda x: x["resolved"].isNotNull())
    mods = _require(mods, whole, "a module without source or resolved dependencies,", ~is_external("m.source"))
    deps = mods.select("project", F.col("m.source").alias("src"), F.explode("m.dependencies.resolved").alias("dst"))
    return mods.select("project", F.col("m.source").alias("source")), deps.where(~is_external("dst")).distinct()


def _texts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "project string, json string, base_dir string")


@dataclass
class CapturedJson:
    """Reads ``<srcDir>/<metrics_file>`` and ``<graph_file>``, captured from the tools beforehand, with Spark's reader."""

    metrics_file: str = "file-metrics.json"
    graph_file: str = "module-graph.json"
    id: str = "captured-json"
    languages: tuple[str, ...] = (LANGUAGE,)

    def read(self, spark: SparkSession, projects: list) -> ToolOutput:
        def whole(name: str) -> DataFrame:
            parts = [spark.read.text(f"{p.src_dir.rstrip('/')}/{name}", wholetext=True).select(F.lit(p.name).alias("project"), F.col("value").alias("json"), F.lit(os.path.abspath(p.src_dir)).alias("base_dir")) for p in projects]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out

        modules, edges = parse_modules(whole(self.graph_file))
        return ToolOutput(parse_file_stats(whole(self.metrics_file)), modules, edges)


#: What the graph tool starts from, seen from the project's folder.
SOURCE_GLOBS = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx")


def find_tsconfig(start: str) -> str | None:
    """The nearest tsconfig.json in ``start`` or a folder above."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(found := os.path.join(at, "tsconfig.json")):
            return found
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def graph_tool_config(tsconfig: str | None) -> dict:
    """Options for the graph tool: TypeScript names resolve before JavaScript ones, and packages aren't walked."""
    options: dict = {"tsPreCompilationDeps": True, "exclude": "node_modules", "enhancedResolveOptions": {"extensions": [".ts", ".tsx", ".js", ".jsx"]}}
    if tsconfig:
        options["tsConfig"] = {"fileName": tsconfig}
    return {"options": options}


@dataclass
class ToolCommands:
    """Runs the two command-line tools on the driver, a project after the other, and parses what they print.

    ``{config}`` in the graph command stands for a file with the options of
    :func:`graph_tool_config`.
    """

    metrics_command: tuple[str, ...] = ("scc", "--by-file", "--format", "json", ".")
    graph_command: tuple[str, ...] = ("depcruise", "--config", "{config}", "--output-type", "json", *SOURCE_GLOBS)
    run: Callable[[list[str], str], str] = run_command
    id: str = "tool-commands"
    languages: tuple[str, ...] = (LANGUAGE,)

    def read(self, spark: SparkSession, projects: list) -> ToolOutput:
        metrics, graphs = [], []
        for p in projects:
            cwd = os.path.abspath(p.src_dir)
            with tempfile.TemporaryDirectory() as folder:
                config = os.path.join(folder, "graph-tool.json")
                with open(config, "w", encoding="utf-8") as f:
                    json.dump(graph_tool_config(find_tsconfig(cwd)), f)
                for command, out in ((self.metrics_command, metrics), (self.graph_command, graphs)):
                    text = self.run([c.replace("{config}", config) for c in command], cwd)
                    try:
                        json.loads(text)
                    except ValueError as e:
                        raise ToolError(f"{command[0]} printed what isn't JSON, in {cwd}") from e
                    out.append((p.name, text, cwd))
        modules, edges = parse_modules(_texts(spark, graphs))
        return ToolOutput(parse_file_stats(_texts(spark, metrics)), modules, edges)


@dataclass
class Frames:
    """Frames that are there already, in memory or from tables."""

    file_stats: DataFrame
    modules: DataFrame
    edges: DataFrame
    id: str = "frames"
    languages: tuple[str, ...] = (LANGUAGE,)

    def read(self, spark: SparkSession, projects: list) -> ToolOutput:
        return ToolOutput(self.file_stats, self.modules, self.edges)


class Registry:
    """Sources by language; the first registered one that has the language counts."""

    def __init__(self, sources: list[Source] | None = None) -> None:
        self.sources: list[Source] = list(sources or [])

    def register(self, source: Source) -> None:
        self.sources.append(source)

    def resolve(self, language: str) -> Source:
        for s in self.sources:
            if language in s.languages:
                return s
        raise UnknownLanguageError(f"no source for language {language!r}; registered: {', '.join(s.id for s in self.sources) or 'none'}")


def default_registry() -> Registry:
    return Registry([ToolCommands()])


def empty_output(spark: SparkSession) -> ToolOutput:
    return ToolOutput(spark.createDataFrame([], FILE_STATS), spark.createDataFrame([], MODULES), spark.createDataFrame([], EDGES))
