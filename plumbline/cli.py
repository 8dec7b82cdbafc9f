"""Command line: init, scan and gate. ``run`` returns the exit code: 0, 1 for a failed gate, 2 for errors."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from typing import Any

from plumbline.operators.gate import fail_all_message, pass_all_message
from plumbline.plans.health import ProjectsResult, gate_results, scan_projects
from plumbline.sinks.report import format_json, format_report, to_json, write_last_scores
from plumbline.sources.config import ConfigError, default_config, load_config_file, resolve_config_path, resolve_projects
from plumbline.sources.discover import Files, LocalFiles, discover_workspaces

Scan = Callable[[dict], ProjectsResult]
ROOT_PROJECT = {"name": ".", "srcDir": "./src", "lastScore": 0}


class Writer:
    """Where output goes."""

    def out(self, text: str) -> None:
        print(text)

    def err(self, text: str) -> None:
        print(text, file=sys.stderr)


class _UsageError(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> Any:
        raise _UsageError(f"{self.prog}: {message}")


def _spark_scan(config: dict) -> ProjectsResult:
    from pyspark.sql import SparkSession

    return scan_projects(SparkSession.builder.appName("plumbline").getOrCreate(), config)


def run_init(path: str, force: bool, writer: Writer, files: Files | None = None, root: str | None = None, prompt: Callable[[dict], list[dict]] | None = None) -> int:
    """Scaffold a configuration of the discovered packages, or of one root project."""
    if os.path.exists(path) and not force:
        raise ConfigError(f"{path} is there already; --force replaces it")
    found = [{"name": p.name, "srcDir": p.src_dir, "lastScore": 0} for p in discover_workspaces(files or LocalFiles(), root or os.getcwd())]
    chosen = found or (prompt(ROOT_PROJECT) if prompt else []) or [ROOT_PROJECT]
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json(default_config(chosen), 2) + "\n")
    writer.out(f"{path} written")
    writer.out("one project, the root: there are no workspaces" if chosen == [ROOT_PROJECT] else f"projects found: {len(chosen)}")
    return 0


def run_scan(path: str, gated: bool, as_json: bool, writer: Writer, scan: Scan = _spark_scan) -> int:
    """Report; or gate, and store the new scores if all projects pass."""
    config = load_config_file(path)
    result = scan(config)
    if not gated:
        writer.out(to_json(format_json(result)) if as_json else format_report(result))
        return 0
    gates = gate_results(result, resolve_projects(config))
    failed = any(g.decision == "fail" for g in gates.values())
    if not failed:
        write_last_scores(path, {p.name: p.score for p in result.projects if p.score is not None})
    writer.out(to_json(format_json(result, gates)) if as_json else format_report(result))
    if not as_json:
        (writer.err if failed else writer.out)((fail_all_message if failed else pass_all_message)(gates))
    return int(failed)


def run(argv: list[str], writer: Writer | None = None, scan: Scan = _spark_scan, files: Files | None = None, prompt: Callable[[dict], list[dict]] | None = None) -> int:
    writer = writer or Writer()
    parser = _Parser("plumbline", description="Structural health scores, 0 to 10, of projects with files and dependencies.")
    commands = parser.add_subparsers(dest="command", required=True)
    init, scanned, gated = commands.add_parser("init"), commands.add_parser("scan"), commands.add_parser("gate")
    for p in (init, scanned, gated):
        p.add_argument("-c", "--config", help="path of the configuration")
    init.add_argument("-f", "--force", action="store_true", help="overwrite an existing configuration")
    scanned.add_argument("--gate", action="store_true", help="behave like gate")
    for p in (scanned, gated):
        p.add_argument("--json", action="store_true", help="print JSON")
    try:
        args = parser.parse_args(argv)
        path = resolve_config_path(args.config)
        if args.command == "init":
            return run_init(path, args.force, writer, files, prompt=prompt)
        return run_scan(path, args.command == "gate" or args.gate, args.json, writer, scan)
    except SystemExit as e:
        return 0 if not e.code else 2
    except (_UsageError, ConfigError) as e:
        writer.err(str(e))
        return 2
    except Exception as e:  # the last resort of a command line
        writer.err(f"plumbline: unexpected error — {e}")
        return 2


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
