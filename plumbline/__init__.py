"""Structural health analytics over dependency graphs, on Spark DataFrames."""

import importlib
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Public names, by the module that has them; a module is imported when one of its names is first asked for.
_PUBLIC = {
    "plumbline.plans.health": ("scan_projects", "scan_one", "scan_with_raw_config", "score_frames", "ProjectsResult", "ProjectResult"),
    "plumbline.sources.config": ("load_config", "resolve_projects", "default_config", "issues", "ConfigError"),
    "plumbline.sources.tool_json": ("Registry", "ToolCommands", "CapturedJson", "Frames", "run_command", "CommandError", "UnknownLanguageError"),
    "plumbline.operators.graph": ("build_nodes", "structure"),
    "plumbline.operators.metrics": ("compute_metrics", "project_scores"),
    "plumbline.operators.gate": ("evaluate_gate", "gate_one"),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names} | {"scan": "plumbline.plans.health"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_WHERE[name]), "scan_one" if name == "scan" else name)
