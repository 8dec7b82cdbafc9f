"""Schemas of the inputs, metric order and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

#: Metrics in report order, with label, good, bad, direction and weight.
METRICS = ("locPerModule", "depDepth", "circularDeps", "complexity", "fanInOut")
LABELS = {"locPerModule": "LOC / module", "depDepth": "Dependency depth", "circularDeps": "Circular deps", "complexity": "Complexity", "fanInOut": "Fan-in / fan-out"}
LOWER, HIGHER = "lower-better", "higher-better"
DEFAULT_BASELINES = {
    "locPerModule": {"good": 50, "bad": 150, "direction": LOWER},
    "depDepth": {"good": 5, "bad": 20, "direction": LOWER},
    "circularDeps": {"good": 0, "bad": 3, "direction": LOWER},
    "complexity": {"good": 5, "bad": 20, "direction": LOWER},
    "fanInOut": {"good": 6, "bad": 30, "direction": LOWER},
}
DEFAULT_WEIGHTS = {m: 1 for m in METRICS}
DEFAULT_THRESHOLD = -2
LANGUAGE = "ts"
#: Languages whose files count as modules.
CODE_LANGUAGES = ("JavaScript", "TypeScript", "JSX", "TSX", "TypeScript Typings", "Python", "Rust", "Go", "Java", "C", "C++", "C#")

FILE_GROUPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("Name", T.StringType()),
            T.StructField(
                "Files",
                T.ArrayType(T.StructType([T.StructField("Filename", T.StringType()), T.StructField("Location", T.StringType()), T.StructField("Code", T.DoubleType()), T.StructField("Complexity", T.DoubleType())])),
            ),
        ]
    )
)
MODULE_GRAPH = T.StructType([T.StructField("modules", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StructType([T.StructField("resolved", T.StringType())])))])))])
FILE_STATS = "project string, path string, loc double, complexity double, ord long"
MODULES = "project string, source string"
EDGES = "project string, src string, dst string"
PROJECT_CONFIG = "project string, proj_ord int, src_dir string, last_score double, threshold double"
METRIC_CONFIG = "project string, proj_ord int, metric_ord int, metric string, good double, bad double, direction string, weight double"
