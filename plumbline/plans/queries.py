"""A query for each operator, over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import is_code_language, is_external, round_half_up
from plumbline.functions.stats import PERCENTS, distribution, percentile, percentiles
from plumbline.operators import gate, graph, metrics
from plumbline.plans.brand_graph import brand_config, brand_output, raw_edges
from plumbline.plans.health import gate_frame, metrics_of
from plumbline.schemas import CODE_LANGUAGES, HIGHER, LANGUAGE, LOWER, METRICS
from plumbline.scratch import materialize
from plumbline.sources.config import config_frames, default_config, load_config, resolve_projects
from plumbline.sources.tool_json import parse_file_stats, parse_modules

Query = Callable[[SparkSession, str], DataFrame]
_MADE: dict[str, tuple[Query, str | None]] = {}

#: Names for the language filter; four of sixteen aren't code.
_NAMES = [*CODE_LANGUAGES, "Markdown", "JSON", "YAML", "HTML"]

# --- SQL: common table expressions in the order in which they build on each other
_RAW = """raw AS (SELECT p1.p_brand AS project, CAST(l1.l_partkey AS VARCHAR) AS src, CAST(l2.l_partkey AS VARCHAR) AS dst
  FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l2.l_linenumber = l1.l_linenumber + 1
  JOIN part p1 ON p1.p_partkey = l1.l_partkey JOIN part p2 ON p2.p_partkey = l2.l_partkey AND p1.p_brand = p2.p_brand)"""
_EDGES = "edges AS (SELECT DISTINCT project, src, dst FROM raw)"
_STATS = """stats AS (SELECT p_brand AS project, CAST(p_partkey AS VARCHAR) AS node, CAST(FLOOR(COALESCE(q, 0.0) / 10) AS DOUBLE) AS loc, CAST(FLOOR(p_size / 3.0) AS DOUBLE) AS complexity
  FROM part LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey)"""
_NODES = """ends AS (SELECT project, node, 0 AS o, 0 AS i FROM stats UNION ALL SELECT project, src, 1, 0 FROM edges UNION ALL SELECT project, dst, 0, 1 FROM edges),
nodes AS (SELECT e.project, e.node, COALESCE(ANY_VALUE(s.loc), 0.0) AS loc, COALESCE(ANY_VALUE(s.complexity), 0.0) AS complexity, CAST(SUM(i) AS BIGINT) AS fan_in, CAST(SUM(o) AS BIGINT) AS fan_out
  FROM ends e LEFT JOIN stats s ON s.project = e.project AND s.node = e.node GROUP BY 1, 2)"""
_SCC = """reach AS (SELECT project, src, dst FROM edges UNION SELECT r.project, r.src, e.dst FROM reach r JOIN edges e ON e.project = r.project AND e.src = r.dst),
both_ways AS (SELECT a.project, a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.project = b.project AND a.src = b.dst AND a.dst = b.src),
scc AS (SELECT n.project, n.node, LEAST(n.node, COALESCE(MIN(other), n.node)) AS comp FROM nodes n LEFT JOIN both_ways m ON m.project = n.project AND m.node = n.node GROUP BY n.project, n.node)"""
_DEPTH = """dag AS (SELECT DISTINCT e.project, a.comp AS src_comp, b.comp AS dst_comp FROM edges e
  JOIN scc a ON a.project = e.project AND a.node = e.src JOIN scc b ON b.project = e.project AND b.node = e.dst WHERE a.comp <> b.comp),
walk AS (SELECT DISTINCT project, comp, 1 AS depth FROM scc s WHERE NOT EXISTS (SELECT 1 FROM dag d WHERE d.project = s.project AND d.dst_comp = s.comp)
  UNION SELECT w.project, d.dst_comp, w.depth + 1 FROM walk w JOIN dag d ON d.project = w.project AND d.src_comp = w.comp),
depths AS (SELECT project, comp, MAX(depth) AS depth FROM walk GROUP BY 1, 2)"""
_METRICS = """wide AS (SELECT n.project, COALESCE(quantile_cont(CASE WHEN loc > 0 THEN loc END, 0.75), 0.0) AS "locPerModule",
  quantile_cont(CAST(d.depth AS DOUBLE), 0.75) AS "depDepth", COALESCE(MAX(c.p), 0.0) AS "circularDeps",
  COALESCE(quantile_cont(CASE WHEN complexity > 0 THEN complexity END, 0.75), 0.0) AS complexity,
  quantile_cont(CAST(fan_in + fan_out AS DOUBLE), 0.75) AS "fanInOut"
  FROM nodes n JOIN scc s ON s.project = n.project AND s.node = n.node JOIN depths d ON d.project = s.project AND d.comp = s.comp
  LEFT JOIN (SELECT project, quantile_cont(CAST(size AS DOUBLE), 0.75) AS p FROM (SELECT project, comp, COUNT(*) AS size FROM scc GROUP BY 1, 2 HAVING COUNT(*) > 1) GROUP BY 1) c ON c.project = n.project
  GROUP BY n.project)"""
_CONFIG = """brands AS (SELECT project, CAST(row_number() OVER (ORDER BY project) - 1 AS INTEGER) AS proj_ord FROM (SELECT DISTINCT p_brand AS project FROM part)),
project_config AS (SELECT project, proj_ord, CASE WHEN proj_ord % 7 = 0 THEN 0.0 ELSE 6.0 + proj_ord % 4 END::DOUBLE AS last_score, CASE WHEN proj_ord % 3 = 0 THEN -1.0 ELSE -2.0 END::DOUBLE AS threshold FROM brands),
spec(metric_ord, metric, good, bad) AS (VALUES (0, 'locPerModule', 50, 150), (1, 'depDepth', 5, 20), (2, 'circularDeps', 0, 3), (3, 'complexity', 5, 20), (4, 'fanInOut', 6, 30)),
overrides(metric, good, bad) AS (VALUES ('depDepth', 1, 6), ('fanInOut', 0, 4)),
metric_config AS (SELECT b.project, b.proj_ord, CAST(s.metric_ord AS INTEGER) AS metric_ord, s.metric, CAST(COALESCE(o.good, s.good) AS DOUBLE) AS good, CAST(COALESCE(o.bad, s.bad) AS DOUBLE) AS bad,
  'lower-better' AS direction, CASE WHEN s.metric = 'fanInOut' AND proj_ord % 5 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight
  FROM brands b, spec s LEFT JOIN overrides o ON o.metric = s.metric AND b.proj_ord % 2 = 0)"""
_SCORES = """long AS (UNPIVOT wide ON "locPerModule", "depDepth", "circularDeps", complexity, "fanInOut" INTO NAME metric VALUE raw_p75),
subs AS (SELECT c.project, c.proj_ord, c.metric_ord, c.metric, raw_p75, weight, CASE WHEN good = bad THEN CASE WHEN raw_p75 <= good THEN 10.0 ELSE 0.0 END
  ELSE FLOOR((1 - LEAST(1.0, GREATEST(0.0, (raw_p75 - good) / (bad - good)))) * 1000.0::DOUBLE + 0.5) / 100.0::DOUBLE END::DOUBLE AS sub_score FROM metric_config c JOIN long l ON l.project = c.project AND l.metric = c.metric),
scores AS (SELECT project, proj_ord, FLOOR(list_sum(list(weight * sub_score ORDER BY metric_ord)) / list_sum(list(weight ORDER BY metric_ord)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS score FROM subs GROUP BY 1, 2)"""
_GATE = """gated AS (SELECT c.project, c.proj_ord, score AS new_score, last_score, threshold, CASE WHEN last_score = 0 OR score >= last_score + threshold THEN 'pass' ELSE 'fail' END AS decision,
  FLOOR((last_score + threshold) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS floor, last_score = 0 AS seeded FROM project_config c LEFT JOIN scores s ON s.project = c.project)"""
_STEPS = [_RAW, _EDGES, _STATS, _NODES, _SCC, _DEPTH, _METRICS, _CONFIG, _SCORES, _GATE]


def _sql(last: str, select: str) -> str:
    steps = _STEPS[: _STEPS.index(last) + 1]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + select


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _MADE[f.__name__] = (f, sql)
        return f

    return add


@_query(_sql(_EDGES, "SELECT * FROM edges"))
def edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_edges(raw_edges(spark, sf_dir))


@_query("""SELECT page_id, path, (contains(path, 'node_modules') OR starts_with(path, 'node:') OR NOT contains(path, '/')) AS external
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'node:' || url WHEN 2 THEN replace(url, '/', '.') ELSE 'node_modules/' || url END AS path FROM pages)""")
def is_external_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 4, F.col("url")
    path = F.when(k == 0, url).when(k == 1, F.concat(F.lit("node:"), url)).when(k == 2, F.replace(url, F.lit("/"), F.lit("."))).when(k == 3, F.concat(F.lit("node_modules/"), url))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path")).select("page_id", "path", is_external("path").alias("external"))


@_query(f"""SELECT language, COUNT(*) AS files FROM (SELECT list_extract({_NAMES!r}, CAST(p_size % 16 AS INTEGER) + 1) AS language FROM part) WHERE language IN {CODE_LANGUAGES!r} GROUP BY 1""")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("p_size") % 16 + 1)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(language.alias("language"))
    return parts.where(is_code_language("language")).groupBy("language").agg(F.count("*").alias("files"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = brand_output(spark, sf_dir)
    return graph.build_nodes(t.modules, t.edges, t.file_stats)


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = brand_output(spark, sf_dir)
    edges = materialize(graph.distinct_edges(t.edges))
    return graph.structure(edges, graph.build_nodes(t.modules, edges, t.file_stats))


@_query(_sql(_NODES, "SELECT project, node, loc, complexity FROM nodes"))
def nodes_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("project", "node", "loc", "complexity")


@_query(_sql(_NODES, "SELECT project, node, fan_in, fan_out FROM nodes"))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("project", "node", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"))


@_query(_sql(_NODES, "SELECT project, quantile_cont(CAST(fan_in + fan_out AS DOUBLE), 0.75) AS fan_in_out_p75 FROM nodes GROUP BY 1"))
def fan_in_out_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("project").agg(percentile((F.col("fan_in") + F.col("fan_out")).cast("double"), 75).alias("fan_in_out_p75"))


@_query(_sql(_NODES, "SELECT project, COALESCE(quantile_cont(loc, 0.75), 0.0) AS loc_p75 FROM nodes WHERE loc > 0 GROUP BY 1"))
def loc_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("loc > 0").groupBy("project").agg(percentile("loc", 75).alias("loc_p75"))


@_query(_sql(_NODES, "SELECT project, COALESCE(quantile_cont(complexity, 0.75), 0.0) AS complexity_p75 FROM nodes WHERE complexity > 0 GROUP BY 1"))
def complexity_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("complexity > 0").groupBy("project").agg(percentile("complexity", 75).alias("complexity_p75"))


# Interpolation differs in the last bits between engines, so percentiles are compared to six decimals.
_PS = ", ".join(f"FLOOR(quantile_cont(CAST(p_size AS DOUBLE), {p / 100}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS p{p}" for p in PERCENTS)


def _rounded() -> dict[str, Column]:
    return {f"p{p}": round_half_up(f"p{p}", 6) for p in PERCENTS}


@_query(f"SELECT p_brand AS project, {_PS} FROM part GROUP BY 1")
def percentile_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("project")).agg(*percentiles(F.col("p_size").cast("double"))).withColumns(_rounded())


@_query(f'SELECT p_brand AS project, COUNT(*) AS "count", SUM(CAST(p_size AS DOUBLE)) AS "sum", AVG(CAST(p_size AS DOUBLE)) AS mean, MIN(CAST(p_size AS DOUBLE)) AS "min", MAX(CAST(p_size AS DOUBLE)) AS "max", {_PS} FROM part GROUP BY 1')
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("project")).agg(*distribution(F.col("p_size").cast("double"))).withColumns(_rounded())


@_query(_sql(_SCC, "SELECT project, node, comp FROM scc"))
def scc_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select("project", "node", "comp")


@_query(_sql(_SCC, "SELECT s.project, s.node, s.comp FROM scc s SEMI JOIN (SELECT project, src AS node FROM edges UNION SELECT project, dst FROM edges) e USING (project, node)"))
def scc_over_all_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scc_distributed(raw_edges(spark, sf_dir))


@_query(_sql(_SCC, "SELECT project, comp, COUNT(*) AS size FROM scc GROUP BY 1, 2 HAVING COUNT(*) > 1"))
def scc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_sizes(_structure(spark, sf_dir))


@_query(_sql(_METRICS, 'SELECT project, "circularDeps" AS circular_p75 FROM wide'))
def circular_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.sum(F.lit(1)).alias("size")
    comps = _structure(spark, sf_dir).groupBy("project", "comp").agg(sizes)
    return comps.groupBy("project").agg(percentile(F.when(F.col("size") > 1, F.col("size").cast("double")), 75).alias("circular_p75"))


@_query(_sql(_DEPTH, "SELECT project, src_comp, dst_comp FROM dag"))
def condensed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.condense(raw_edges(spark, sf_dir), _structure(spark, sf_dir))


@_query(_sql(_DEPTH, "SELECT s.project, s.node, d.depth FROM scc s JOIN depths d ON d.project = s.project AND d.comp = s.comp"))
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select("project", "node", "depth")


@_query(_sql(_DEPTH, "SELECT project, comp, depth FROM depths"))
def depth_over_all_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scc = _structure(spark, sf_dir).select("project", "node", "comp")
    return graph.longest_path(graph.condense(raw_edges(spark, sf_dir), scc), scc)


@_query(_sql(_DEPTH, "SELECT s.project, quantile_cont(CAST(d.depth AS DOUBLE), 0.75) AS dep_depth_p75 FROM scc s JOIN depths d ON d.project = s.project AND d.comp = s.comp GROUP BY 1"))
def dep_depth_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).groupBy("project").agg(percentile(F.col("depth").cast("double"), 75).alias("dep_depth_p75"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(brand_output(spark, sf_dir))


@_query(_sql(_METRICS, "SELECT project, " + ", ".join(f'"{m}"' for m in METRICS) + " FROM wide"))
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@_query(_sql(_CONFIG, "SELECT project, metric_ord, metric, good, bad, direction, weight FROM metric_config"))
def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_config(spark, sf_dir)[1].drop("proj_ord")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_scores(_wide(spark, sf_dir), brand_config(spark, sf_dir)[1])


@_query(_sql(_SCORES, "SELECT project, metric_ord, metric, raw_p75, sub_score, weight FROM subs"))
def sub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).drop("proj_ord")


@_query(_sql(_SCORES, "SELECT project, proj_ord, score FROM scores"))
def project_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.project_scores(_scores(spark, sf_dir)).select("project", "proj_ord", "score")


@_query(_sql(_SCORES, "SELECT FLOOR(list_sum(list(score ORDER BY proj_ord)) / COUNT(*) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS score FROM scores"))
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.headline(metrics.project_scores(_scores(spark, sf_dir)))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_frame(metrics.project_scores(_scores(spark, sf_dir)), brand_config(spark, sf_dir)[0])


@_query(_sql(_GATE, "SELECT * FROM gated"))
def gate_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)


@_query(_sql(_GATE, "SELECT CASE WHEN bool_or(decision = 'fail') THEN 'fail' ELSE 'pass' END AS decision, COUNT(*) AS n_projects, COUNT(*) FILTER (decision = 'fail') AS n_failed FROM gated"))
def gate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.evaluate_gate_all(_gated(spark, sf_dir))


# --- documents of the tools, made of the tables and read by the production parsers

_FOLDER = "'/repo/' || p_brand"
_STATS_JSON = f"""SELECT project, path, loc, complexity FROM (SELECT p_brand AS project, list_extract({_NAMES!r}, CAST(p_size % 16 AS INTEGER) + 1) AS language, CAST(p_size * 3 AS DOUBLE) AS loc, CAST(p_size % 7 AS DOUBLE) AS complexity,
  CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_partkey || '.ts' WHEN 1 THEN 'lib/' || p_partkey || '.ts' WHEN 2 THEN '../shared/' || p_partkey || '.ts' ELSE p_partkey || '.ts' END AS path FROM part) WHERE language IN {CODE_LANGUAGES!r}"""


@_query(_STATS_JSON)
def parse_file_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute paths inside and outside the project's folder, relative ones, and files without a location."""
    key = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 4
    home = F.concat(F.lit("/repo/"), F.col("p_brand"))
    at = F.when(k == 0, F.concat(home, F.lit("/src/"), key, F.lit(".ts"))).when(k == 1, F.concat(F.lit("lib/"), key, F.lit(".ts"))).when(k == 2, F.concat(F.lit("/repo/shared/"), key, F.lit(".ts")))
    file = F.struct(F.concat(key, F.lit(".ts")).alias("Filename"), at.alias("Location"), (F.col("p_size") * 3).alias("Code"), (F.col("p_size") % 7).alias("Complexity"), F.lit("left out").alias("Extra"))
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("project"), F.element_at(F.array(*map(F.lit, _NAMES)), F.col("p_size") % 16 + 1).alias("Name"), file.alias("file"))
    groups = named.groupBy("project", "Name").agg(F.collect_list("file").alias("Files"))
    docs = groups.groupBy("project").agg(F.to_json(F.collect_list(F.struct("Name", "Files"))).alias("json"))
    return parse_file_stats(docs.withColumn("base_dir", F.concat(F.lit("/repo/"), "project"))).select("project", "path", "loc", "complexity")


def _module(key: Column) -> Column:
    k = F.pmod(key.cast("long"), F.lit(10))
    return F.when(k == 0, F.concat(F.lit("node_modules/"), key, F.lit("/i.js"))).when(k == 1, F.concat(F.lit("node:"), key)).when(k == 2, F.concat(key, F.lit(".js"))).otherwise(F.concat(F.lit("src/"), key, F.lit(".ts")))


def _module_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = raw_edges(spark, sf_dir).groupBy("project", "src").agg(F.collect_list(F.struct(_module(F.col("dst")).alias("resolved"), F.lit(True).alias("followable"))).alias("dependencies"))
    listed = mods.select("project", F.struct(_module(F.col("src")).alias("source"), "dependencies").alias("m"))
    return listed.groupBy("project").agg(F.to_json(F.struct(F.collect_list("m").alias("modules"))).alias("json"))


_SQL_MODULE = "CASE CAST({0} AS BIGINT) % 10 WHEN 0 THEN 'node_modules/' || {0} || '/i.js' WHEN 1 THEN 'node:' || {0} WHEN 2 THEN {0} || '.js' ELSE 'src/' || {0} || '.ts' END"
_OWN = "CAST({0} AS BIGINT) % 10 > 2"


@_query(_sql(_RAW, f"SELECT DISTINCT project, {_SQL_MODULE.format('src')} AS src, {_SQL_MODULE.format('dst')} AS dst FROM raw WHERE {_OWN.format('src')} AND {_OWN.format('dst')}"))
def parse_modules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of documents with packages, built-ins, bare names and repeated dependencies."""
    return parse_modules(_module_documents(spark, sf_dir))[1]


@_query(_sql(_RAW, f"SELECT DISTINCT project, {_SQL_MODULE.format('src')} AS source FROM raw WHERE {_OWN.format('src')}"))
def parsed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_modules(_module_documents(spark, sf_dir))[0]


_LINE_STATS = "lines AS (SELECT p_brand AS project, CAST(l_partkey AS VARCHAR) AS path, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord FROM lineitem JOIN part ON p_partkey = l_partkey)"


@_query(f"WITH {_LINE_STATS} SELECT project, path AS node, CAST(MAX(ord) % 97 AS DOUBLE) AS loc, CAST(MAX(ord) % 13 AS DOUBLE) AS complexity FROM lines GROUP BY 1, 2")
def last_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file has as many stats as its part has lines; the last of them counts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("project"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, "l_partkey").select("project", F.col("l_partkey").cast("string").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ord"))
    stats = lines.select("project", "path", (F.col("ord") % 97).cast("double").alias("loc"), (F.col("ord") % 13).cast("double").alias("complexity"), "ord")
    none = lines.where("false").select("project", F.col("path").alias("src"), F.col("path").alias("dst"))
    return graph.build_nodes(lines.select("project", F.col("path").alias("source")), none, stats).select("project", "node", "loc", "complexity")


@_query(_sql(_DEPTH, "SELECT s.project, CAST(MAX(d.depth) AS INTEGER) AS max_depth, COUNT(DISTINCT d.depth) AS n_depths FROM scc s JOIN depths d ON d.project = s.project AND d.comp = s.comp GROUP BY 1"))
def depth_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depth_range(_structure(spark, sf_dir))


_HIGHER = """higher(metric_ord, metric, good, bad) AS (VALUES (0, 'locPerModule', 40.0::DOUBLE, 2.0::DOUBLE), (1, 'depDepth', 6.0, 1.0), (3, 'complexity', 16.0, 4.0), (4, 'fanInOut', 3.0, 3.0)),
turned AS (SELECT l.project, h.metric, l.raw_p75, CASE WHEN good = bad THEN CASE WHEN raw_p75 >= good THEN 10.0 ELSE 0.0 END
  ELSE FLOOR(LEAST(1.0, GREATEST(0.0, (raw_p75 - bad) / (good - bad))) * 1000.0::DOUBLE + 0.5) / 100.0::DOUBLE END::DOUBLE AS sub_score
  FROM higher h JOIN (UNPIVOT wide ON "locPerModule", "depDepth", "circularDeps", complexity, "fanInOut" INTO NAME metric VALUE raw_p75) l ON l.metric = h.metric)"""


@_query(_sql(_METRICS, "").rstrip() + ",\n" + _HIGHER + "\nSELECT project, metric, raw_p75, sub_score FROM turned")
def higher_better_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-scores by baselines where more is better; one of them has equal ends."""
    spec = [(0, "locPerModule", 40.0, 2.0), (1, "depDepth", 6.0, 1.0), (3, "complexity", 16.0, 4.0), (4, "fanInOut", 3.0, 3.0)]
    config = spark.createDataFrame([(i, m, g, b, HIGHER, 1.0) for i, m, g, b in spec], "metric_ord int, metric string, good double, bad double, direction string, weight double")
    wide = materialize(_wide(spark, sf_dir))
    # A row a brand and metric: four constant rows meet each brand.
    every = wide.select("project", F.lit(0).alias("proj_ord"), F.explode(F.array(*[F.lit(m) for _, m, _, _ in spec])).alias("metric")).join(config, "metric")
    return metrics.metric_scores(wide, every).select("project", "metric", "raw_p75", "sub_score")


@_query(_sql(_CONFIG, "SELECT m.project, m.proj_ord, p.last_score, p.threshold, metric_ord, metric, good, bad, direction, weight FROM metric_config m JOIN project_config p ON p.project = m.project"))
def effective_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands as a configuration file would have them, through validation and override resolution."""
    brands = [r.p_brand for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().orderBy("p_brand").collect()]
    narrow = {"depDepth": {"good": 1, "bad": 6, "direction": LOWER}, "fanInOut": {"good": 0, "bad": 4, "direction": LOWER}}
    projects = []
    for i, brand in enumerate(brands):
        own: dict = {"name": brand, "srcDir": f"./{brand}", "lastScore": 0 if i % 7 == 0 else 6 + i % 4}
        own |= {"threshold": -1} if i % 3 == 0 else {}
        own |= {"baselines": narrow} if i % 2 == 0 else {}
        own |= {"weights": {LANGUAGE: {"fanInOut": 3}}} if i % 5 == 0 else {}
        projects.append(own)
    head, metric = config_frames(spark, resolve_projects(load_config(default_config(projects))))
    return metric.join(head.select("project", "last_score", "threshold"), "project")


_ELEMENT = """to_json({'name': s.project, 'score': s.score, 'breakdown': {'locPerModule': b."locPerModule", 'depDepth': b."depDepth", 'circularDeps': b."circularDeps", 'complexity': b.complexity, 'fanInOut': b."fanInOut"},
  'gate': {'decision': g.decision, 'floor': g.floor, 'lastScore': g.last_score, 'threshold': g.threshold}})"""


@_query(_sql(_GATE, f"""SELECT s.project, s.proj_ord, CAST({_ELEMENT} AS VARCHAR) AS report FROM scores s JOIN gated g ON g.project = s.project
  JOIN (PIVOT (SELECT project, metric, sub_score FROM subs) ON metric IN ('locPerModule', 'depDepth', 'circularDeps', 'complexity', 'fanInOut') USING max(sub_score) GROUP BY project) b ON b.project = s.project"""))
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's element of each project as JSON; a project without a gate has none."""
    scored = metrics.project_scores(_scores(spark, sf_dir))
    gates = _gated(spark, sf_dir).select("project", F.struct("decision", "floor", F.col("last_score").alias("lastScore"), "threshold").alias("gate"))
    parts = F.struct(*[F.element_at("breakdown", i + 1)["sub_score"].alias(m) for i, m in enumerate(METRICS)])
    element = F.struct(F.col("project").alias("name"), "score", parts.alias("breakdown"), "gate")
    return scored.join(gates, "project", "left").select("project", "proj_ord", F.to_json(element).alias("report"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _MADE.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's score and breakdown, in order."""
    return metrics.project_scores(_scores(spark, sf_dir)).orderBy("proj_ord")
