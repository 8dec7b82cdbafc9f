import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import gate
from plumbline.plans import health
from plumbline.sinks import report
from plumbline.sources import config as cfg
from plumbline.sources import discover, tool_json
from plumbline.sources.tool_json import CapturedJson, Frames, Registry, ToolCommands, ToolError, UnknownLanguageError


def make_config(*projects, **more):
    return cfg.default_config([{"name": n, "srcDir": f"./{n}", "lastScore": s, **x} for n, s, x in projects]) | more


def frames(spark, files, deps):
    """Frames of {project: {path: (loc, complexity)}} and {project: 'a>b ...'}."""
    stats = [(p, f, float(a), float(b), i) for p, fs in files.items() for i, (f, (a, b)) in enumerate(fs.items())]
    mods = [(p, f) for p, fs in files.items() for f in fs]
    edges = [(p, *e.split(">")) for p, t in deps.items() for e in t.split()]
    return Frames(spark.createDataFrame(stats, "project string, path string, loc double, complexity double, ord int"), spark.createDataFrame(mods, "project string, source string"), spark.createDataFrame(edges, "project string, src string, dst string"))


REPO = {"lib/a": (11, 1), "lib/b": (5, 0), "lib/chain1": (5, 0), "lib/chain2": (4, 0), "lib/chain3": (4, 0), "lib/chain4": (4, 0), "lib/hub": (3, 0)}
REPO_DEPS = "lib/a>lib/b lib/b>lib/a lib/a>lib/hub lib/b>lib/hub lib/chain1>lib/chain2 lib/chain1>lib/hub lib/chain2>lib/chain3 lib/chain3>lib/chain4 lib/chain4>lib/hub"


def test_golden_repository(spark):
    c = make_config(("r", 0, {}))
    out = health.scan_projects(spark, c, Registry([frames(spark, {"r": REPO}, {"r": REPO_DEPS})]))
    assert out.score == out.projects[0].score == 8.67
    assert [m.raw_p75 for m in out.projects[0].breakdown] == [5, 3.5, 2, 1, 3]
    assert [m.sub_score for m in out.projects[0].breakdown] == [10, 10, 3.33, 10, 10]


@pytest.fixture
def two(spark):
    return Registry([frames(spark, {"a": {"lib/math": (8, 1), "lib/utils": (8, 2)}, "b": {"lib/alpha": (5, 1), "lib/beta": (5, 1)}}, {"a": "lib/math>lib/utils", "b": "lib/alpha>lib/beta lib/beta>lib/alpha"})])


def test_two_projects_in_declared_order(spark, two):
    c = make_config(("b", 0, {}), ("a", 0, {}), ("nothing", 0, {}))
    out = health.scan_projects(spark, c, two)
    assert [(p.name, p.score) for p in out.projects] == [("b", 8.67), ("a", 10), ("nothing", 10)]
    assert health.scan_one(spark, c, "b", two).score == 8.67
    with pytest.raises(LookupError):
        health.scan_one(spark, c, "x", two)
    assert health.scan_with_raw_config(spark, make_config(("a", 0, {}), ("b", 0, {})), two).score == 9.34


def test_golden_score_and_weights(spark):
    from plumbline.operators import metrics
    from plumbline.schemas import METRICS

    wide = spark.createDataFrame([("p", 100.0, 5.0, 3.0, 12.5, 42.0)], ["project", *METRICS])
    for weights, expected in (((1, 1, 1, 1, 1), 4), ((6, 1, 1, 1, 1), 4.5), ((0, 0, 0, 0, 0), None)):
        c = make_config(("p", 0, {"weights": {"ts": dict(zip(METRICS, weights))}}))
        _, conf = cfg.config_frames(spark, cfg.resolve_projects(cfg.load_config(c)))
        row = metrics.project_scores(metrics.metric_scores(wide, conf)).first()
        assert row.score == expected
        assert [b.sub_score for b in row.breakdown] == [5, 10, 0, 5, 0]


GATES = [(5.4, 7.4, -2, "pass"), (5.3, 7.4, -2, "fail"), (8.0, 7.4, -2, "pass"), (6.4, 7.4, -1, "pass"), (6.3, 7.4, -1, "fail"), (4.4, 7.4, -3, "pass"), (4.3, 7.4, -3, "fail"), (0.1, 0, -2, "pass"), (0.0, 0, -2, "pass"), (None, 5, -2, "fail"), (None, 0, -2, "pass")]


def test_gate(spark):
    rows = spark.createDataFrame([(str(i), n, float(s), float(t)) for i, (n, s, t, _) in enumerate(GATES)], "project string, new_score double, last_score double, threshold double")
    got = {int(r.project): r for r in gate.evaluate_gate(rows).collect()}
    for i, (n, s, t, d) in enumerate(GATES):
        one = gate.gate_one(n, s, t)
        assert got[i].decision == d == one.decision
        assert (got[i].seeded, got[i].floor) == (s == 0, one.floor)
    assert gate.evaluate_gate_all(gate.evaluate_gate(rows)).first().asDict() == {"decision": "fail", "n_projects": 11, "n_failed": 4}


def test_gate_messages():
    core, slow = gate.gate_one(8.1, 7.4, -2), gate.gate_one(4.5, 7.0, -2)
    assert gate.pass_message(core) == "PASS — score 8.1 ≥ floor 5.4 (last 7.4, threshold -2). Saved 8.1."
    assert gate.fail_message(slow) == "FAIL — score 4.5 < floor 5.0 (last 7.0, threshold -2). Config not updated."
    assert gate.pass_all_message({"core": core}) == "PASS — all 1 project held their floor. Saved 1 baselines."
    assert gate.fail_all_message({"core": core, "cli": slow}).split("\n") == ["FAIL — 1 project regressed beyond its floor. Config not updated.", "  cli — score 4.5 < floor 5.0 (last 7.0, threshold -2, delta -2.5)"]
    assert gate.gate_json(slow) == {"decision": "fail", "floor": 5.0, "lastScore": 7.0, "threshold": -2}


BAD = [
    (lambda c: c.pop("weights"), "weights: required"),
    (lambda c: c.pop("baselines"), "baselines: required"),
    (lambda c: c.update(language="py"), "language:"),
    (lambda c: c.update(extra=1), "'extra'"),
    (lambda c: c.update(projects=[]), "projects:"),
    (lambda c: c["projects"][0].update(lastScore=11), "projects.0.lastScore"),
    (lambda c: c["projects"][0].update(name=""), "projects.0.name"),
    (lambda c: c["projects"][0].update(srcDir=3), "projects.0.srcDir"),
    (lambda c: c["projects"][0].update(weights={"ts": {"depDepth": "x"}}), "projects.0.weights.ts.depDepth"),
    (lambda c: c["projects"][0].update(baselines={"depDepth": {"good": 1, "bad": 2}}), "projects.0.baselines.depDepth.direction"),
    (lambda c: c["projects"].append(dict(c["projects"][0])), "used more than once"),
    (lambda c: c["weights"]["ts"].pop("complexity"), "weights.ts.complexity: required"),
    (lambda c: c.update(threshold=True), "threshold:"),
]


@pytest.mark.parametrize("change,message", BAD)
def test_config_faults(change, message):
    c = json.loads(json.dumps(make_config(("a", 1, {}))))
    change(c)
    with pytest.raises(ValueError, match="Invalid configuration") as e:
        cfg.load_config(c)
    assert message in str(e.value)


def test_config_defaults_and_legacy():
    c = make_config(("a", 1, {}))
    del c["threshold"]
    assert cfg.load_config(c)["threshold"] == -2
    assert cfg.load_config(c | {"threshold": 3})["threshold"] == 3
    with pytest.raises(ValueError, match="flat configuration"):
        cfg.load_config({"srcDir": "x", "lastScore": 1})
    with pytest.raises(ValueError, match="expected an object"):
        cfg.load_config([])


def test_overrides_leave_the_config_alone():
    c = cfg.load_config(make_config(("a", 1, {"threshold": -1, "weights": {"ts": {"depDepth": 4}}, "baselines": {"complexity": {"good": 1, "bad": 9, "direction": "higher-better"}}}), ("b", 2, {})))
    before = json.dumps(c)
    a, b = cfg.resolve_projects(c)
    assert (a.threshold, a.weights["depDepth"], a.weights["complexity"], a.baselines["complexity"]["bad"], a.baselines["depDepth"]["bad"]) == (-1, 4, 1, 9, 20)
    assert (b.threshold, b.weights["depDepth"], b.baselines["complexity"]["bad"]) == (-2, 1, 20)
    assert json.dumps(c) == before


METRIC_JSON = [
    {"Name": "TypeScript", "Files": [{"Filename": "a.ts", "Location": "/r/src/a.ts", "Code": 10, "Complexity": 2, "Extra": 1}, {"Filename": "b.ts", "Code": 5, "Complexity": 1}]},
    {"Name": "JavaScript", "Files": [{"Filename": "c.js", "Location": "lib/c.js", "Code": 1, "Complexity": 0}]},
    {"Name": "Markdown", "Files": [{"Filename": "x.md", "Code": 1, "Complexity": 0}]},
]
GRAPH_JSON = {"modules": [{"source": "src/a.ts", "dependencies": [{"resolved": "src/b.ts"}, {"resolved": "src/b.ts"}, {"resolved": "node_modules/z/i.js"}, {"resolved": "node:path"}, {"resolved": "lodash"}]}, {"source": "node_modules/z/i.js", "dependencies": [{"resolved": "src/a.ts"}]}, {"source": "src/b.ts", "dependencies": []}]}


def documents(spark, *values):
    return spark.createDataFrame([("p", json.dumps(v), "/r/src/") for v in values], "project string, json string, base_dir string")


def test_parsers(spark):
    stats = tool_json.parse_file_stats(documents(spark, METRIC_JSON)).orderBy("ord").collect()
    assert [(r.path, r.loc, r.complexity) for r in stats] == [("a.ts", 10, 2), ("b.ts", 5, 1), ("lib/c.js", 1, 0)]
    modules, edges = tool_json.parse_modules(documents(spark, GRAPH_JSON))
    assert {r.source for r in modules.collect()} == {"src/a.ts", "src/b.ts"}
    assert [(r.src, r.dst) for r in edges.collect()] == [("src/a.ts", "src/b.ts")]
    assert tool_json.parse_file_stats(documents(spark, [])).count() == 0
    paths = spark.createDataFrame([("/r/src/a/b", "/r/src"), ("/r/other/c", "/r/src/"), ("/x", "/r/src"), ("rel/a", "/r/src"), ("/r/src", "/r/src"), ("/r/a", "")], "p string, b string")
    assert [r.q for r in paths.select(tool_json.relative_path(F.col("p"), F.col("b")).alias("q")).collect()] == ["a/b", "../other/c", "../../x", "rel/a", "", "/r/a"]
    assert tool_json.parse_modules(documents(spark, {"modules": []}))[0].count() == 0


@pytest.mark.parametrize("bad", [{"a": 1}, [{"Name": "TypeScript"}], [{"Name": "TypeScript", "Files": [{"Filename": "a", "Complexity": 1}]}], [{"Name": "Markdown", "Files": [{"Code": 1, "Complexity": 1}]}]])
def test_bad_metrics(spark, bad):
    with pytest.raises(Exception, match="of project p"):
        tool_json.parse_file_stats(documents(spark, bad)).collect()


@pytest.mark.parametrize("bad", [{}, {"modules": [{"source": "a/b"}]}, {"modules": [{"source": "a/b", "dependencies": [{}]}]}, {"modules": [{"source": "node_modules/b", "dependencies": [{}]}]}])
def test_bad_graphs(spark, bad):
    with pytest.raises(Exception, match="of project p|project p"):
        tool_json.parse_modules(documents(spark, bad))[1].collect()


def test_captured_and_commands(spark, tmp_path):
    for name, value in (("file-metrics.json", METRIC_JSON), ("module-graph.json", GRAPH_JSON)):
        (tmp_path / name).write_text(json.dumps(value))
    c = cfg.load_config(cfg.default_config([{"name": "p", "srcDir": str(tmp_path), "lastScore": 0}]))
    captured = health.scan_projects(spark, c, Registry([CapturedJson()]))
    seen = []

    def fake(command, cwd):
        seen.append(command[0])
        return json.dumps(METRIC_JSON if command[0] == "scc" else GRAPH_JSON)

    assert health.scan_projects(spark, c, Registry([ToolCommands(run=fake)])).score == captured.score
    assert seen == ["scc", "depcruise"]
    with pytest.raises(ToolError, match="isn't JSON"):
        health.scan_projects(spark, c, Registry([ToolCommands(run=lambda *_: "no")]))


def test_commands_and_registry(tmp_path):
    assert tool_json.run_command(["echo", "hi"], str(tmp_path)) == "hi\n"
    for bad in (["false"], ["no-such-tool-here"]):
        with pytest.raises(tool_json.CommandError):
            tool_json.run_command(bad, str(tmp_path))
    with pytest.raises(tool_json.CommandError, match="more than"):
        tool_json.run_command(["echo", "long"], str(tmp_path), limit=2)
    first, second = ToolCommands(id="x"), ToolCommands(id="y")
    r = Registry([first])
    r.register(second)
    assert r.resolve("ts") is first
    with pytest.raises(UnknownLanguageError, match="x, y"):
        r.resolve("py")
    (tmp_path / "tsconfig.json").write_text("{}")
    (tmp_path / "a").mkdir()
    assert tool_json.find_tsconfig(str(tmp_path / "a")) == str(tmp_path / "tsconfig.json")


class Tree(discover.LocalFiles):
    """Files given as {path: text}."""

    def __init__(self, files):
        self.files = files

    def exists(self, path):
        return path in self.files

    def read(self, path):
        return self.files[path]

    def is_dir(self, path):
        return any(f.startswith(path.rstrip("/") + "/") for f in self.files)

    def list(self, path):
        at = path.rstrip("/") + "/"
        return sorted({f[len(at) :].split("/")[0] for f in self.files if f.startswith(at)})


def found(files):
    return [(p.name, p.src_dir) for p in discover.discover_workspaces(Tree({f"/r/{k}": v for k, v in files.items()}), "/r")]


def test_discovery():
    pkgs = {"packages/b/package.json": '{"name": "@x/b"}', "packages/a/package.json": "{}", "packages/none/readme": "", "apps/deep/er/package.json": '{"name": "er"}', "tools/package.json": "bad"}
    assert found({"package.json": '{"workspaces": ["packages/*", 3]}', **pkgs}) == [("a", "./packages/a"), ("@x/b", "./packages/b")]
    assert found({"package.json": '{"workspaces": {"packages": ["apps/**", "tools"]}}', **pkgs}) == [("er", "./apps/deep/er"), ("tools", "./tools")]
    yaml = "# c\npackages:\n  - 'packages/*' # all\n\n  - tools\nother:\n  - apps/**\n"
    assert found({"package.json": "nonsense", "pnpm-workspace.yaml": yaml, **pkgs}) == [("a", "./packages/a"), ("@x/b", "./packages/b"), ("tools", "./tools")]
    assert found({"package.json": '{"workspaces": ["packages/a"]}', "pnpm-workspace.yaml": "packages:\n- packages/a\n", **pkgs}) == [("a", "./packages/a")]
    assert found(pkgs) == []


def test_names_order_and_quotes_of_discovery():
    pkgs = {"p/b/package.json": '{"name": " "}', "p/B/package.json": "{}", "p/é/package.json": "{}", "p/e/package.json": "{}", "p/f/package.json": "{}", "p/_x/package.json": "{}", "p/2/package.json": "{}"}
    assert [d for _, d in found({"package.json": '{"workspaces": ["p/*"]}', **pkgs})] == ["./p/_x", "./p/2", "./p/b", "./p/B", "./p/e", "./p/é", "./p/f"]
    assert ("b", "./p/b") in found({"package.json": '{"workspaces": ["p/*"]}', **pkgs})
    assert discover.globs_from_workspace_yaml("a:\n  - no\npackages: # these\n  - \"x # y\"\n  -\n  - 'z' # c\nb:\n  - no\n") == ["x # y", "z"]


def test_public_names():
    import plumbline

    assert all(callable(getattr(plumbline, name)) for name in plumbline.__all__)
    assert plumbline.scan is plumbline.scan_one
    with pytest.raises(AttributeError):
        plumbline.nothing


def test_graph_tool_options():
    assert tool_json.graph_tool_config(None)["options"]["exclude"] == "node_modules"
    assert ToolCommands().graph_command[-4:] == ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx")


def test_write_back(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    text = '{\n  "z": 1,\n  "projects": [\n    {\n      "name": "a",\n      "lastScore": 7.4,\n      "x": "é"\n    },\n    {\n      "name": "b",\n      "lastScore": 1\n    }\n  ]\n}\n'
    path.write_text(text)
    report.write_last_scores(str(path), {"a": 7.4499})
    assert path.read_text() == text
    report.write_last_scores(str(path), {"a": 6.05, "b": 10.0})
    assert path.read_text() == text.replace("7.4", "6.1").replace('"lastScore": 1\n', '"lastScore": 10\n')
    before = path.read_text()
    with pytest.raises(LookupError, match='"no"'):
        report.write_last_scores(str(path), {"a": 1, "no": 2})
    monkeypatch.setattr(os, "replace", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        report.write_last_scores(str(path), {"a": 1})
    assert path.read_text() == before
    assert os.listdir(tmp_path) == ["c.json"]
    monkeypatch.undo()
    report.write_last_score(str(path), 3.14)
    assert json.loads(path.read_text())["projects"][0]["lastScore"] == 3.1


RESULT = health.ProjectsResult(tuple(health.ProjectResult(n, s, tuple(health.MetricScore(m, 1.0, x, 1.0) for m, x in zip(cfg.METRICS, (10.0, 10.0, 3.33, 10.0, 10.0)))) for n, s in (("a", 8.67), ("b", 5.0))), 6.84)


def test_reports():
    text = report.format_report(RESULT)
    assert text.startswith("a — health score: 8.7 / 10\n\n  LOC / module      10.0\n  Dependency depth  10.0\n  Circular deps      3.3\n")
    assert text.endswith("\n\nplumbline — mean health score: 6.8 / 10")
    as_json = report.to_json(report.format_json(RESULT, {"b": gate.gate_one(5.0, 7.0, -2.0)}))
    assert '"gate":{"decision":"pass","floor":5,"lastScore":7,"threshold":-2}' in as_json
    assert as_json.startswith('{"score":6.84,"projects":[{"name":"a","score":8.67,"breakdown":{"locPerModule":10,')
    summary = report.job_summary(as_json.replace('"a"', '"a|x"'), "gate", "c.json")
    assert "| a&#124;x | 8.67 | 10 | 10 | 3.33 | 10 | 10 |  |  |" in summary
    assert "| b | 5 | 10 | 10 | 3.33 | 10 | 10 | pass | 5 |" in summary
    assert "*(no project data)*" in report.job_summary("nonsense")


class Spy(cli.Writer):
    def __init__(self):
        self.outs, self.errs = [], []

    def out(self, text):
        self.outs.append(text)

    def err(self, text):
        self.errs.append(text)


def test_command_line(tmp_path):
    path = str(tmp_path / "c.json")
    w = Spy()
    assert cli.run(["init", "-c", path], w) == 0
    assert cli.run(["init", "-c", path], w) == 2
    assert cli.run(["init", "-c", path, "--force"], w) == 0
    with open(path, "w") as f:
        f.write(report.to_json(make_config(("a", 8.0, {}), ("b", 7.0, {})), 2))
    scan = lambda c: RESULT
    before = open(path).read()
    assert cli.run(["scan", "-c", path], w, scan) == 0
    assert open(path).read() == before
    assert cli.run(["gate", "-c", path, "--json"], w, scan) == 0
    assert [p["lastScore"] for p in json.loads(open(path).read())["projects"]] == [8.7, 5]
    with open(path, "w") as f:
        f.write(report.to_json(make_config(("a", 8.0, {}), ("b", 9.0, {})), 2))
    w = Spy()
    before = open(path).read()
    assert cli.run(["scan", "--gate", "-c", path], w, scan) == 1
    assert w.errs[0].startswith("FAIL — 1 project")
    assert cli.run(["gate", "--json", "-c", path], w, scan) == 1
    assert len(w.errs) == 1
    assert open(path).read() == before
    assert cli.run(["scan", "-c", str(tmp_path / "none.json")], w, scan) == 2
    assert cli.run(["bogus"], w) == 2
    assert cli.run(["--help"], w) == 0
    assert cli.run(["scan", "-c", path], w, lambda c: 1 / 0) == 2


def test_gate_stream(spark, tmp_path):
    from plumbline.streaming.history import gate_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 5.3), ("b", 8.0)], "project string, new_score double").write.parquet(source)
    conf = spark.createDataFrame([("a", 7.4, -2.0), ("b", 7.4, -2.0)], "project string, last_score double, threshold double")
    stream = spark.readStream.schema("project string, new_score double").parquet(source)
    gate_stream(stream, conf, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {(r.project, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "fail"), ("b", "pass")}
