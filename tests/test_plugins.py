from pyspark import TaskContext

from glyphmill.operators import plugins

UNITS = "project string, file string, text string"


def test_a_large_project_runs_over_many_tasks(spark):
    rows = [("big", f"u{i:04d}.tex", "x" * (i % 50)) for i in range(1000)] + [("small", "a.tex", "xyz")]
    units = spark.createDataFrame(rows, UNITS).repartition(6)
    r = plugins.Registry()
    r.add_per_unit("task", lambda file, text, meta: {TaskContext.get().partitionId()}, lambda a, b: a | b, lambda s: [{"code": "TASKS", "message": str(len(s))}])
    r.add_per_unit("sum", lambda file, text, meta: (1, len(text), max((text, file), key=len)), lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])), lambda s: [{"code": "SUM", "message": f"{s[0]} {s[1]}"}, {"code": "TWO", "message": "m", "line": 3}])
    r.add_per_unit("long", lambda file, text, meta: [{"code": "LONG", "message": meta["profile"]}] if len(text) == 49 else [])
    got = r.findings(units, {"profile": "tehran"}).collect()
    by = {(x.project, x.code): x for x in got if x.code != "LONG"}
    assert int(by["big", "TASKS"].message) == 6 and by["small", "TASKS"].message == "1"
    assert by["big", "SUM"].message == f"1000 {sum(i % 50 for i in range(1000))}" and by["small", "SUM"].message == "1 3" and by["big", "TWO"].line == 3
    long = [x for x in got if x.code == "LONG"]
    assert sorted(x.file for x in long) == [f"u{i:04d}.tex" for i in range(1000) if i % 50 == 49] and all(x.plugin == "long" and x.message == "tehran" for x in long)
    assert max(by["big", "TASKS"].pos, 0) < by["big", "SUM"].pos < by["big", "TWO"].pos < min(x.pos for x in long)


def test_failures_stay_with_their_plugin_and_project(spark):
    def boom(*_):
        raise ValueError("boom")

    rows = [("p", f"u{i}.tex", "bad" if i == 3 else "ok") for i in range(9)] + [("q", "v.tex", "ok")]
    units = spark.createDataFrame(rows, UNITS).repartition(3)
    r = plugins.Registry()
    r.add_per_unit("picky", lambda file, text, meta: boom() if text == "bad" else [{"code": "SEEN", "message": "m"}])
    r.add_per_unit("merger", lambda file, text, meta: text, lambda a, b: boom(), lambda s: [{"code": "ONE", "message": s}])
    r.add_per_unit("last", lambda file, text, meta: 1, lambda a, b: a + b, boom)
    r.add("whole", lambda sources, meta: [{"code": "WHOLE", "message": str(len(sources))}])
    r.add("odd", boom)
    r.add("old", boom, "1.0")
    got = {}
    for x in r.findings(units).collect():
        got.setdefault(x.project, []).append((x.plugin, x.code, x.message))
    failed = lambda n: (n, "PLUGIN_FAILURE", f"{n}: boom")
    both = [failed("last"), failed("odd"), ("", "PLUGIN_LOAD_ERROR", "old: API 1.0 is not compatible with 2.0")]
    assert sorted(got["p"]) == sorted([failed("picky"), failed("merger"), ("whole", "WHOLE", "9"), *both])
    assert sorted(got["q"]) == sorted([("picky", "SEEN", "m"), ("merger", "ONE", "ok"), ("whole", "WHOLE", "1"), *both])
    assert r.findings(units.where("false")).count() == 0 and plugins.Registry().findings(units).count() == 0
