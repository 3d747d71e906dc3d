from pyspark.sql import functions as F

from condeval.operators import grid as G
from condeval.operators import pool as P


def test_grid_and_samples(frame):
    items = frame([("a",), ("b",)], "item string")
    cells = G.condition_grid(items)
    assert cells.count() == 18 and cells.schema["coefficient"].dataType.typeName() == "double"
    assert G.repeat_samples(cells).count() == 90
    texts = frame([("a", ["x", "y"])], "item string, continuations array<string>")
    assert [tuple(r) for r in G.sample_rows(texts).collect()] == [("a", 0, "x"), ("a", 1, "y")]


def test_pending_conditions_match_an_anti_join(frame):
    items = frame([("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1)], "k string, v int")
    done = frame(
        [("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 1.2), ("a", 2, 9.9), ("b", 1, -1.2), (None, 1, 0.0), ("a", 1, None)],
        "k string, v int, coefficient double",
    )
    got = G.pending_conditions(items, done, ["k", "v"])
    grid = G.condition_grid(items)
    want = grid.join(done, ["k", "v", "coefficient"], "left_anti").select(*grid.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.filter("k is null").count() == 9
    assert got.filter("k = 'b'").count() == 16


def test_pending_rows_keep_duplicates_and_null_keys(frame):
    rows = frame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, n int")
    done = frame([("a",), ("a",), (None,)], "k string")
    assert sorted(r["n"] for r in G.pending_rows(rows, done, ["k"]).collect()) == [2, 3, 4]


POOL = "sentence string, idiom string, span string, usage string"


def test_contrast_pool(frame):
    first = frame(
        [("s1", "See red", "see red", "idiomatic"), ("s2", "see red", "saw red", "literal"), ("s3", "x", "X", "other")],
        POOL,
    )
    second = frame([("s1", "See red", "see red", "idiomatic"), ("s4", "x", "X", "literal"), ("s5", None, "x", "literal")], POOL)
    pool = P.contrast_pool([first, second])
    assert sorted((r["sentence"], r["label"]) for r in pool.collect()) == [
        ("s1", "figurative"),
        ("s1", "figurative"),
        ("s4", "literal"),
    ]
    balance = {r["label"]: (r["n"], r["share"]) for r in P.class_balance(pool).collect()}
    assert balance == {"figurative": (2, 2 / 3), "literal": (1, 1 / 3)}


def test_unknown_usage_maps_to_null(frame):
    from condeval.functions.columns import value_map

    rows = frame([("idiomatic",), ("other",), (None,)], "usage string")
    got = [r[0] for r in rows.select(value_map("usage", P.USAGE_CLASSES)).collect()]
    assert got == ["figurative", None, None]


def test_profiles(frame):
    rows = frame([("a", True), ("a", False), ("b", True), (None, None)], "c string, gold boolean")
    counts = [tuple(r) for r in P.value_counts(rows, "c").collect()]
    assert counts == [("c", "a", 2), ("c", "b", 1)]
    assert tuple(P.shape(rows, ["c"], ["gold"]).first()) == (4, 2, 2)
    assert [r["c"] for r in P.distinct_values(rows, "c").collect()] == [None, "a", "b"]
    assert [r["c"] for r in P.first_rows(rows, [F.desc("c")], 2).collect()] == ["b", "a"]


def test_first_per_group_prefers_trusted_rows(frame):
    rows = frame([("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 5, False), ("y", 4, False)], "g string, k int, gold boolean")
    first = P.first_per_group(rows, "g", [F.desc("gold"), F.asc("k")])
    assert sorted((r["g"], r["k"]) for r in first.collect()) == [("x", 2), ("y", 4)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_suite_invariants(frame):
    good = [("see red", i, f"variant {i} made him see red", i == 1) for i in range(1, 6)]
    bad = [("on ice", 1, "kept on ice", True), ("on ice", 1, "put on ice", True), ("on ice", 2, "on ice now", False)]
    rows = frame(good + bad, "expression string, variant_id int, prefix string, gold boolean")
    found = {r["expression"]: r for r in P.suite_invariants(rows).collect()}
    assert found["see red"]["holds"]
    assert tuple(found["on ice"]) == ("on ice", 2, 2, 1, 1, False)
