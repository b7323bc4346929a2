"""Month roll-up, period calendar, publication, sanitising and slugs against small brute-force versions."""
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillpoint.plans import period, publish, rollup
from tillpoint.plans.cube import keyed, period_store_cube, sanitize
from tillpoint.plans.curate import load_sales, regular
from tillpoint.plans.slugs import brand_slugs


@pytest.fixture(scope="module")
def facts(spark):
    return regular(load_sales(spark, SF))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rollup_by_parts_equals_one_build(spark, facts, monkeypatch):
    """Months added in turns, one of them replaced, dense and sparse sets: all counts as from the facts."""
    monkeypatch.setattr(rollup, "SPARSE", 3)
    up = rollup.merged(rollup.empty_rollup(spark), facts.where("ym < 199606"))
    up = rollup.merged(up, facts.where("ym >= 199606 and ym < 199900"))
    up = rollup.merged(up, facts.where("ym >= 199900 or ym = 199512"))
    assert up.distinct.where("bits is not null").count() and up.distinct.where("few is not null").count()
    assert up.ids.count() == up.ids.select("kind", "id").distinct().count() == up.ids.select("code").distinct().count()
    assert rows(rollup.cube_from_rollup(up)) == rows(period_store_cube(facts))


def test_rollup_reads_facts_once(spark, facts):
    """The cube's plan has no Expand, and reads stored months only."""
    plan = rollup.cube_from_rollup(rollup.load_rollup(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "actual_revenue" not in plan


def test_sketches_within_their_error(spark, facts):
    up = rollup.load_rollup(spark, SF)
    exact = {(r.store, k): r[k] for r in rollup.range_by_store(up, 199301, 199912).collect() for k in rollup.KINDS}
    for r in rollup.range_sketched(up, 199301, 199912).collect():
        assert abs(r.estimate - exact[r.store, r.kind]) <= max(1, exact[r.store, r.kind] * rollup.SKETCH_ERROR)


def test_calendar_and_interval_join(spark, facts):
    cal = {(r.grain, r.period): r for r in period.period_calendar(facts).collect()}
    q = cal["quarter", "1996-Q1"]
    assert (str(q.start), str(q.end), str(q.prev_start), str(q.prev_end)) == ("1996-01-01", "1996-03-31", "1995-10-01", "1995-12-31")
    assert str(cal["year", "1996"].prev_end) == "1995-12-31" and str(cal["month", "1996-03"].prev_end) == "1996-02-29"
    days = facts.select("sale_date")
    joined = period.in_periods(days, period.period_calendar(facts))
    n = {(r.grain, r.period, r.side): r["count"] for r in joined.groupBy("grain", "period", "side").count().collect()}
    have = [r.sale_date for r in days.collect()]
    for (grain, name), c in cal.items():
        assert n.get((grain, name, "current"), 0) == sum(c.start <= d <= c.end for d in have)
        assert n.get((grain, name, "previous"), 0) == sum(c.prev_start <= d <= c.prev_end for d in have)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_publication_is_seen_whole(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    view = spark.createDataFrame([("2025-01", "a", 1.5, None), ("all", None, float("nan"), [1, 2])], "period string, store string, x double, l array<int>")
    publish.publish({"v": view, "w": view.select("period", "store")}, root)
    assert rows(publish.read_view(spark, root, "v")) == rows(spark.createDataFrame([("2025-01", "a", 1.5, None), ("all", None, 0.0, [1, 2])], view.schema))
    assert publish.read_view(spark, root, "w", "all").count() == 1
    with monkeypatch.context() as m:  # ends before its manifest is there
        m.setattr(publish, "create_file", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            publish.publish({"v": view.limit(0)}, root)
    assert publish.read_view(spark, root, "v").count() == 2
    publish.publish({"v": view.limit(1)}, root)
    assert publish.read_view(spark, root, "v").count() == 1 and publish.published(spark, root)["version"] == 1
    with pytest.raises(FileExistsError):
        publish.create_file(spark, f"{root}/manifest/{1:010d}.json", "{}")


def test_sanitize_at_any_depth(spark):
    schema = "a double, b array<struct<x:float,y:string>>, c map<string,array<double>>, d map<double,int>, e struct<f:struct<g:double>>, n int"
    nan, inf = float("nan"), float("inf")
    data = [(nan, [(inf, "s"), None, (1.0, None)], {"k": [nan, 2.0, None], "z": None}, {1.0: 1, inf: 2, nan: 3}, ((-inf,),), 4), (None, None, None, None, None, None)]
    got = sanitize(spark.createDataFrame(data, schema)).collect()
    assert [x.asDict(True) for x in got] == [
        {"a": 0.0, "b": [{"x": 0.0, "y": "s"}, None, {"x": 1.0, "y": None}], "c": {"k": [0.0, 2.0, None], "z": None}, "d": {1.0: 1}, "e": {"f": {"g": 0.0}}, "n": 4},
        {"a": None, "b": None, "c": None, "d": None, "e": None, "n": None}]
    pairs = spark.createDataFrame([([("k", 1), (None, 2)],)], "p array<struct<key:string,value:int>>")
    assert pairs.select(keyed("p").alias("m")).first().m == {"k": 1}


def brute_slugs(brands):
    used, out = set(), []
    for name, _ in sorted(brands, key=lambda b: (-b[1], b[0])):
        s = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", name.lower().strip())).strip("-") or "unknown"
        if s in used:
            i = 2
            while f"{s}-{i}" in used:
                i += 1
            s = f"{s}-{i}"
        used.add(s)
        out.append((name, s))
    return sorted(out, key=repr)


def test_slugs_as_chosen_in_turn(spark):
    rng = random.Random(4)
    forms = ["Acme", "ACME!", "acme?", "Acme 2", "acme-2", "acme_3", "Acme 2 2", "Acme 2-2!", " acme 3", "!!!", "???", "", "Zed", "zed 2", "Zed  2", "Zed 2 2", "zed!", "zed!!"]
    for _ in range(4):
        brands = [(f, rng.randrange(6)) for f in forms]
        assert rows(brand_slugs(spark.createDataFrame(brands, "name string, revenue int"))) == brute_slugs(brands)
    accented = spark.createDataFrame([("Café Noir", 2), ("cafe noir", 1)], "name string, revenue int")
    assert rows(brand_slugs(accented)) == [("Café Noir", "cafe-noir"), ("cafe noir", "cafe-noir-2")]
    assert brand_slugs(accented.limit(0)).count() == 0


def test_median_by_selection(spark):
    from statistics import median

    from tillpoint.plans.prefix import median_of, value_at

    rng = random.Random(6)
    for values in ([5], [5, 5], [1, 2], [-3, 10**12, 7, 7], [rng.randrange(-10**9, 10**9) for _ in range(501)], [rng.randrange(3) for _ in range(400)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
        assert median_of(df, "v") == median(values)
        assert value_at(df, "v", len(values), min(values), max(values)) == max(values) and value_at(df, "v", 1, min(values), max(values)) == min(values)
    assert median_of(spark.createDataFrame([(None,)], "v bigint"), "v") is None
