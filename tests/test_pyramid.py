"""Summary trees against direct answers for random ranges."""

import math
import random

import pytest

from blkscope import testbed
from blkscope.functions.units import THRESHOLDS
from blkscope.operators import stats
from blkscope.operators.derive import derive
from blkscope.operators.filters import Range, apply_range
from blkscope.operators.pyramid import Pyramid, cells_of

DATA = "/root/testdata/sf0.001"


def test_cells_cover_steps_once_and_are_few():
    rnd = random.Random(1)
    for _ in range(300):
        low = rnd.randrange(-2000, 2000)
        high = low + rnd.randrange(0, 3000)
        cells = cells_of(low, high)
        covered = sorted(s for level, c in cells for s in range(c << level, (c + 1) << level))
        assert covered == list(range(low, high))
        assert all(sum(level == x for x, _ in cells) <= 2 for level, _ in cells)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder, out = str(tmp_path_factory.mktemp("pyramid")), {}
    for kind in ("block", "cus"):
        derive(getattr(testbed, kind)(spark, DATA), kind).write.parquet(f"{folder}/{kind}.parquet")
        df = spark.read.parquet(f"{folder}/{kind}.parquet")
        low, high = df.selectExpr(f"min({stats_time(kind)})", f"max({stats_time(kind)})").first()
        step = (high - low) / 50
        out[kind] = df, Pyramid(spark, folder, kind).build(df, step, THRESHOLDS), low, high, step
    return out


def stats_time(kind):
    return "start_time" if kind == "cus" else "time"


def same(got, want, near=()):
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    a, b = rows(got), rows(want)
    if not near:
        assert a == b
        return
    exact = [c for c in columns if c not in near]
    at = [columns.index(c) for c in exact]
    assert [[r[i] for i in at] for r in a] == [[r[i] for i in at] for r in b]
    for r, s in zip(a, b):
        for c in near:
            assert math.isclose(r[columns.index(c)], s[columns.index(c)], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["block", "cus"])
def test_random_ranges_equal_the_direct_query(spark, made, kind):
    df, tree, low, high, step = made[kind]
    rnd = random.Random(kind)
    for n in range(4):
        a, b = sorted((rnd.uniform(low, high), rnd.uniform(low, high)))
        if n == 0:
            a, b = math.floor(low / step) * step + 3 * step, math.floor(low / step) * step + 9 * step  # on ends of steps
        if n == 1:
            b = a + step / 3
        r = Range("", a, b)
        same(tree.histogram(df, "dtoc", r, group=n % 2 == 0), stats.latency_histogram(df, kind, "dtoc", THRESHOLDS, r, group=n % 2 == 0))
        if n >= 2:
            want = stats.latency_summary(df, kind, "ctod", r).select("trace", "key", "n", "sum", "min", "max", "avg")
            same(tree.moments(df, "ctod", r), want, near=("sum", "avg"))
            same(tree.continuity(df, r), stats.continuity_stats(df, kind, r))


def test_no_range_and_ranges_on_other_columns(spark, made):
    df, tree, *_ = made["block"]
    same(tree.histogram(df, "ctoc"), stats.latency_histogram(df, "block", "ctoc", THRESHOLDS))
    r = Range("sector", 0.0, 3.0, 1, 4)
    same(tree.histogram(df, "dtoc", r), stats.latency_histogram(df, "block", "dtoc", THRESHOLDS, r))


def test_rows_read_are_those_of_two_steps(spark, made):
    df, tree, low, high, step = made["block"]
    r = Range("", low + 5.3 * step, high - 4.2 * step)
    inside = apply_range(df, "block", r).count()
    edges = tree.edges(df, r).count()
    assert 0 < edges <= inside / 10
    assert "PushedFilters: [Or(" in tree.edges(df, r)._jdf.queryExecution().toString() or "time" in str(tree.edges(df, r)._jdf.queryExecution().executedPlan())


def test_a_tree_is_found_again(spark, made):
    df, tree, low, high, step = made["cus"]
    again = Pyramid(spark, tree.folder, "cus")
    r = Range("", low, high)
    same(again.histogram(df, "dtoc", r), tree.histogram(df, "dtoc", r))
