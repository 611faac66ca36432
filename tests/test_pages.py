"""Deep pages and quantile sketches."""

import bisect

from pyspark.sql import functions as F

from parley.operators import quantiles
from parley.operators.pages import Pages


def test_any_page_reads_only_its_ranges(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    stored = Pages.create(rows, str(tmp_path / "p"), [F.desc("v"), F.col("id")], 100)
    want = sorted(((i, i * 7919 % 1000) for i in range(1000)), key=lambda r: (-r[1], r[0]))
    for number, size in ((1, 30), (17, 30), (34, 30), (35, 30), (3, 400), (5, 1)):
        page = stored.page(number, size)
        got = [(r.id, r.v, r.place, r.has_more) for r in page.collect()]
        first = (number - 1) * size
        assert got == [(*r, first + i, 1000 > number * size) for i, r in enumerate(want[first : first + size])]
        files = {r[0] for r in page.select(F.input_file_name()).collect()}
        assert len(stored.ranges(first, first + size)) <= size // 80 + 2 and len(page.inputFiles()) <= 12 and len(files) <= size // 80 + 2
    assert Pages.create(rows.limit(0), str(tmp_path / "q"), [F.col("id")]).page(1, 10).count() == 0


def test_ranks_of_merged_sketches(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("day"), (F.xxhash64("id") % 100_000 * F.rand(1)).alias("value")).cache()
    shares = (0.01, 0.25, 0.5, 0.9, 0.99)
    found = quantiles.quantiles(quantiles.merged(quantiles.sketched(rows, ["g", "day"], "value"), ["g"]), shares).collect()
    values = {g: sorted(r.value for r in rows.where(F.col("g") == g).select("value").collect()) for g in (0, 1)}
    for r in found:
        assert r.n == len(values[r.g]) == 100_000
        for share, name in zip(shares, ("p1", "p25", "p50", "p90", "p99"), strict=True):
            assert abs(bisect.bisect(values[r.g], r[name]) / r.n - share) < 0.012
    exact = {r.g: r.p50 for r in quantiles.exact(rows, ["g"], "value", (0.5,)).collect()}
    assert all(abs(r.p50 - exact[r.g]) < 0.02 * (values[r.g][-1] - values[r.g][0]) for r in found)
    odd = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "g string, value double")
    assert [tuple(r) for r in quantiles.quantiles(quantiles.sketched(odd, ["g"], "value"), (0.5,)).collect()] == [("b", 1, 1.0)]
