"""The catalog's append order and the pixel frames' small cases."""

import pytest
from pyspark.sql import functions as F

from corrgrid.operators import catalog, frames, matching
from corrgrid.sources.snapshots import Catalog


def run_tables(spark, run):
    return spark.createDataFrame([(run, "success")], "run_id long, status string"), spark.createDataFrame([(run, 0.5)], "run_id long, rmse double"), spark.createDataFrame([(run, 0), (run, 1)], "run_id long, idx long")


def test_log_run_appends(spark, tmp_path):
    root = str(tmp_path)
    assert [catalog.log_run(*run_tables(spark, i), root) for i in (1, 2)] == [1, 2]
    c = Catalog(spark, root)
    assert [c.read(t).count() for t in ("runs", "metrics", "matches")] == [2, 2, 4] and c.read("matches", 1).count() == 2
    assert c.versions() == [1, 2] and Catalog(spark, str(tmp_path / "none")).versions() == []


def test_a_failed_write_leaves_no_run(spark, tmp_path):
    root = str(tmp_path)
    catalog.log_run(*run_tables(spark, 1), root)
    runs, metrics, found = run_tables(spark, 2)
    with pytest.raises(Exception, match="lost"):
        catalog.log_run(runs, metrics, found.withColumn("idx", F.raise_error(F.lit("lost")).cast("long")), root)
    c = Catalog(spark, root)
    assert [c.read(t).count() for t in ("runs", "metrics", "matches")] == [1, 1, 2]
    open(tmp_path / "manifests" / f"{2:012d}.json", "w").close()  # a manifest that its writer never finished
    assert c.versions() == [1] and catalog.log_run(runs, metrics, found, root) == 3 and c.read("runs").count() == 2


def test_a_retry_commits_once(spark, tmp_path):
    root = str(tmp_path)
    assert [catalog.log_run(*run_tables(spark, 1), root, token="job-1") for _ in range(2)] == [1, 1]
    assert catalog.log_run(*run_tables(spark, 2), root, token="job-2") == 2 and Catalog(spark, root).read("runs").count() == 2


def test_commits_at_one_time_both_stay(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: catalog.log_run(*run_tables(spark, i), root), range(4)))
    c = Catalog(spark, root)
    assert sorted(versions) == [1, 2, 3, 4] and sorted(r.run_id for r in c.read("runs").collect()) == [0, 1, 2, 3]


def test_upserts_replace_a_table_and_retry_on_conflict(spark, tmp_path):
    root = str(tmp_path)
    c = Catalog(spark, root)
    images = lambda rows: spark.createDataFrame(rows, "path string, at long, gsd double")
    c.append({"images": images([("a", 1, 1.0), ("b", 1, 2.0)])})
    other = Catalog(spark, root)
    tried = []

    def change(old):
        if not tried:  # another writer commits in between
            other.append({"images": images([("c", 1, 9.0)])})
        tried.append(1)
        return catalog.merge(old, images([("b", 2, 5.0), ("d", 2, 6.0)]), "path", "at")

    assert c.replace("images", change) == 3 and len(tried) == 2
    assert sorted(map(tuple, c.read("images").collect())) == [("a", 1, 1.0), ("b", 2, 5.0), ("c", 1, 9.0), ("d", 2, 6.0)]
    assert c.read("images", 1).count() == 2
    c.append({"images": images([("e", 3, 7.0)])})
    assert c.read("images").count() == 5


def test_ties_do_not_depend_on_the_plan(spark):
    rows = spark.createDataFrame([("k", "upload", 2), ("k", "upload", 1), ("k", "sample", 0)], "key string, origin string, x long")
    assert {catalog.fetch(rows.repartition(n), "key").first().x for n in (1, 2, 3)} == {1}
    old = spark.createDataFrame([("k", 1, 5), ("k", 1, 7)], "key string, at long, x long")
    assert {catalog.merge(old.repartition(n), old.limit(0), "key", "at").first().x for n in (1, 2, 3)} == {7}


def test_scale_matrix_goes_back():
    for v in (0.0, 3.5, 100.0):
        assert frames.unscale(frames.rescale(v, 0.25), 0.25) == pytest.approx(v)


def test_tiles_cover_and_repeat_overlaps(spark):
    m = spark.createDataFrame([(1, 10.0, 10.0, 12.0, 11.0), (2, 230.0, 10.0, 231.0, 10.0), (3, 10.0, 10.0, 900.0, 10.0), (4, -1.0, 0.0, 0.0, 0.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.id, r.ty, r.tx) for r in matching.tile_union(m, 1000, 256, 32).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 0, 1)]


def test_uploads_come_before_samples(spark):
    up, sample = spark.createDataFrame([(1, "a")], "pair long, path string"), spark.createDataFrame([(1, "b", 3), (2, "c", 4)], "pair long, path string, size long")
    got = sorted(tuple(r) for r in catalog.fetch(catalog.list_datasets(up, sample), "pair").select("pair", "path", F.col("size")).collect())
    assert got == [(1, "a", None), (2, "c", 4)]
