"""Queries against their SQL on small tables that hold what sf0.001 lacks."""

import os

import numpy as np
import pandas as pd
import pytest

from stratalog import change_queries, queries  # noqa: F401
from stratalog.operators import collisions, similarity
from stratalog.plans import executor
from stratalog.scratch import save
from tests.oracle import differences


def _same(spark, name: str, sf_dir) -> None:
    assert not differences(spark, queries.queries()[name], queries.oracle_sql()[name], str(sf_dir))


def _pages(spark, at, urls: list[str]) -> None:
    rows = [(i, u, "") for i, u in enumerate(urls, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(os.path.join(at, "pages.parquet"))


_URLS = ["http://a.x/en/1.html", "https://b.x/en/1.html?p=2", "http://a.x/en/1", "http://c.x/en/1.html/", "http://c.x/de/1.html", "http://c.x/en/1", "http://d.x/en/1.html", "http://d.x/en/2.tar.gz#top", "http://e.x/en/2.tar.gz#top"]


def test_backups_of_addresses_that_end_alike(spark, tmp_path):
    _pages(spark, tmp_path, _URLS)
    _same(spark, "backup_plan", tmp_path)


@pytest.mark.parametrize("hot", [2, 100])
def test_numbers_at_the_end_of_whole_names(spark, hot):
    targets = ["/o/a.html", "/O/A.html", "/o/a.html (1)", "/o/a.html", "/o/a (1).html", "/o/a.html"]
    disk = spark.createDataFrame([("/o/a.html (3)",)], "path string")
    out = collisions.resolve(spark.createDataFrame(list(enumerate(targets)), "ordinal long, target string"), disk, hot=hot, suffixed=False)
    found = {r.ordinal: r.new_path for r in out.collect()}
    assert found == {0: "/o/a.html", 1: "/O/A.html (1)", 2: "/o/a.html (1) (1)", 3: "/o/a.html (2)", 4: "/o/a (1).html", 5: "/o/a.html (4)"}


def test_moves_of_addresses_that_end_alike(spark, tmp_path):
    _pages(spark, tmp_path, _URLS)
    _same(spark, "move_plan", tmp_path)


def test_a_family_beyond_what_sf01_has(spark, tmp_path):
    """The 600,007th of those that want a number is the first for which disk had no number left."""
    for name, columns in {"lineitem": ("id AS l_orderkey", "1 AS l_linenumber"), "orders": ("id * 100003 AS o_orderkey",), "events": ("id AS event_id",)}.items():
        spark.range(600_100 if name == "lineitem" else 9).selectExpr(*columns).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    _same(spark, "collision_family", tmp_path)


def test_archives_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A table of one file, whose rows are few bytes but an archive each."""
    dealt = []
    monkeypatch.setattr(change_queries, "_ARCHIVES", 40)
    monkeypatch.setattr(executor, "carry_out", lambda *a, f=executor.carry_out, **b: dealt.append(out := f(*a, **b)) or out)
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(150).toPandas().to_parquet(tmp_path / "part.parquet")
    _same(spark, "archives_rewritten", tmp_path)
    assert [d.rdd.getNumPartitions() for d in dealt] == [4]


def _broadcast(df) -> list[str]:
    """The parts of df's plan that the driver would collect."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if deep(lines[j]) <= deep(line)), len(lines))
            found.append("\n".join(lines[k:end]))
    return found


def _near(spark):
    """Signatures of which many are near or equal, as a table."""
    return save(spark.range(300).selectExpr("id AS ordinal", "array(shiftleft(id % 50, 20) + IF(id % 3 = 0, shiftleft(1L, CAST(id % 60 AS INT)), 0L)) AS words"))


def test_pairs_are_not_collected_in_the_driver(spark):
    """A small table, but exploded to 68 rows a signature: its size tells Spark to broadcast them."""
    found = similarity.near_pairs(_near(spark), 7, 64)
    assert not _broadcast(found)
    assert found.count() > 300


def _saving(plans: list):
    """save(), which notes the part of each plan that the driver would collect."""

    def run(df, name="table"):
        plans.append(_broadcast(df))
        return save(df, name)

    return run


def test_clusters_are_not_collected_in_the_driver(spark):
    plans = []
    found = similarity.leaders(_near(spark), 7, 64, _saving(plans))
    assert len(plans) > 3 and not any(plans) and not _broadcast(found)
    assert found.count() == 300


def test_sweeps_end_when_they_take_few(spark, monkeypatch):
    """A third of the signatures share a band's value, none is near another: a sweep takes one of those."""
    own = "shiftleft(xxhash64(id), 16) | IF(id % 3 = 0, 7, id)"
    files, few, all_ = save(spark.range(300).selectExpr("id AS ordinal", f"array({own}) AS words")), [], []
    assert similarity.leaders(files, 7, 64, _saving(few), hot=50, sweeps=5).filter("head <> ordinal or head_distance <> 0").count() == 0
    monkeypatch.setattr(similarity, "WORTH", 0, raising=False)
    similarity.leaders(files, 7, 64, _saving(all_), hot=50, sweeps=5)
    assert len(few) < len(all_)


def test_divided_bands_are_not_collected_in_the_driver(spark):
    """Only the values that many share may be broadcast, not what is exploded."""
    plans = []
    found = similarity.leaders(_near(spark), 7, 64, _saving(plans), hot=40, sweeps=1)
    assert found.count() == 300
    assert not [x for own in plans for x in own if "Generate" in x]


def _vectors(at) -> None:
    """Vectors of signs, each ten times."""
    signs = np.random.default_rng(1).choice([-1.0, 1.0], (40, 64)).astype("f4")
    pd.DataFrame({"vec_id": range(400), "embedding": [list(signs[i % 40]) for i in range(400)]}).to_parquet(at / "embeddings.parquet")


def test_similarity_groups_collects_no_vectors_in_the_driver(spark, tmp_path, monkeypatch):
    """Vectors of few values are a few bytes each in a file."""
    _vectors(tmp_path)
    plans = []
    monkeypatch.setattr(queries, "save", _saving(plans))
    found = queries.similarity_groups(spark, str(tmp_path))
    assert len(plans) > 3 and not any(plans) and not _broadcast(found)
    _same(spark, "similarity_groups", tmp_path)


def test_similar_groups_collects_nothing_that_grows_in_the_driver(spark, tmp_path, monkeypatch):
    """Neither vectors nor, beyond a limit, the values that many signatures share."""
    _vectors(tmp_path)
    plans = []
    monkeypatch.setattr(change_queries, "save", _saving(plans))
    monkeypatch.setattr(similarity, "KEYS", 1, raising=False)
    monkeypatch.setattr(similarity.leaders, "__defaults__", (4, 0))
    found = change_queries.similar_groups(spark, str(tmp_path))
    assert len(plans) > 10 and not any(plans) and not _broadcast(found)
    _same(spark, "similar_groups", tmp_path)
