"""The stored vector index against the exact search."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import vectors
from reelgrid.operators.vector_index import VectorIndex, recall
from reelgrid.sources.shared import fresh

ITEMS = "item_id long, vector array<float>"


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "item_id", "score", "lane_rank").collect()))


@pytest.fixture(scope="module")
def items(spark):
    """2,000 vectors round 40 centres, copies of one of them, and rows that take no part."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 16))
    rows = [(i, [float(x) for x in (centres[i % 40] + 0.3 * g.normal(size=16)).astype(np.float32)]) for i in range(2000)]
    rows += [(3000 + i, rows[7][1]) for i in range(30)]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [None] * 16)]
    return spark.createDataFrame(rows, ITEMS).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(items):
    return items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


@pytest.fixture(scope="module")
def sound(items):
    return items.filter("item_id < 4000")


@pytest.fixture(scope="module")
def index(spark, items):
    name = f"v_{uuid.uuid4().hex}"
    found = VectorIndex.create(items.filter("item_id % 3 <> 0"), fresh(spark, name), name, lists=40, pieces=3)
    found.add(items.filter("item_id % 3 = 0"))
    return found


def test_all_lists_are_exact(index, asked, sound):
    assert rows_of(index.search(asked, 20, 1000)) == rows_of(vectors.nearest(asked.filter("query_id < 4000"), sound, 20))


def test_few_lists_find_most(index, asked, sound):
    exact = vectors.nearest(asked.filter("query_id < 4000"), sound, 20)
    probes = index.probes_for(asked, exact, 0.95)
    found = recall(index.search(asked, 20, probes), exact).agg(F.avg("recall")).first()[0]
    scored = index.visited(asked, probes).agg(F.avg("n_scored")).first()[0]
    assert found >= 0.95
    assert scored < 0.3 * sound.count()
    assert probes == 1 or recall(index.search(asked, 20, probes - 1), exact).agg(F.avg("recall")).first()[0] < 0.95


def test_lists_are_not_shuffled(spark, index, asked):
    plan = index.search(asked, 20, 4)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet spark_catalog") :].split("\n")[0]
    assert "Bucketed: true" in scan
    assert plan.count("Exchange hashpartitioning(list") == 1  # of the queries


def test_index_is_found_in_its_folder(spark, index, asked):
    before = rows_of(index.search(asked, 5, 4))
    again = VectorIndex(spark, index.path, f"again_{uuid.uuid4().hex}")
    assert rows_of(again.search(asked, 5, 4)) == before
    again.add(spark.createDataFrame([(9000, asked.first()["vector"])], ITEMS))
    assert again.table().count() == index.table().count() + 1 or again.table().filter("item_id = 9000").count() == 1


def test_index_of_nothing(spark, asked):
    name = f"v_{uuid.uuid4().hex}"
    index = VectorIndex.create(spark.createDataFrame([], ITEMS), fresh(spark, name), name)
    assert index.search(asked, 5).count() == 0
    index.drop()


def test_all_lists_are_scored_in_blocks(index, asked):
    """No row for each pair of a query and a vector, and no query for each list."""
    plan = index.search(asked, 20, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" in plan
    assert "hashpartitioning(list" not in plan
