import random

import pytest

from cascata.operators import dynamic, seeding, sketches
from cascata.runtime import cut
from cascata.streaming import changelog

from .test_changelog import SCHEMA, random_log

DEN = 100


@pytest.mark.parametrize("model", ["ic", "lt"])
def test_sketches_follow_a_log(spark, model):
    """After every part of the log the sketches and seeds are those that are drawn from scratch."""
    rng = random.Random(4)
    edges = spark.createDataFrame([(a, b, rng.randrange(1, 60) / DEN) for a in range(6) for b in range(6) if a != b], "src long, dst long, weight double")
    nodes = spark.range(6)
    followed = dynamic.FollowedSketches(edges, nodes, DEN, 40, model=model)
    redrawn = []
    for part in range(2):
        log = random_log(rng, 40 if part else 3)
        before = followed.now
        edges, nodes = changelog.apply_log(edges, nodes, spark.createDataFrame(log, SCHEMA))
        edges, nodes = cut(edges), cut(nodes)
        stale = dynamic.stale_sketches(followed.rr, before, (followed._scaled(edges), nodes), 40).count()
        redrawn.append(stale)
        followed.on_change(part, edges, nodes)
        fresh = sketches.rr_sets(followed._scaled(edges), nodes, DEN, 40, model).select("rr_id", "node")
        assert sorted(map(tuple, followed.rr.collect())) == sorted(map(tuple, fresh.collect()))
        assert followed.seeds(2) == seeding.greedy_cover(fresh, 2)
    assert min(redrawn) < 40


def test_work_sets_the_number_of_sketches(spark):
    edges = spark.createDataFrame([(a, (a + 1) % 8, 50) for a in range(8)], "src long, dst long, c long")
    few, n = dynamic.sketches_for_work(edges, spark.range(8), DEN, 4.0, first=16)
    many, m = dynamic.sketches_for_work(edges, spark.range(8), DEN, 8.0, first=16)
    assert n < m and 2 * few.count() >= 4 * 16 * 3 and 2 * many.count() >= 8 * 16 * 3
    assert dynamic.sketches_for_work(edges.limit(0), spark.range(0), DEN)[1] == 0
