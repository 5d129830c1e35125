"""What the driver keeps of a query grows with its jobs and the size of its plans, so iterative steps must be few and small ones."""

import random

import numpy as np

from gridloom.llm import components, toxicity
from gridloom.llm._base import materialize, with_least


def plan_sizes(spark, run) -> list[int]:
    """Metrics that the driver keeps of each execution of run(): those of all nodes, anew for each change of its plan."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def kept():
        bus.waitUntilEmpty(30_000)
        every = store.executionsList()
        every = [every.apply(k) for k in range(every.size())]
        return {x.executionId(): x.metrics().size() for x in every}

    before = kept()
    run()
    return [n for k, n in kept().items() if k not in before]


def test_rounds_of_components_leave_little_at_the_driver(spark):
    rng = random.Random(3)
    edges = materialize(spark.createDataFrame([(k, rng.randint(max(0, k - 9), k - 1)) for k in range(1, 400)], "a long, b long"), "test-edges")
    got = []
    sizes = plan_sizes(spark, lambda: got.extend(components.connected_components(edges).collect()))
    assert len(got) == 400 and {r["component"] for r in got} == {0}
    assert max(sizes) < 2000 and sum(sizes) < 30_000, (max(sizes), sum(sizes))


def test_a_pass_of_the_fit_is_one_job(spark):
    rows = spark.range(0, 90, 1, 9).selectExpr(f"array_repeat(double(id), {toxicity.EVIDENCE}) AS e", "int(id % 2) AS toxic")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = toxicity._sums(rows, lambda x, y: np.array([len(y), y.sum(), x.sum()]), (3,))
    assert jobs() - before == 1
    assert got.tolist() == [90, 45, toxicity.EVIDENCE * 89 * 45]


def test_least_of_keys_with_many_rows_and_of_none(spark):
    kind = "k long, v long"
    few = [(k % 7, k) for k in range(70)] + [(None, -1)]
    many = [*few, *((7, 1000 - k) for k in range(400)), *((None, -k) for k in range(400))]
    for data in (few, many, []):
        used = []
        got = sorted(tuple(r) for r in with_least(spark.createDataFrame(data, kind), "k", "v", len(data), used).select("k", "v", "m").collect())
        least = {k: min(v for x, v in data if x == k) for k, _ in data if k is not None}
        assert got == sorted((k, v, least[k]) for k, v in data if k is not None) and len(used) == 1
