"""Boosters that one task carries through all rounds: the same trees as where tasks share the rows, in as many jobs whatever the rounds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_boosting import INPUTS, booster, rows

from panelforge.operators import boosting
from panelforge.session import cut_lineage


@pytest.fixture(scope="module")
def chunks(spark):
    """Several chunks to a part, one of them with leaves of more rows than ``POINTS``; some rows without entity or naive value."""
    df = cut_lineage(rows(spark, 2400).repartitionByRange(3, "target", "y"))
    cuts = boosting.quantile_cuts(df.filter("stamp = 0"), INPUTS, "part")
    naive = F.when(F.col("y") > 0.1, F.col("naive") + F.col("y") * 20 - 10).alias("naive")
    entity = F.when(F.col("entity") != "e3", F.col("entity")).alias("entity")
    odd = df.select("part", "stamp", "target", "x", "y", naive, entity)
    return boosting.chunked_rows(odd, INPUTS, cuts, "part", F.col("stamp"), "target", "naive", "entity")


def boosters():
    return [
        booster(leaves=13, depth=5, step=0.1),
        booster(part="two", step=0.3, patience=4, features_share=0.5, rows_share=1.0, alpha=2.5, lam=3.0),
        booster(leaves=1, depth=1, rows_share=0.6),
        booster(leaves=31, depth=9, min_rows=1, step=0.2, seed=5),
        boosting.Booster("two", -1, 1, 1),  # nothing to train on
        boosting.Booster("one", 0, 7, 8, min_rows=5),  # nothing to validate with
    ]


def grown(chunks, monkeypatch, held, rounds):
    with monkeypatch.context() as m:
        if not held:
            m.setattr(boosting, "HELD_BYTES", -1)
        out = boosters()
        for upto in rounds:
            boosting.boost(chunks, out, len(INPUTS), upto)
        return out, boosting.judged_wmape(chunks, out)


def test_one_task_grows_the_trees_that_many_grow(chunks, monkeypatch):
    assert chunks.groupBy("part").count().filter("count > 1").count() == 2
    shared, shared_judged = grown(chunks, monkeypatch, False, [5, 12])
    for rounds in ([12], [3, 12]):
        held, judged = grown(chunks, monkeypatch, True, rounds)
        for one, other in zip(held, shared):
            assert [t.plain() for t in one.trees] == [t.plain() for t in other.trees]
            assert one.start == other.start and one.stopped == other.stopped and one.errors == pytest.approx(other.errors)
        assert held[1].stopped and len(held[1].trees) < 12 and len(held[0].trees) == 12
        assert sorted(judged) == sorted(shared_judged) == [0, 1, 2, 3, 4]
        for i, found in judged.items():
            assert found == pytest.approx(shared_judged[i])


def test_jobs_do_not_grow_with_the_rounds(spark, chunks):
    context, found = spark.sparkContext, {}
    for rounds in (2, 9):
        context.setJobGroup(f"rounds {rounds}", "")
        boosting.boost(chunks, [booster(), booster(seed=7)], len(INPUTS), rounds)
        found[rounds] = len(context.statusTracker().getJobIdsForGroup(f"rounds {rounds}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < found[2] == found[9] < 8


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_medians_of_all_nodes_at_once(data):
    many = data.draw(st.integers(1, 700))
    draw = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    chunks, nodes = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 4))
    values = np.round(draw.normal(0, 3, many), data.draw(st.integers(0, 6)))
    at, chunk = draw.integers(0, nodes, many), np.sort(draw.integers(0, chunks, many))
    held = object.__new__(boosting._HeldRows)
    held.sizes, held.chunk, held.train = [0] * chunks, chunk, np.arange(many)
    got = held.medians(at, values, nodes)
    for node in range(nodes):
        pieces = [boosting.summary(values[(at == node) & (chunk == c)]) for c in range(chunks)]
        points = np.concatenate([p for p, _ in pieces])
        weights = np.concatenate([np.full(len(p), w) for p, w in pieces])
        assert got[node] == (boosting.weighted_median(points, weights) if len(points) else 0.0)
