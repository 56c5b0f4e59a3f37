import random

import pytest

from ledgerloom.llm import components as G
from ledgerloom.llm import near_dup


def plain(links):
    of = {x: x for link in links for x in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and of[a] != of[b]:
                of[a] = of[b] = min(of[a], of[b])
                changed = True
    return of


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(G, "TASK_LINKS", most)
    rng = random.Random(2)
    links = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (999, 999)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == plain(links)
    assert G.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_take_no_rounds(spark, monkeypatch):
    """A round writes four tables, which many small shuffles make dear; few links are written once."""
    calls = []
    monkeypatch.setattr(G, "written", lambda df, w=G.written: calls.append(1) or w(df))
    assert G.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")).count() == 5
    assert len(calls) == 1


def test_components_known_before_stand_for_their_links(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = near_dup._joined(None, frame([(1, 2), (2, 3), (5, 6)]))
    assert near_dup._joined(known, frame([])) is known
    assert {r.node: r.component for r in near_dup._joined(known, frame([(3, 6), (8, 9)])).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 8: 8, 9: 8}
