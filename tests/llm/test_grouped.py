"""Connected components over tables."""

from __future__ import annotations

import random

import pytest

from ledgerline.llm import grouped


def roots_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


CHAIN = [(i, i + 1) for i in range(30)]
RANDOM = [tuple(random.Random(i).choices(range(200), k=2)) for i in range(170)]
STARS = [(node, node % 5) for node in range(40)]


@pytest.mark.parametrize("edges", [CHAIN, RANDOM, RANDOM * 2 + STARS, [(7, 7)], []])
def test_components(spark, edges):
    found = grouped.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(roots_of(edges).items())


def test_no_round_where_all_hang_on_their_roots(spark, monkeypatch):
    written, durable = [], grouped.durable
    monkeypatch.setattr(grouped, "durable", lambda df, label: written.append(label) or durable(df, label))
    found = grouped.components(spark.createDataFrame(STARS, "a long, b long"))
    assert dict(map(tuple, found.collect())) == roots_of(STARS)
    assert written == ["edges"]
