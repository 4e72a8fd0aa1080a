import random

from rolecall.llm import components as co
from rolecall.operators import joins


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in list(root)}


def test_stars_chains_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(co, "HOT_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    draw = random.Random(1)
    links = [(5000, i) for i in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(900 - i, 901 - i) for i in range(30)]
    links += [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (3, 2), (2, 3)]
    draw.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.node: r.component for r in co.components(frame).collect()} == brute(links)
    assert co.components(frame.limit(0)).count() == 0
