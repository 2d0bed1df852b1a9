"""Aliases within titles, by the automaton and by joins, against plain search."""

import random

import pytest

from pricelens.operators import titles


@pytest.mark.parametrize("most", [500_000, 3])
def test_aliases_within_titles(spark, monkeypatch, most):
    monkeypatch.setattr(titles, "MOST_ALIASES", most)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab가나\U0001f600") for _ in range(n))
    keys = [(word(rng.choice([1, 2, 3, 5, 9, 17, 40])), rng.randint(1, 9)) for _ in range(30)] + [("a", 5), ("ab", 5), ("ab", 6)]
    posts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(900, None), (901, ""), (3, "ab")]
    posts += [(1000 + i, word(3) + k + word(2)) for i, (k, _) in enumerate(keys)]
    want = {}
    for i, t in posts:
        for k, p in keys:
            if t and k in t:
                want.setdefault(i, set()).add(p)
    df = spark.createDataFrame(posts, "post_id long, j string").repartition(3)
    got = {r.post_id: (r.n, r.product_id) for r in titles.alias_hits(df, spark.createDataFrame(keys, "key string, product_id long")).collect()}
    assert got == {i: (len(ps), min(ps)) for i, ps in want.items()}
    assert titles.alias_hits(df, spark.createDataFrame([], "key string, product_id long")).collect() == []
    text = {r.post_id: r.product_id for r in titles.alias_hits(df, spark.createDataFrame([(k, f"p{p}") for k, p in keys], "key string, product_id string")).collect()}
    assert text == {i: f"p{min(ps)}" for i, ps in want.items()}
