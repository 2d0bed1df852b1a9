"""Listings folded on from a stored state, against a replay batch by batch."""

import datetime as dt
import random

import pytest

from pricelens.operators import listings, used

DAY = dt.date(2026, 7, 1)
SCHEMA = "used_search_id long, batch date, listing_id long, price long, event_id long, alerting boolean"


def observations(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for s in range(3):
        for b in sorted(rng.sample(range(14), 9)):
            for x in range(8):
                if rng.random() < 0.55:
                    for _ in range(rng.choice([1, 1, 2])):
                        n += 1
                        rows.append((s, DAY + dt.timedelta(days=b), x, rng.choice([100, 200, 300]), n, rng.random() < 0.4))
    return rows


def replay(rows):
    """The model's own loop: a search's batches in order against what is known."""
    known, events, through = {}, [], {}
    for s, b in sorted({r[:2] for r in rows}):
        now = {x: (p, a) for s2, b2, x, p, _, a in rows if (s2, b2) == (s, b)}
        mine = {x: k for (s2, x), k in known.items() if s2 == s}
        for x, (p, a) in now.items():
            k = mine.get(x)
            if k is None:
                known[s, x] = {"status": "ACTIVE", "price": p, "first": b, "last": b, "promoted": a}
                events.append((s, x, b, "NEW", p, None, a))
                continue
            if k["status"] == "SOLD":
                events.append((s, x, b, "REVIVED", p, None, k["promoted"]))
            elif k["price"] != p:
                events.append((s, x, b, "PRICE", p, k["price"], k["promoted"]))
            k.update(status="ACTIVE", price=p, last=b)
        for x, k in mine.items():
            if k["status"] == "ACTIVE" and x not in now:
                k["status"] = "SOLD"
                events.append((s, x, b, "SOLD", k["price"], k["price"], k["promoted"]))
        through[s] = b
    state = [(s, x, k["status"], k["price"], k["first"], k["last"], k["promoted"], through[s]) for (s, x), k in known.items()] + [(s, None, None, None, None, None, None, b) for s, b in through.items()]
    return state, events


@pytest.mark.parametrize("cuts", [[], [5], [0, 3, 7, 11]])
def test_folding_on_is_folding_at_once(spark, tmp_path, cuts):
    rows = observations(len(cuts))
    df = spark.createDataFrame(rows, SCHEMA)
    state, events = spark.createDataFrame([], listings.STATE), []
    for k, c in enumerate([*cuts, 99]):
        # all batches so far come again; those that are folded count no more
        so_far = df.filter(df.batch <= DAY + dt.timedelta(days=c))
        state, more = listings.fold_listings(so_far, state)
        events += map(tuple, more.collect())
        state.write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
    want_state, want_events = replay(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(events, key=key) == sorted(want_events, key=key) and {e[3] for e in events} == {"NEW", "REVIVED", "PRICE", "SOLD"}
    assert sorted(map(tuple, state.collect()), key=key) == sorted(want_state, key=key)
    alerts = used.promoted_alerts(spark.createDataFrame(events, "used_search_id long, listing_id long, batch date, event string, price long, was long, promoted boolean")).count()
    assert alerts == sum(p and (e == "SOLD" or e == "PRICE" and price < was) for _, _, _, e, price, was, p in want_events)
