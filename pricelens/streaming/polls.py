"""The poll log as a stream: each site's cursor as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pricelens.operators.polls import LEAST_RATE, STREAK, WINDOW

CURSOR = "site string, last_ok timestamp, failures long, stopped boolean, next_s long"


def advance(state: tuple, rows: pd.DataFrame, interval_s: int, base_s: int, cap_s: int) -> tuple:
    """(last success, failures since, stopped) after rows in order of time; once stopped, nothing changes."""
    last, failures, stopped = state
    for at, outcome in zip(rows["seen_at"], rows["outcome"]):
        if stopped:
            break
        if outcome == "OK":
            last, failures = at, 0
        elif outcome == "TRANSIENT":
            failures += 1
        else:
            stopped = True
    return last, failures, stopped


def cursor_stream(polls: DataFrame, interval_s: int = 60, base_s: int = 60, cap_s: int = 1800) -> DataFrame:
    """CURSOR rows of each site that a micro-batch touched, as polls.cursors has them in batch.

    State is three values a site. A micro-batch's rows of a site are put in
    order of time; rows later than a later batch's are taken as they come.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seen_at", "event_id"])
        was = state.get if state.exists else (None, 0, False)
        last, failures, stopped = advance((was[0], was[1], was[2]), rows, interval_s, base_s, cap_s)
        state.update((last, failures, stopped))
        wait = None if stopped else interval_s if failures == 0 else int(min(cap_s, base_s * 2 ** (failures - 1)))
        yield pd.DataFrame({"site": [key[0]], "last_ok": [last], "failures": [failures], "stopped": [stopped], "next_s": pd.array([wait], "Int64")})

    return polls.groupBy("site").applyInPandasWithState(run, CURSOR, "last_ok timestamp, failures long, stopped boolean", "update", "NoTimeout")


def diagnosed(state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """State after rows in order of time, and (event_id, reason) of new alerts. State: the last WINDOW outcomes as bits with a leading 1, polls running without deals and without prices, and whether the site may alert."""
    bits, empty, priceless, armed = state
    out = []
    for event, outcome, deals, priced in zip(rows["event_id"], rows["outcome"], rows["deal_count"], rows["priced_count"]):
        if outcome == "BLOCKED":
            continue
        ok = outcome == "OK"
        bits = bits << 1 | ok
        if bits >> WINDOW + 1:  # more than WINDOW outcomes behind the leading 1: the first goes
            bits = bits & (1 << WINDOW) - 1 | 1 << WINDOW
        empty = empty + 1 if ok and deals == 0 else 0
        priceless = priceless + 1 if ok and deals > 0 and priced == 0 else 0
        armed = armed or (ok and deals > 0 and priced > 0)
        unstable = bits >> WINDOW == 1 and bin(bits)[3:].count("1") < LEAST_RATE * WINDOW
        reason = "EMPTY" if empty >= STREAK else "PRICELESS" if priceless >= STREAK else "UNSTABLE" if unstable else None
        if reason and armed:
            out.append((event, reason))
            armed = False
    return (bits, empty, priceless, armed), out


def drift_stream(polls: DataFrame) -> DataFrame:
    """site, event_id, reason of the alerts that polls.drift has in batch, as they come: four numbers a site are the state.

    A micro-batch's rows of a site are put in order of time; a row that is
    earlier than one of a micro-batch before is taken as it comes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seen_at", "event_id"])
        after, out = diagnosed(tuple(state.get) if state.exists else (1, 0, 0, True), rows)
        state.update(after)
        if out:
            yield pd.DataFrame({"site": key[0], "event_id": [e for e, _ in out], "reason": [r for _, r in out]})

    rows = polls.select("site", "event_id", "seen_at", "outcome", "deal_count", "priced_count")
    return rows.groupBy("site").applyInPandasWithState(run, "site string, event_id long, reason string", "bits long, empty long, priceless long, armed boolean", "append", "NoTimeout")


def health_stream(checks: DataFrame, threshold: int = 3) -> DataFrame:
    """component, check_id of the alarms that polls.health_alarms has in batch, as they come: a component's failures running are the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, out = state.get[0] if state.exists else 0, []
        rows = pd.concat(list(frames)).sort_values(["seen_at", "check_id"])
        for check, ok in zip(rows["check_id"], rows["ok"]):
            failures = 0 if ok else failures + 1
            if failures == threshold:
                out.append(check)
        state.update((failures,))
        if out:
            yield pd.DataFrame({"component": key[0], "check_id": out})

    return checks.select("component", "check_id", "seen_at", "ok").groupBy("component").applyInPandasWithState(run, "component string, check_id long", "failures long", "append", "NoTimeout")
