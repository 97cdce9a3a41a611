"""A log of store actions against applying them one by one."""

from __future__ import annotations

import random

import pytest

from chronofold.operators.store import replayed

SCHEMA = "store_id int, seq int, pos int, action string, id string, title string, place string, present array<string>"


def one_by_one(log):
    """{store: (events, selected ids)} by the actions in their order."""
    stores = {}
    for s in sorted({r[0] for r in log}):
        events, selected = [], set()
        for q in sorted({r[1] for r in log if r[0] == s}):
            rows = sorted((r for r in log if r[:2] == (s, q)), key=lambda r: r[2])
            action, key = rows[0][3], rows[0][4]
            if action in ("set", "append"):
                if action == "set":
                    events, selected = [], set()
                for r in rows:
                    if r[4] is not None:
                        events.append({"id": r[4], "title": r[5], "place": r[6], "edited": False, "at": r[1:3]})
                        selected.add(r[4])
            elif action == "reset":
                events, selected = [], set()
            elif action == "clear":
                selected = set()
            elif action == "select_all":
                selected = {e["id"] for e in events}
            elif key is not None and action == "remove":
                events = [e for e in events if e["id"] != key]
                selected.discard(key)
            elif key is not None and action == "toggle":
                selected ^= {key}
            elif key is not None:
                for e in events:
                    if e["id"] == key:
                        e.update({f: v for f, v in (("title", rows[0][5]), ("place", rows[0][6])) if f in rows[0][7]}, edited=True)
        stores[s] = [(s, e["id"], e["title"], e["place"], e["edited"], e["id"] in selected, *e["at"]) for e in events]
    return stores


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_applying_one_by_one(spark, seed):
    rng, log = random.Random(seed), []
    for s in range(25):
        for q in range(rng.randrange(40)):
            action = rng.choice(["set", "append", "append", "update", "update", "remove", "toggle", "toggle", "select_all", "clear"] + ["reset"] * (rng.random() < 0.1))
            value = lambda: rng.choice([None, "a", "b", "c", str(q)])
            ids = [rng.choice("pqrs") for _ in range(rng.randrange(1, 4))] if action in ("set", "append") else [rng.choice(["p", "q", "r", "s", None])]
            if action in ("set", "reset", "select_all", "clear") and rng.random() < 0.5 or action == "reset":
                ids = [None]
            present = rng.choice([[], ["title"], ["place"], ["title", "place"]])
            log += [(s, q, pos, action, i if action not in ("select_all", "clear") else None, value(), value(), present) for pos, i in enumerate(ids)]
    got = [tuple(r) for r in replayed(spark.createDataFrame(log, SCHEMA), ["title", "place"]).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for rows in one_by_one(log).values() for r in rows)


def test_replay_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert replayed(empty, ["title", "place"]).count() == 0
    assert replayed(spark.createDataFrame([(1, 1, 0, "update", "a", "t", None, ["title"]), (1, 2, 0, "toggle", "a", None, None, [])], SCHEMA), ["title"]).count() == 0
