"""apply_user_changes against applying the requests one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callqc.operators import merges, user_changes
from callqc.plans import ordinal
from callqc.sources import schemas
from tests.helpers import K, frame, user

FIELDS = ("full_name", "role", "is_active")


def one_by_one(users, requests):
    """State and refusals after the requests, as a server would leave them."""
    state, refused = {u["id"]: dict(u) for u in users}, []
    for r in sorted(requests, key=lambda r: r["seq"]):
        reason = None
        if r["op"] == "create":
            if r["id"] is None or r["username"] is None:
                reason = "missing_key"
            elif any(u["username"] == r["username"] for u in state.values()):
                reason = "duplicate_username"
            elif r["id"] in state:
                reason = "duplicate_id"
            else:
                state[r["id"]] = dict(id=r["id"], username=r["username"], full_name=r["full_name"], role=r["role"] or "agent", is_active=True)
        elif r["op"] == "update":
            sent = {f: r[f] for f in FIELDS if r[f] is not None}
            if not sent:
                reason = "empty_update"
            elif r["id"] in state:
                state[r["id"]].update(sent)
        else:
            state.pop(r["id"], None)
        if reason:
            refused.append((r["seq"], r["op"], r["id"], r["username"], reason))
    return {k: tuple(u[c] for c in ("username", *FIELDS)) for k, u in state.items()}, sorted(refused, key=str)


def request(seq, op, id=None, username=None, **sent):
    return dict(dict.fromkeys(FIELDS), seq=seq, op=op, id=id, username=username, **sent)


def random_feed(groups, each, seed):
    """Requests of many groups of names and ids, all mixed."""
    rng = np.random.default_rng(seed)
    pick = lambda *of: of[rng.integers(len(of))]
    out, n = [], 0
    for _ in range(groups * each):
        g, n = int(rng.integers(groups)), n + 1
        op = pick("create", "create", "update", "delete")
        out.append(request(n, op, g * 10 + int(rng.integers(4)) if rng.random() > 0.02 else None,
                           f"n{g}-{rng.integers(3)}" if op == "create" and rng.random() > 0.02 else None,
                           full_name=pick(None, None, f"N{n}"), role=pick(None, None, "admin"), is_active=pick(None, None, True, False) if op == "update" else None))
    users = [user(g * 10, f"n{g}-0", full_name=None) for g in range(0, groups, 2)] + [user(g * 10 + 7, f"n{g}-2") for g in range(0, groups, 3)]
    return users, out


def check(spark, users, requests):
    out, rejected = merges.apply_user_changes(frame(spark, schemas.qc_users(K), users), frame(spark, schemas.user_changes(K), requests))
    want, refused = one_by_one(users, requests)
    assert {r.id: (r.username, r.full_name, r.role, r.is_active) for r in out.collect()} == want
    assert sorted(map(tuple, rejected.collect()), key=str) == refused


@pytest.mark.parametrize("fold,block", [(500, 1 << 16), (12, 7)])
def test_any_feed_ends_as_one_by_one(spark, monkeypatch, fold, block):
    monkeypatch.setattr(user_changes, "FOLD", fold)
    monkeypatch.setattr(ordinal, "BLOCK", block)
    check(spark, *random_feed(60, 25, seed=4))


def test_a_hot_name_and_a_hot_id(spark, monkeypatch):
    """One name asked for, dropped and asked for again in turns; one id sent with a new name each time."""
    monkeypatch.setattr(user_changes, "FOLD", 20)
    monkeypatch.setattr(ordinal, "BLOCK", 50)
    feed = [request(3 * k + j, "delete" if j == 2 else "create", 100 + (k if j else 5000 + k), "hot") for k in range(150) for j in range(3)]
    feed += [request(1000 + k, "delete" if k % 90 == 89 else "create", 7, f"name-{k}") for k in range(300)]
    check(spark, [user(1, "ann"), user(7, "bob")], feed)


def test_a_freed_name_and_a_refused_claim(spark):
    users = [user(1, "ann"), user(2, "bob")]
    feed = [request(1, "create", 2, "cy"), request(2, "create", 9, "cy"), request(3, "delete", 1), request(4, "create", 10, "ann"), request(5, "create", 11, "ann"),
            request(6, "update", 10, role="admin"), request(7, "delete", 10), request(8, "create", 11, "ann"), request(9, "update", 10, role="ghost")]
    check(spark, users, feed)
    check(spark, users, [])
    check(spark, [], feed)


def test_next_position_and_ordinal(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 12), ("a", 40), ("b", 0), ("c", 3)], "key string, at long")
    events = spark.createDataFrame([("a", 5), ("a", 13), ("a", 39), ("b", 99)], "key string, at long")
    for block in (1, 4, 1000):
        got = {(r.key, r.at): r.next for r in ordinal.next_position(rows, events, block).collect()}
        assert got == {("a", 5): 13, ("a", 12): 13, ("a", 40): None, ("b", 0): 99, ("c", 3): None}
    many = spark.range(5000).select((F.col("id") % 7).alias("place"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("row")).repartition(9)
    got = ordinal.ordinal(many, [F.col("place").desc()], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.place, r.row is not None, r.row or 0, r.n))] == list(range(1, 5001))
