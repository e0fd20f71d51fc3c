"""Admission against stock, against a loop over the requests."""

import random

from cargoloom.operators.admission import unserved


def one_by_one(rows, barred=()):
    first, needs, limits, used, short = {}, {}, {}, {}, []
    for request, order, key, need, limit in rows:
        first[request] = min(first.get(request, order), order)
        needs.setdefault(request, {}).setdefault(key, 0)
        needs[request][key] += need
        limits[key] = max(limits.get(key, 0), limit or 0)
    for request in sorted(first, key=lambda r: (first[r], r)):
        lacks = [k for k, n in needs[request].items() if n + used.get(k, 0) > limits[k]]
        short += [(request, k) for k in lacks]
        if not lacks and request not in barred:
            for k, n in needs[request].items():
                used[k] = used.get(k, 0) + n
    return sorted(short)


def served(spark, rows, barred=None):
    df = spark.createDataFrame(rows, "request int, ord int, item string, need int, stock int")
    bar = spark.createDataFrame([(b,) for b in barred], "request int") if barred else None
    return sorted(tuple(r) for r in unserved(df, "request", "ord", ["item"], "need", "stock", bar).collect())


def test_rejected_requests_hold_nothing(spark):
    rows = [(1, 1, "a", 6, 10), (1, 1, "b", 9, 5), (2, 2, "a", 8, 10), (3, 3, "a", 3, 10), (3, 3, "b", 5, 5), (4, 4, "a", 2, 10)]
    assert served(spark, rows) == one_by_one(rows) == [(1, "b"), (3, "a")]


def test_equal_to_a_loop_with_a_hot_item_and_several_items_a_request(spark):
    rng = random.Random(5)
    stock = {"hot": 60, **{f"i{n}": rng.randrange(0, 25) for n in range(6)}, "none": None}
    rows = []
    for request in range(120):
        for item in {"hot"} | set(rng.sample(list(stock), 2)) if rng.random() < .6 else set(rng.sample(list(stock), 2)):
            for _ in range(rng.randrange(1, 3)):
                rows.append((request, rng.randrange(1000) if request % 10 else 5, item, rng.choice([1, 2, 5, 9, -3 if item == "i1" else 0]), stock[item]))
    barred = [7, 8, 9]
    want = one_by_one(rows, barred)
    assert served(spark, rows, barred) == want and len({r for r, _ in want}) > 20
