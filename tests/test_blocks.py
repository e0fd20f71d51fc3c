"""Building blocks on hand-made rows, against brute force where one exists."""

import datetime as dt
import itertools
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargoloom.functions.address import party_addresses
from cargoloom.functions.calendar import date_dimension, number_series, numbers_of
from cargoloom.functions.naming import product_name
from cargoloom.functions.numbering import advance_counters, allocate_codes, allocate_numbers, dated_numbers
from cargoloom.functions.payload import id_list, parse_payload
from cargoloom.functions.text import blank, contains_text, distinct_list, text_key
from cargoloom.operators import ledger
from cargoloom.operators.changes import ChangeSpec, apply_changes
from cargoloom.operators.history import as_of, as_of_join, build_history, changed_rows
from cargoloom.operators.lookup import config_value, pivot_attributes, rate_at, resolve
from cargoloom.operators.ordering import Falling, ordinal, running_max, running_totals
from cargoloom.operators.paging import cut_page, paged_listing
from cargoloom.operators.transitions import LineSpec, TransitionSpec, merge_rows, move_lines, status_transition
from cargoloom.operators.validate import KEYS_PER_MESSAGE, Rule, error_summary, first_errors, in_file_duplicates, open_qty_guard, required, single_value_per_group, validate
from cargoloom.plans.loads import orders_holding


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_text_rules(spark):
    df = spark.createDataFrame([("Abc  ", None), ("aBC", " "), ("x%y", "v")], "a string, b string")
    assert [r[0] for r in df.select(text_key("a")).collect()] == ["abc", "abc", "x%y"]
    assert [r[0] for r in df.select(blank("b")).collect()] == [True, True, False]
    assert df.where(contains_text("a", "%")).count() == 1 and df.where(contains_text("a", " BC")).count() == 2


def test_distinct_list_orders_and_keeps_null_for_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "g int, v string")
    assert rows(df.groupBy("g").agg(distinct_list("v").alias("l"))) == [(1, "a,b"), (2, None)]


@pytest.mark.parametrize("coalesce", ["false", "true"])
def test_ordinal_with_a_hot_group(spark, coalesce):
    """Several range partitions, as planned or merged into fewer by adaptive execution."""
    for name, value in {"coalescePartitions.enabled": coalesce, "coalescePartitions.parallelismFirst": "false", "advisoryPartitionSizeInBytes": "24k"}.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        check_hot_group(spark)
    finally:
        for name in ("coalescePartitions.parallelismFirst", "advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.adaptive.{name}")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def check_hot_group(spark):
    random.seed(5)
    data = [(random.choice(["hot"] * 6 + ["a", "b"]), random.randint(0, 50), i) for i in range(4000)]
    got = rows(ordinal(spark.createDataFrame(data, "g string, v int, id int"), ["v", "id"], ["g"]), "id", "rowNo")
    want = []
    for _, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        want += [(r[2], n) for n, r in enumerate(sorted(group, key=lambda r: (r[1], r[2])), 1)]
    assert got == sorted(want)


def test_ordinal_without_group_and_descending(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 1000)
    assert all(r.rowNo == 1000 - r.v for r in ordinal(df, [Falling("v")]).collect())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=60))
def test_running_totals_match_a_loop(spark, pairs):
    data = [(g, i, v) for i, (g, v) in enumerate(pairs)]
    got = rows(running_totals(spark.createDataFrame(data, "g int, i int, v int"), ["i"], ["g"], s=F.col("v").cast("long")), "i", "s")
    sums, want = {}, []
    for g, i, v in data:
        sums[g] = sums.get(g, 0) + v
        want.append((i, sums[g]))
    assert got == want


def test_running_max_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 3)], "i int, v int")
    assert rows(running_max(df, ["i"], m=F.col("v")), "i", "m") == [(1, None), (2, 5), (3, 5), (4, 5)]


def test_empty_input_is_numbered(spark):
    assert ordinal(spark.range(0), ["id"]).count() == 0


def test_pages_partition_the_listing(spark):
    df = spark.range(95).withColumn("tie", F.lit("same"))
    pages = [rows(paged_listing(df, {1: "tie"}, 1, "DESC", ["id"], s, 20), "rowNo", "id", "totalRecord") for s in (1, 21, 41, 61, 81)]
    flat = [r for p in pages for r in p]
    assert flat == [(i + 1, i, 95) for i in range(95)]
    assert paged_listing(df, {1: "tie"}, 1, "ASC", ["id"], 200, 10).count() == 0
    assert rows(cut_page(df, [F.col("id")], 31, 5), "rowNo", "id") == [(i, i - 1) for i in range(31, 36)]


def test_pages_at_any_depth_equal_a_numbered_sort(spark):
    df = spark.range(1_100_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("w"))
    values = df.toPandas()  # noqa: F841, read by the SQL below
    for direction, start in (("ASC", 1), ("DESC", 99_990), ("ASC", 1_000_000), ("DESC", 1_099_995)):
        got = rows(paged_listing(df, {1: "v"}, 1, direction, ["id"], start, 20), "rowNo", "id", "totalRecord")
        order = f"v {direction}, id"
        assert got == duckdb.sql(f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS n, id, 1100000 FROM values) WHERE n BETWEEN {start} AND {start + 19} ORDER BY n").fetchall()


def test_equal_rows_of_a_page_are_numbered_once_each(spark):
    df = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] * 5, "k int, t string").repartition(4)
    pages = [r for s in (1, 11, 21, 31) for r in rows(paged_listing(df, {1: "k"}, 1, "ASC", ["t"], s, 10), "rowNo", "k", "totalRecord")]
    assert pages == [(i + 1, 1 if i < 30 else 2, 35) for i in range(35)]


def test_resolve_takes_the_lowest_match_case_insensitively(spark):
    dim = spark.createDataFrame([(7, "North "), (3, "NORTH"), (9, "South")], "id int, name string")
    df = spark.createDataFrame([("north",), ("south  ",), ("west",), (None,)], "n string")
    assert rows(resolve(df, dim, {"n": "name"}, "id", found="id").withColumn("n", F.coalesce("n", F.lit("-")))) == [("-", None), ("north", 3), ("south  ", 9), ("west", None)]


def test_config_falls_back_to_company_zero(spark):
    conf = spark.createDataFrame([(1, 0, "Days", "14"), (2, 5, "days", "3")], "configId int, companyId int, configName string, configValue string")
    df = spark.createDataFrame([(5,), (6,)], "c int")
    assert rows(config_value(df, conf, "c", "DAYS", "v")) == [(5, "3"), (6, "14")]


def test_rate_on_date(spark):
    d = dt.date
    rates = spark.createDataFrame([(1, 1, d(2020, 1, 1), d(2020, 6, 30), "SGD", "USD", 10, 1), (2, 1, d(2020, 6, 1), d(2020, 12, 31), "SGD", "USD", 20, 1), (3, 1, d(2020, 1, 1), d(2020, 12, 31), "SGD", "USD", 30, 0)],
                                  "rateId int, companyId int, startDate date, endDate date, homeCurrency string, foreignCurrency string, foreignRate int, status int")
    df = spark.createDataFrame([(1, 1, "sgd", "USD", d(2020, 3, 1)), (2, 1, "SGD", "USD", d(2020, 6, 15)), (3, 1, "SGD", "USD", d(2021, 1, 1)), (4, 2, "SGD", "USD", d(2020, 3, 1))],
                               "id int, c int, h string, f string, on date")
    assert rows(rate_at(df, rates, "c", "h", "f", "on"), "id", "rate") == [(1, 10), (2, 20), (3, None), (4, None)]


def test_pivot_attributes(spark):
    df = spark.createDataFrame([(1, "Color", "red"), (1, "SIZE", "4"), (2, "color", "blue")], "i int, n string, v string")
    assert rows(pivot_attributes(df, "i", "n", "v", ["color", "size"])) == [(1, "red", "4"), (2, "blue", None)]


def test_payloads(spark):
    df = spark.createDataFrame([('{"soList":[{"soHeaderId":"30932"},{"soHeaderId":7},{"soHeaderId":"x"},{"soHeaderId":7}]}',)], "j string")
    assert rows(id_list(df, "j", "soList", "soHeaderId")) == [(7,), (30932,)]
    one = spark.createDataFrame([('{"a":"1","b":"t"}',), ('[{"a":2,"b":null},{"a":3}]',)], "j string")
    assert {r.a for r in parse_payload(one, "j", {"a": "int"}).collect()} == {1, 2, 3}
    nested = spark.createDataFrame([('[{"poId":"5","DO":"d","poList":[{"poDetailsId":"8","rcvQty":"2"},{"poDetailsId":9,"rcvQty":3}]}]',)], "j string")
    assert rows(parse_payload(nested, "j", {"poId": "bigint", "DO": "string"}, nested={"poList": {"poDetailsId": "bigint", "rcvQty": "int"}})) == [(5, "d", 8, 2), (5, "d", 9, 3)]


def staged(spark):
    return spark.createDataFrame([(1, "f1", "a", "5"), (2, "f1", "", "x"), (3, "f2", "b", "1"), (4, "f2", "c", "2")], "id int, f string, name string, q string")


def RULES():
    return [required("Name", "name"), Rule("Quantity {} is bad", F.col("q").try_cast("int").isNull(), F.col("q"))]


def test_validate_strict_and_row_mode(spark):
    strict, loose = validate(staged(spark), RULES(), "id", ["f"]), validate(staged(spark), RULES(), "id", ["f"], strict=False)
    assert rows(strict.accepted, "id") == [(3,), (4,)] and rows(loose.accepted, "id") == [(1,), (3,), (4,)]
    assert rows(strict.errors, "id", "ruleNo", "key") == [(2, 1, ""), (2, 2, "x")]
    assert loose.accepted.count() + loose.errors.select("id").distinct().count() == 4


def test_messages_list_every_key_in_parts(spark):
    errors = spark.range(250).select(F.lit("f").alias("f"), F.lit(1).alias("ruleNo"), F.lit("Item {} is wrong").alias("rule"), F.format_string("%04d", "id").alias("key"))
    parts = sorted(error_summary(errors, ["f"]).collect(), key=lambda r: r.part)
    assert [r.keyCount for r in parts] == [KEYS_PER_MESSAGE, KEYS_PER_MESSAGE, 50]
    keys = ",".join(r.message[len("Item "):-len(" is wrong")] for r in parts).split(",")
    assert keys == [f"{i:04d}" for i in range(250)]


def test_first_error_is_the_lowest_rule(spark):
    assert rows(first_errors(validate(staged(spark), RULES(), "id", ["f"]).errors, ["f"]), "f", "message") == [("f1", "Name is required")]


def test_group_flags(spark):
    df = spark.createDataFrame([(1, "A", 1, 5, 8), (2, "a ", 2, 4, 8), (3, "b", 3, 1, 1), (4, None, 3, 1, None)], "id int, k string, v int, asked int, open int")
    assert rows(in_file_duplicates(df, ["k"], "x"), "id", "x") == [(1, True), (2, True), (3, False), (4, False)]
    assert rows(single_value_per_group(df, ["k"], "v", "x"), "id", "x") == [(1, True), (2, True), (3, False), (4, False)]
    assert rows(open_qty_guard(df, "k", "asked", "open", "x"), "id", "x")[2:] == [(3, False), (4, False)]


def test_product_name(spark):
    df = spark.createDataFrame([("[ModelNo][space][COLOR]+[,]+[size][pages]", "M1", None)], "t string, m string, c string")
    assert df.select(product_name(F.col("t"), {"modelno": F.col("m"), "color": F.col("c")})).first()[0] == "M1 ,[size]"


def test_addresses_by_country(spark):
    codes = spark.createDataFrame([(3, "Singapore"), (22, "Malaysia"), (7, "Spain")], "categoryId int, categoryName string")
    people = spark.createDataFrame([(1, "a", "1 st", "u 2", "town", "st", "999", 3), (2, "b", "1 st", "", "town", "st", "999", 22), (3, "c", "1 st", "u 2", "town", "", "999", 7)],
                                   "customerId int, customerName string, customerAddress string, customerAddressLine2 string, customerCity string, customerStates string, customerPostcode string, customerCountry int")
    assert rows(party_addresses(people, codes, "customer", 1), "id", "line1") == [(1, "1 ST, U 2, SINGAPORE 999."), (2, "1 ST, TOWN, ST 999, MALAYSIA."), (3, "1 ST, U 2, 999 TOWN, SPAIN.")]
    assert rows(party_addresses(people, codes, "customer", 2), "id", "line1", "line2")[1] == (2, "1 ST", "TOWN, ST 999, MALAYSIA.")


SEQ = "Id int, csID int, condition string, ItemFormat string, NextNum long, MaxNum long"


def test_running_numbers_keep_all_digits_past_the_maximum(spark):
    seq = spark.createDataFrame([(1, 1, "PO", "P-yy-xxxxx", 99999, 99999)], SEQ)
    docs = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "c int, id int")
    assert rows(allocate_numbers(docs, seq, "PO", "c", ["id"], "2024-05-01", "n"), "id", "n") == [(10, "P-24-99999"), (11, "P-24-100000"), (12, None)]
    assert rows(advance_counters(docs, seq, "PO", "c"), "NextNum") == [(100001,)]
    named = docs.withColumn("name", F.when(F.col("id") == 10, "X(1)ABCDE").otherwise("plain"))
    assert rows(dated_numbers(named, seq, "PO", "c", "name", ["id"], "2024-05-01", "n"), "id", "n")[:2] == [(10, "X(1)ABC-99999-240501"), (11, "P-yy-xxxxx100000240501")]


def test_codes_skip_used_numbers(spark):
    used = spark.createDataFrame([("A.0001",), ("A.0003",), ("A.0004",), ("B.0002",), ("A.x",), ("IT7",)], "code string")
    asks = spark.createDataFrame([("A", i) for i in range(4)] + [("B", 9), ("C", 1)], "p string, id int")
    got = rows(allocate_codes(asks, used, "code", "p", ["id"], 4), "p", "id", "newCode")
    assert got == [("A", 0, "A.0002"), ("A", 1, "A.0005"), ("A", 2, "A.0006"), ("A", 3, "A.0007"), ("B", 9, "B.0001"), ("C", 1, "C.0001")]
    counters = spark.createDataFrame([("A", 4)], "p string, NextNum int")
    assert rows(allocate_codes(asks.where("p = 'A'"), used, "code", "p", ["id"], 4, counters), "newCode")[0] == ("A.0005",)


def test_calendar_and_series(spark):
    span = spark.createDataFrame([(dt.date(2023, 12, 30), dt.date(2024, 3, 1))], "a date, b date")
    days = date_dimension(span, "a", "b")
    assert days.count() == 63 and len(days.columns) == 25
    leap = days.where("Date = '2024-02-29'").first()
    assert (leap.DateKey, leap.DaySuffix, leap.LastDayOfMonth, leap.QuarterName, leap.FirstDayOfNextYear) == (20240229, "th", dt.date(2024, 2, 29), "First", dt.date(2025, 1, 1))
    assert [r.i for r in number_series(spark, 2, 11, 3).orderBy("i").collect()] == [2, 5, 8, 11]
    assert rows(numbers_of(spark.createDataFrame([(3,), (0,)], "n int"), 1, "n"), "i") == [(1,), (2,), (3,)]


def test_ledger(spark):
    key = "warehouseId int, companyId int, invId long, "
    bal = spark.createDataFrame([(1, 1, 1, 5, 2)], key + "balanceQty long, lockQty long")
    mv = spark.createDataFrame([(1, 1, 1, -9), (1, 1, 2, 4), (1, 1, 2, 1)], key + "qty long")
    lk = spark.createDataFrame([(1, 1, 2, 3)], key + "lockQty long")
    assert rows(ledger.ledger_apply(mv, bal, lk)) == [(1, 1, 1, -4, 2), (1, 1, 2, 5, 3)]
    lines = spark.createDataFrame([(1, 10, 5), (2, 10, 0), (3, 11, 5)], "id int, h int, s int")
    assert rows(ledger.all_lines_in(lines, "h", "s", (5, 6))) == [(10, False), (11, True)]
    locks = spark.createDataFrame([("a", 5, 1)], "soLineItemId string, lockQty long, releaseQty long")
    assert rows(ledger.release(locks, spark.createDataFrame([("a", 3), ("a", 9)], "soLineItemId string, qty long")), "releaseQty") == [(5,)]


def test_history(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    ch = spark.createDataFrame([("k", t(1), 1, "a"), ("k", t(3), 2, "b"), ("z", t(2), 3, "c")], "k string, at timestamp, seq int, v string")
    h = build_history(ch, "k", "at", "seq")
    assert rows(h, "k", "v", "ValidFrom", "ValidTo")[0] == ("k", "a", t(1), t(3))
    assert rows(as_of(h, "2024-01-02 12:00:00"), "v") == [("a",), ("c",)]
    probe = spark.createDataFrame([(1, "k", t(1)), (2, "k", t(2)), (3, "k", t(9)), (4, "z", t(1)), (5, "q", t(5))], "id int, k string, at timestamp")
    assert rows(as_of_join(probe, h.drop("seq"), "k", "at", "id"), "id", "v") == [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)]


def test_changed_rows_ignore_equal_and_pair_on_the_row_key(spark):
    old = spark.createDataFrame([(1, 5, None), (2, 6, 1), (3, 7, None)], "id int, a int, b int")
    new = spark.createDataFrame([(1, 5, None), (2, 6, 2), (3, 7, 4)], "id int, a int, b int")
    assert rows(changed_rows(old, new, "id", ["a", "b"]).fillna("-")) == [(2, "b", "1", "2"), (3, "b", "-", "4")]


SPEC = TransitionSpec("id", "name", "st", (1, 2), 3, ((9, "{} is closed"),), "{} cannot change")


def test_transition_rejects_the_whole_request(spark):
    heads = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 9), (4, "d", 5)], "id int, name string, st int")
    lines = spark.createDataFrame([(10, 1, 1), (11, 1, 7), (12, 3, 1)], "line int, id int, st int")
    asks = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3), ("r2", 1), ("r3", 4), ("r4", 99)], "requestId string, id int")
    done = status_transition(heads, asks, SPEC)
    assert rows(done.headers) == [(1, "a", 3), (2, "b", 3)]
    assert rows(done.errors, "requestId", "ruleNo", "key") == [("r2", 1, "c"), ("r2", 2, "c"), ("r3", 2, "d")]
    moved = move_lines(lines, done.accepted, LineSpec("id", "st", (1, 2)), 3)
    assert rows(moved) == [(10, 1, 3)]
    assert rows(merge_rows(lines, moved, ["line"])) == [(10, 1, 3), (11, 1, 7), (12, 3, 1)]
    assert status_transition(heads, asks.limit(0), SPEC).headers.count() == 0


def test_apply_changes(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 0)], "id int, name string, status int")
    ch = spark.createDataFrame([(1, "Add", None, "A "), (2, "Add", None, "c"), (3, "add", None, "C"), (4, "Update", 2, "bb"), (5, "Update", 2, "b3"), (6, "Update", 1, "B"), (7, "Delete", 9, None), (8, "Delete", 1, None),
                                (9, "Reactivate", 3, None), (10, "Update", 1, " "), (11, "Burn", 1, "x")], "changeId int, actionType string, id int, name string")
    done = apply_changes(target, ch, ChangeSpec("id", ("name",), ("name",), ("name",), True, "status"))
    assert rows(done.added, "changeId", "name") == [(2, "c")]
    assert rows(done.changed) == [(1, "a", 0), (2, "b3", 1), (3, "c", 1)]
    assert {r.changeId for r in done.errors.collect()} == {1, 3, 6, 7, 10, 11}


def test_orders_holding_matches_brute_force(spark):
    random.seed(3)
    text = lambda n: "".join(random.choice("ab1") for _ in range(n))
    orders = [(1, random.randint(1, 2), text(random.randint(0, 9))) for _ in range(40)]
    asked = [(1, random.randint(1, 3), text(random.randint(1, 4)).upper()) for _ in range(60)]
    want = sorted({(c, k, p.lower()) for c, k, p in asked if any(k == ok and p.lower() in o for _, ok, o in orders)})
    schema = "companyId int, customerId int, customerPO string"
    assert rows(orders_holding(spark.createDataFrame(asked, schema), spark.createDataFrame(orders, schema))) == want


@given(st.lists(st.text("ab-1", min_size=1, max_size=9), max_size=8), st.lists(st.text("ab-1", max_size=14), max_size=8))
@settings(max_examples=8, deadline=None)
def test_po_texts_of_all_lengths_are_found_inside_orders(spark, staged, known):
    a = spark.createDataFrame([(1, 7, t) for t in staged] + [(2, 7, "b")], "companyId int, customerId int, customerPO string")
    b = spark.createDataFrame([(1, 7, t) for t in known] + [(1, 8, "".join(staged))], "companyId int, customerId int, customerPO string")
    want = {t.strip() for t in staged if t.strip() and any(t.strip() in k.strip() for k in known)}
    assert {r["_po"] for r in orders_holding(a, b).collect()} == want


def test_numbering_writes_narrow_rows_whatever_the_width(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.repeat(F.lit("wide"), 1000).alias("w"))
    got = rows(ordinal(df, [F.col("id")], within=["g"]), "g", "id", "rowNo")
    assert got == sorted((i % 3, i, i // 3 + 1) for i in range(200))
    falling = rows(ordinal(df, [Falling("id")]), "id", "rowNo")
    assert falling == [(i, 200 - i) for i in range(200)]
    assert rows(ordinal(df, ["g"], name="n"), "n") == [(i + 1,) for i in range(200)]  # ties are numbered apart
    plan = ordinal(df, ["id"])._jdf.queryExecution().analyzed().toString()
    assert plan.count("repeat(wide") == 1
