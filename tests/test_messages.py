"""Messages of shipments and of loads, and work orders forced to a warehouse."""

import pytest
from pyspark.sql import functions as F

from cargoloom.operators.validate import KEYS_PER_MESSAGE, nested_error_summary
from cargoloom.plans import conversions, digests
from cargoloom.sources.tables import StarSchemaTables


@pytest.fixture(scope="module")
def t(spark):
    return StarSchemaTables(spark, "/root/testdata/sf0.001")


def test_a_second_street_line_moves_the_town_down(t):
    places = t.md_ShipToDestination.withColumns({"shipToAddressLine2": F.when(F.col("shipToId") % 2 == 0, "Floor 2").otherwise(F.lit(None)), "shipToState": F.lit("S")})
    message = digests.shipment_message(t.replace(md_ShipToDestination=places), "ASN")
    rows, by_id = message.ship_to.collect(), {f"Store {r.shipToId}": r for r in places.collect()}
    assert {r.address2 == "Floor 2, " for r in rows} == {True, False}
    for r in rows:
        place = by_id[r.addressName]
        town = r.address3 if place.shipToAddressLine2 else r.address2
        assert town.startswith(f"{place.shipToCity}, S {place.shipToPostCode}, ") and (r.address3 == "") == (place.shipToAddressLine2 is None)
    bols, items = {}, {}
    for r in message.bols.collect():  # one per company
        bols[r.bol] = bols.get(r.bol, 0) + r.totalOrdersQty
    for r in message.items.collect():
        items[r.bol] = items.get(r.bol, 0) + r.shipQty
    assert items == bols and len(rows) == len(bols)


def test_one_document_with_very_many_keys_is_cut_into_parts(spark):
    n = 5 * KEYS_PER_MESSAGE + 1
    rows = [("f", 1, "{} is bad", "D", f"k{i:05d}") for i in range(n)] * 2 + [("f", 1, "{} is bad", None, None), ("f", 1, "{} is bad", "E", "k")]
    out = nested_error_summary(spark.createDataFrame(rows, "f string, ruleNo int, rule string, doc string, key string"), ["f"], "doc").collect()
    parts = sorted((r for r in out if r.doc == "D"), key=lambda r: r.part)
    assert [r.part for r in parts] == [1, 2, 3, 4, 5, 6] and [r.keyCount for r in parts] == [KEYS_PER_MESSAGE] * 5 + [1]
    assert parts[-1].message == f"k{n - 1:05d} (D) is bad"
    assert {(r.doc, r.message) for r in out if r.doc != "D"} == {("", " () is bad"), ("E", "k (E) is bad")}


def test_wanted_lines_without_location_go_to_the_forced_warehouse(t):
    wanted = t.soLineItem.select("soLineItemId")
    blank_orders = {r.soHeaderId for r in t.soHeader.where("locNo = ''").collect()}
    plain = conversions.convert_to_work_orders(t, "1999-06-30", lines=wanted)
    nowhere = conversions.convert_to_work_orders(t, "1999-06-30", lines=wanted, forced_warehouse=999)
    errors = nowhere.errors.collect()
    assert errors and {r.soHeaderId for r in errors} <= blank_orders and {r.key for r in errors} == {"of warehouse 999"}
    assert {r.soLineItemId for r in errors} | {r.soLineItemId for r in nowhere.lines.collect()} == {r.soLineItemId for r in plain.lines.collect()}
    only_blank = t.soLineItem.where(F.col("soHeaderId").isin([int(i) for i in sorted(blank_orders)])).select("soLineItemId")
    forced = conversions.convert_to_work_orders(t, "1999-06-30", lines=only_blank, forced_warehouse=3)
    assert {r.warehouseId for r in forced.headers.collect()} == {3}
    with pytest.raises(ValueError):
        conversions.convert_to_work_orders(t, "1999-06-30", forced_warehouse=3)
