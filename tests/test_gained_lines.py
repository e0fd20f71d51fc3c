"""Conversions of documents that gained lines after they were converted."""

from pyspark.sql import functions as F

from cargoloom.plans import conversions
from cargoloom.sources.tables import StarSchemaTables

SF, AS_OF = "/root/testdata/sf0.001", "1999-06-30"


def frozen(spark, df):
    """The same rows without a plan behind them."""
    return spark.createDataFrame(df.collect(), df.schema)


def with_orders_that_gained_lines(t):
    """The tables without the PO lines 1 and 4 of some orders, as if these had been ordered after the PO was made."""
    late = (F.col("poId") % 9 == 2) & F.split("podetailsId", "-")[1].isin("1", "4")
    return t.replace(poLineItem=t.poLineItem.where(~late))


def requests(df, key):
    return df.select(F.col(key).cast("string").alias("requestId"), key)


def test_lines_an_order_gained_go_to_its_po(spark):
    t = with_orders_that_gained_lines(StarSchemaTables(spark, SF))
    asked = requests(t.soHeader, "soHeaderId")
    plain = conversions.convert_to_purchase_orders(t, asked, AS_OF)
    before = {r.soLineItemId for r in plain.refreshed_lines.collect()}
    already = {r.soLineItemId for r in plain.added_lines.collect()}  # some orders have gained lines
    orders = {r.soLineItemId: r for r in t.soLineItem.collect()}
    gained = {i for i in before if (orders[i].odrQty > orders[i].poQty) and orders[i].soLineItemStatus == 6237}
    gained = set(sorted(gained)[::3])
    assert len(gained) > 3
    kept = frozen(spark, t.poLineItem.where(~F.col("soLineItemId").isin(*gained)))
    out = conversions.convert_to_purchase_orders(t.replace(poLineItem=kept), asked, AS_OF)
    names = {r.poId: (r.poName, r.poReferenceId) for r in t.poHeader.collect()}
    heads = {r.soHeaderId: r.soName for r in t.soHeader.collect()}
    added = out.added_lines.collect()
    assert already and sorted(r.soLineItemId for r in added) == sorted(gained | already)
    for r in added:
        order = orders[r.soLineItemId]
        assert (r.poName, heads[order.soHeaderId]) == names[r.poId] and r.qty == order.odrQty - order.poQty and r.itemStatus == 1079
    assert {r.soLineItemId: r.poQty for r in out.so_lines.collect() if r.soLineItemId in gained} == {i: orders[i].odrQty for i in gained}


def test_request_lines_name_the_new_po(spark):
    t = StarSchemaTables(spark, SF)
    t = t.replace(poHeader=t.poHeader.limit(0))
    out = conversions.convert_to_purchase_orders(t, requests(t.soHeader, "soHeaderId"), AS_OF)
    names = {r.soLineItemId: r.poName for r in out.lines.collect()}
    want = sorted((str(r.lrDetailsId), names[r.soLineItemId]) for r in t.lrLineItem.collect() if r.soLineItemId in names)
    assert sorted((str(r.lrDetailsId), r.poName) for r in out.relinked.collect()) == want


def test_lines_a_po_gained_go_to_its_internal_order(spark):
    t = StarSchemaTables(spark, SF)
    asked = requests(t.poHeader, "poId")
    first = conversions.raise_internal_orders(t, asked, AS_OF)
    heads = first.headers.select("poId", "companyId", "customerPO", "soName").collect()
    mirrored = {r[0] for r in t.soLineItem.select("ref_poLineItemId").collect()}
    lines = [r for r in first.lines.collect() if r.ref_poLineItemId not in mirrored]
    one = t.soHeader.limit(1)
    raised = spark.createDataFrame([(10_000_000 + i, r.companyId, r.customerPO) for i, r in enumerate(heads)], "_id long, _c long, _po string")
    more = one.crossJoin(raised).withColumns({c: F.col(v).cast(one.schema[c].dataType) for c, v in (("soHeaderId", "_id"), ("companyId", "_c"), ("customerPO", "_po"))}).select(*one.columns)
    ids = {r.soName: 10_000_000 + i for i, r in enumerate(heads)}
    there, gained = lines[::2], lines[1::2]
    assert there and gained
    line = t.soLineItem.limit(1)
    refs = spark.createDataFrame([(20_000_000 + i, ids[r.soName], str(r.ref_poLineItemId)) for i, r in enumerate(there)], "_id long, _h long, _ref string")
    has = line.crossJoin(refs).withColumns({c: F.col(v).cast(line.schema[c].dataType) for c, v in (("soLineItemId", "_id"), ("soHeaderId", "_h"), ("ref_poLineItemId", "_ref"))}).select(*line.columns)
    again = conversions.raise_internal_orders(t.replace(soHeader=frozen(spark, t.soHeader.unionByName(more)), soLineItem=frozen(spark, t.soLineItem.unionByName(has))), asked, AS_OF)
    assert again.headers.count() == 0 and again.updated_lines.count() == len(there)
    added = again.added_lines.collect()
    assert sorted((r.soHeaderId, r.ref_poLineItemId, r.odrQty) for r in added) == sorted((ids[r.soName], r.ref_poLineItemId, r.odrQty) for r in gained)
    assert {r.soLineItemStatus for r in added} == {1105}


def test_every_order_and_order_line_has_its_po_row(spark):
    t = StarSchemaTables(spark, SF)
    assert t.poHeader.count() == t.orders.count() and t.poLineItem.count() == t.lineitem.count()
    assert t.poHeader.join(t.orders, F.col("poId") == F.col("o_orderkey"), "left_anti").isEmpty()
