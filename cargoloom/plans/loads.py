"""Validated bulk loads: staged file rows -> typed, resolved rows or rejects.

Every load checks all staged files in one pass.  ``strict`` rejects a whole file
when any of its rows fails; otherwise only the failing rows are left out.  The
``*_documents`` functions turn accepted rows into the rows to write.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ATTRIBUTE_PLACEHOLDERS, product_name
from ..functions.numbering import allocate_codes, allocate_numbers
from ..functions.text import blank, date_or_null, int_or_null, number_or_null, text_key
from ..operators.ledger import BALANCE_KEY, all_lines_in, ledger_apply, roll_up_qty, signed_qty
from ..operators.lookup import keep_if, lookup, resolve
from ..operators.ordering import removed_rows, shared_rows
from ..operators.validate import Checked, Rule, differs, exceeds, flag_groups, in_file_duplicates, required, validate
from ..sources.tables import Tables


#: Characters of a piece that PO texts are looked up by.
GRAM = 4


def _staged(df: DataFrame, file_column: str, file: str | None, company_id=None) -> DataFrame:
    return keep_if(keep_if(df, file_column, file), "companyId", company_id)


def missing(c: str) -> Column:
    return F.col(c).isNull()


def unknown(label: str, id_column: str, key: str, when: Column | None = None) -> Rule:
    failed = missing(id_column) & ~blank(key)
    return Rule(f"{label} {{}} is not set up", failed if when is None else failed & when, F.col(key))


def _grams(text: str, size: Column) -> Column:
    """The distinct pieces of ``size`` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def orders_holding(staged: DataFrame, orders: DataFrame) -> DataFrame:
    """(company, customer, PO text) triples whose PO text occurs inside the PO text of an existing order.

    Only orders of staged customers are looked at.  Their texts are laid out by pieces of GRAM characters (shorter staged texts by their
    length), as far as staged texts have these pieces.  A staged text whose pieces don't all occur is on no order; of the
    others the rarest piece picks the orders that may hold it.  Only those are cut into pieces of the staged lengths, and both sides
    meet in an equi join, so a customer with very many orders makes no pairs.
    """
    by = ["companyId", "customerId"]
    asked = staged.where(~blank("customerPO")).select(*by, F.lower(F.trim("customerPO")).alias("_po")).distinct()
    size = F.least(F.length("_po"), F.lit(GRAM))
    # both kinds of pieces are written once and read several times, so what each join shuffles is on disk for that join only
    wanted = shared_rows(asked.select(*by, "_po", F.explode(_grams("_po", size)).alias("_gram")))
    sizes = wanted.groupBy(*by).agg(F.collect_set(F.length("_gram")).alias("_sizes"), F.collect_set(F.length("_po")).alias("_lengths"))  # at most GRAM sizes
    texts = orders.select(*by, F.lower(F.trim("customerPO")).alias("_text")).where(F.length("_text") > 0).distinct().join(sizes, by)
    pieces = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length("_text")), lambda n: _grams("_text", n)))
    postings = shared_rows(texts.select(*by, "_text", "_lengths", F.explode(pieces).alias("_gram")).join(wanted.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi"))
    found = postings.groupBy(*by, "_gram").agg(F.count(F.lit(1)).alias("_times"))
    rarest = wanted.join(found, [*by, "_gram"], "left").groupBy(*by, "_po").agg(F.min_by("_gram", F.struct("_times", "_gram")).alias("_gram"), F.bool_and(F.col("_times").isNotNull()).alias("_all"))
    likely = rarest.where("_all")
    candidates = postings.join(likely.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi").select(*by, "_text", "_lengths").distinct()
    cut = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("_text")), lambda n: _grams("_text", n)))
    held = shared_rows(candidates.select(*by, F.explode(F.array_distinct(cut)).alias("_po")).join(likely.select(*by, "_po"), [*by, "_po"], "left_semi").distinct())
    removed_rows(wanted, postings)
    return held


# --- sales orders ---------------------------------------------------------------------------------------------

def check_sales_order_file(t: Tables, as_of, file: str | None = None, strict: bool = True) -> Checked:
    rows = _staged(t.temp_SoFilelog, "fileLoaded", file).where(F.col("companyId").isNotNull() & ~(blank("customerName") & blank("customerPO")))
    rows = rows.withColumns({"_ship": date_or_null("shipDate"), "_qty": int_or_null("orderQty")})
    rows = resolve(rows, t.md_Customer, {"customerName": "customerName", "companyId": "companyId"}, "customerId", customerId="customerId")
    held = orders_holding(rows, t.soHeader)  # its size is known before the join: few are broadcast, and the rows stay where they are
    held = held.select(F.col("companyId").alias("_hc"), F.col("customerId").alias("_hk"), F.col("_po"), F.lit(True).alias("_held"))
    rows = rows.join(held, (F.col("companyId") == F.col("_hc")) & (F.col("customerId") == F.col("_hk"))
                     & (F.lower(F.trim("customerPO")) == F.col("_po")), "left").drop("_hc", "_hk", "_po")
    places = t.md_ShipToDestination
    rows = resolve(rows, places, {"destinationlabel": "locNo", "companyId": "companyId", "customerId": "customerId"}, "shipToId", _byCode="shipToId", _pod1="pod")
    rows = resolve(rows, places, {"destination": "shipToLabel", "companyId": "companyId", "customerId": "customerId"}, "shipToId", _byLabel="shipToId", _pod2="pod")
    rows = rows.withColumns({"shipToId": F.coalesce("_byCode", "_byLabel"), "pod": F.coalesce(F.when(F.col("_byCode").isNotNull(), F.col("_pod1")), "_pod2")}) \
        .drop("_byCode", "_pod1", "_byLabel", "_pod2")
    # what only rules need goes on as what they say and, where they fail, the key they name, so the rows are narrow when they meet the SKUs
    place = F.when(blank("destinationlabel"), F.col("destination")).otherwise(F.col("destinationlabel"))
    astray, portless = missing("shipToId") & F.col("customerId").isNotNull(), F.col("shipToId").isNotNull() & (F.coalesce("pod", F.lit(0)) == 0)
    unsound = missing("_qty") | (F.col("_qty") <= 0)
    rows = rows.withColumns({"_unnamed": blank("customerName"), "_name": F.when(missing("customerId"), F.col("customerName")), "_place": F.when(astray | portless, place),
                             "_amount": F.when(unsound, F.col("orderQty"))}).drop("customerName", "destinationlabel", "destination", "shipDate", "orderQty")
    skus = t.md_CustomerSku.where(F.col("statusflag") == 1)
    rows = resolve(rows, skus, {"customerSku": "customerSku", "companyId": "companyId", "customerId": "customerId", "csitemCode": "merchantSKU"}, "customerskuId",
                   customerskuId="customerskuId", invID="invID", csCost="csCost", currencyCode="currencyCode", tagDivision="tagDivision", EAN="EAN", _skuDesc="itemDesc")
    rules = [
        Rule("Customer name is required", F.col("_unnamed")), required("Customer PO", "customerPO"), required("Customer SKU", "customerSku"),
        Rule("Ship date is not a date", missing("_ship")),
        Rule("Customer PO {} has a ship date in the past", F.col("_ship") <= F.lit(as_of).cast("date"), F.col("customerPO")),
        Rule("Quantity {} is not a positive whole number", unsound, F.col("_amount")),
        unknown("Customer", "customerId", "_name"),
        Rule("Customer PO {} is already on an order", F.col("_held"), F.col("customerPO")),
        Rule("Destination {} is not set up", astray, F.col("_place")),
        Rule("Destination {} has no port", portless, F.col("_place")),
        Rule("Customer SKU {} is not set up", missing("customerskuId") & ~blank("customerSku") & F.col("customerId").isNotNull(), F.col("customerSku")),
    ]
    checked = validate(rows, rules, "sofilelog_Id", ["fileLoaded"], strict, carry=["invID"],
                       spent=["_unnamed", "_name", "_place", "_amount", "_held"])
    # no rule needs the items, so they are looked up for accepted rows only; a row whose item is listed twice has its errors twice
    items = t.md_Inventory.where(F.col("status") == 1)
    errors = lookup(checked.errors, items, {"invID": "invID"}).drop("invID")
    desc = F.when(~blank("ItemDescription"), F.col("ItemDescription")).when(~blank("_skuDesc"), F.col("_skuDesc")).otherwise(F.col("_itemDesc"))
    accepted = lookup(checked.accepted, items, {"invID": "invID"}, _itemDesc="itemDesc", modelNo="modelNo").select(
        "sofilelog_Id", "fileLoaded", "companyId", "customerId", "customerPO", "thirdPartyCustomer", "thirdPartyPO", "shipToId", "pod", F.col("_ship").alias("shipDate"),
        F.date_add("_ship", 7).alias("cancelDate"), "customerskuId", "customerSku", F.col("csitemCode").alias("merchantSku"), "EAN", "invID", "modelNo",
        desc.alias("soItemDesc"), "csCost", "currencyCode", "tagDivision", F.col("_qty").alias("orderQty"))
    return Checked(accepted, errors)


class OrderDocuments(NamedTuple):
    headers: DataFrame
    lines: DataFrame


def sales_order_documents(t: Tables, accepted: DataFrame, as_of) -> OrderDocuments:
    """One draft order per customer and PO; equal lines are summed."""
    by = ["companyId", "customerId", "customerPO"]
    heads = accepted.groupBy(*by).agg(F.min("shipToId").alias("shipToId"), F.min("pod").alias("portOfDestination"), F.min("shipDate").alias("earlyShipDate"),
                                      F.min("cancelDate").alias("lateShipDate"), F.min("thirdPartyCustomer").alias("thirdParty"), F.min("thirdPartyPO").alias("thirdPartyPO"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "SO", "companyId", ["customerId", "customerPO"], as_of, "_no")
    heads = heads.withColumns({"soName": F.concat(F.lit("tempSO_"), "_no"), "soDate": F.lit(as_of).cast("date"), "soStatus": F.lit(1105)}).drop("_no")
    lines = accepted.groupBy(*by, "invID", "customerskuId", "customerSku", "soItemDesc", "merchantSku", "EAN", "csCost", "currencyCode", "tagDivision", "modelNo") \
        .agg(F.sum("orderQty").alias("odrQty"))
    lines = lines.join(heads.select(*by, "soName"), by)
    reference = F.when(blank("merchantSku"), F.col("modelNo")).otherwise(F.col("merchantSku"))
    return OrderDocuments(heads, lines.withColumns({"itemReference1": reference, "soLineItemStatus": F.lit(1105)}).drop(*by, "modelNo"))


def merged_sales_order_documents(t: Tables, accepted: DataFrame, as_of) -> OrderDocuments:
    """One draft order per customer, ship date, third party and destination, with the list of its POs."""
    by = ["companyId", "customerId", "shipDate", "thirdPartyCustomer", "shipToId"]
    heads = accepted.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("customerPO")), ", ").alias("customerPO"), F.min("pod").alias("portOfDestination"),
                                      F.min("cancelDate").alias("lateShipDate"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "SO", "companyId", ["customerId", "shipDate", "thirdPartyCustomer", "shipToId"], as_of, "_no")
    heads = heads.withColumns({"soName": F.concat(F.lit("tempSO_"), "_no"), "soStatus": F.lit(1105)}).drop("_no")
    lines = accepted.groupBy(*by, "invID", "customerskuId", "customerSku", "soItemDesc", "merchantSku", "csCost", "currencyCode", "tagDivision") \
        .agg(F.sum("orderQty").alias("odrQty")).join(heads.select(*by, "soName"), by).drop(*by)
    return OrderDocuments(heads, lines)


# --- loading requests -----------------------------------------------------------------------------------------

def _request_rows(t: Tables, file, company_id) -> DataFrame:
    rows = _staged(t.temp_lrLog, "fileLoaded", file, company_id).where(~blank("poName"))
    rows = rows.withColumns({"_qty": int_or_null("lrQty"), "_seq": int_or_null("containerSeq"), "_ship": date_or_null("shipDate")})
    rows = resolve(rows, t.md_Port, {"pod": "portName"}, "portId", portId="portId")
    rows = resolve(rows, t.poHeader, {"poName": "poName", "companyId": "companyId"}, "poId", poId="poId", supplierId="supplierId")
    rows = lookup(rows, t.poLineItem, {"poId": "poId", "poDetailsId": "podetailsId"}, invID="invID", soLineItemId="soLineItemId", _open=F.col("qty") - F.col("lrQty"))
    types = t.md_MasterCategory.where(F.col("categoryParentID") == 3153)
    return resolve(rows, types, {"containerType": "categoryName"}, "categoryId", containerTypeId="categoryId")


def check_loading_request_file(t: Tables, as_of, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    staged = shared_rows(_request_rows(t, file, company_id))  # read once more per grouping
    scope = ["fileLoaded"]
    rows = flag_groups(staged, [
        (scope, {"_ports": differs("portId"), "_dates": differs("shipDate"), "_suppliers": differs("supplierId")}),
        ([*scope, "containerSeq"], {"_types": differs("containerTypeId"), "_notes": differs("notes")}),
        ([*scope, "poDetailsId"], {"_over": exceeds("_qty", "_open")})])
    rules = [
        required("Customer PO, port, supplier SKU, merchant SKU, quantity, ship date, container type and sequence, PO line", "customerPo", "pod", "supplierSku",
                 "merchantSku", "lrQty", "shipDate", "containerType", "containerSeq", "poDetailsId"),
        Rule("Quantity and container sequence must be positive whole numbers", missing("_qty") | (F.col("_qty") <= 0) | missing("_seq") | (F.col("_seq") <= 0)),
        Rule("A request has one port", F.col("_ports")),
        Rule("PO {} has a ship date in the past", F.col("_ship") <= F.lit(as_of).cast("date"), F.col("poName")),
        Rule("PO {} has different ship dates", F.col("_dates"), F.col("poName")),
        unknown("PO", "poId", "poName"),
        Rule("A request has one supplier", F.col("_suppliers")),
        Rule("PO line {} is not set up", F.col("poId").isNotNull() & missing("invID"), F.col("poDetailsId")),
        Rule("Supplier SKU {} asks for more than the open PO quantity", F.col("_over"), F.col("supplierSku")),
        Rule("Container type {} is not set up", missing("containerTypeId"), F.col("containerType")),
        Rule("Container sequence {} has more than one container type", F.col("_types"), F.col("containerSeq")),
        Rule("Container sequence {} has more than one note", F.col("_notes"), F.col("containerSeq")),
    ]
    checked = validate(rows, rules, "lrLogId", scope, strict)
    removed_rows(staged)
    accepted = lookup(checked.accepted, t.soLineItem, {"soLineItemId": "soLineItemId"}, soHeaderId="soHeaderId").select(
        "lrLogId", "fileLoaded", "companyId", "supplierId", "portId", "poId", "poDetailsId", "invID", "soHeaderId", "soLineItemId", "supplierSku",
        "containerTypeId", F.col("_seq").alias("containerSeq"), F.col("_qty").alias("qty"), F.col("_ship").alias("earlyShipDate"),
        F.date_add("_ship", 9).alias("lateShipDate"), F.date_sub("_ship", 2).alias("cargoReadyDate"), "notes", int_or_null("qtyPerCarton").alias("qtyPerCarton"))
    return Checked(accepted, checked.errors)


class RequestDocuments(NamedTuple):
    headers: DataFrame
    containers: DataFrame
    lines: DataFrame
    po_lines: DataFrame


def loading_request_documents(t: Tables, accepted: DataFrame, as_of) -> RequestDocuments:
    """One draft request per file with its containers and lines; PO lines take the requested quantity."""
    heads = accepted.groupBy("fileLoaded", "companyId").agg(F.min("supplierId").alias("supplierId"), F.min("earlyShipDate").alias("lrShipDate"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "LR", "companyId", ["fileLoaded"], as_of, "_no")
    heads = heads.withColumns({"lrName": F.concat(F.lit("tempLR_"), "_no"), "lrStatus": F.lit(2132)}).drop("_no")
    named = accepted.join(heads.select("fileLoaded", "lrName"), "fileLoaded")
    boxes = named.groupBy("lrName", "containerSeq").agg(*[F.min(c).alias(c) for c in ("containerTypeId", "portId", "earlyShipDate", "lateShipDate", "cargoReadyDate", "notes")]) \
        .withColumn("containerStatus", F.lit(2132))
    lines = named.select("lrName", "containerSeq", "soHeaderId", "soLineItemId", "poId", "poDetailsId", "supplierSku", "invID", "qty", "qtyPerCarton",
                         F.lit(0).alias("confirmQty"), F.lit(2132).alias("itemStatus"))
    return RequestDocuments(heads, boxes, lines, roll_up_qty(t.poLineItem, lines, "podetailsId", "lrQty", "qty", changes_key="poDetailsId"))


def partial_request_alerts(t: Tables, file: str | None = None, company_id=None) -> DataFrame:
    """PO lines a file would load only in part: asked quantity below the open quantity."""
    rows = _request_rows(t, file, company_id).where(F.col("_qty").isNotNull())
    asked = rows.groupBy("fileLoaded", "poId", "poDetailsId", "poName", "supplierSku").agg(F.sum("_qty").alias("newLrQty"), F.max("_open").alias("openLrQty"))
    return asked.where(F.col("newLrQty") < F.col("openLrQty"))


def check_loading_plan_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    rows = _staged(t.temp_loadingPlanningLog, "fileLoaded", file, company_id).where(~blank("containerType") & ~blank("containerSeq"))
    rows = rows.withColumns({"_qty": int_or_null("lrQty"), "_seq": int_or_null("containerSeq"), "_ship": date_or_null("shipDate")})
    types = t.md_MasterCategory.where(F.col("categoryParentID") == 3153)
    rows = resolve(rows, types, {"containerType": "categoryName"}, "categoryId", containerTypeId="categoryId")
    customers = t.md_Customer.where(F.col("status") == 1)
    rows = resolve(rows, customers, {"customerName": "customerName", "companyId": "companyId"}, "customerId", customerId="customerId")
    rows = resolve(rows, t.md_ShipToDestination, {"shipToLabel": "shipToLabel", "customerId": "customerId", "companyId": "companyId"}, "shipToId", shipToId="shipToId")
    skus = t.md_CustomerSku.where(F.col("statusflag") == 1)
    rows = resolve(rows, skus, {"merchantSku": "merchantSKU", "customerId": "customerId", "companyId": "companyId"}, "customerskuId", invID="invID")
    scope = ["fileLoaded"]
    rows = flag_groups(rows, [
        (scope, {"_customers": differs("customerId"), "_dates": differs("shipDate"), "_places": differs("shipToId")}),
        ([*scope, "containerSeq"], {"_types": differs("containerTypeId")})], written=True)
    rules = [
        required("Customer name, SKU, quantity, ship date and destination", "customerName", "merchantSku", "lrQty", "shipDate", "shipToLabel"),
        Rule("Container sequence and quantity must be positive whole numbers", missing("_qty") | (F.col("_qty") <= 0) | missing("_seq") | (F.col("_seq") <= 0)),
        Rule("Container type {} is not set up", missing("containerTypeId"), F.col("containerType")),
        Rule("Container sequence {} has more than one container type", F.col("_types"), F.col("containerSeq")),
        unknown("Customer", "customerId", "customerName"),
        Rule("A plan has one customer", F.col("_customers")), Rule("A plan has one ship date", F.col("_dates")),
        Rule("A plan has one destination", F.col("_places")),
        Rule("Merchant SKU {} is not set up", missing("invID") & F.col("customerId").isNotNull(), F.col("merchantSku")),
    ]
    checked = validate(rows, rules, "lrLogId", scope, strict)
    accepted = checked.accepted.select("lrLogId", "fileLoaded", "companyId", "containerTypeId", F.col("_seq").alias("containerSeq"), "customerId", "shipToId", "invID",
                                       F.col("_qty").alias("lrQty"), F.col("_ship").alias("shipDate"), F.date_add("_ship", 8).alias("lateShipDate"), "notes")
    return Checked(accepted, checked.errors)


# --- receipts -------------------------------------------------------------------------------------------------

def check_receipt_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    """Accepted delivery lines (with their delivery order's date); errors of both record types."""
    staged = _staged(t.temp_poReceivedLog, "fileName", file, company_id).where(~blank("recordType"))
    scope = ["fileName"]
    kind = F.upper(F.trim("recordType"))
    rows = staged.withColumns({"_kind": kind, "doNo": F.col("column1"), "_dl": kind == "DL", "_do": kind == "DO"})
    rows = rows.withColumns({"_date": F.when(F.col("_do"), date_or_null("column2")), "poName": F.when(F.col("_dl"), F.col("column2")),
                             "warehouseLabel": F.when(F.col("_dl"), F.col("column3")), "supplierSku": F.when(F.col("_dl"), F.col("column4")),
                             "_qtyText": F.when(F.col("_dl"), F.col("column5"))})
    rows = rows.withColumn("rcvQty", int_or_null("_qtyText"))
    sides = rows.where(~blank("doNo")).groupBy(*scope, text_key("doNo").alias("_no")).agg(
        F.bool_or("_do").alias("_hasDo"), F.bool_or("_dl").alias("_hasDl"), F.max("_date").alias("_doDate"), F.max(F.when(F.col("_do"), F.col("column3"))).alias("_doNotes"),
        F.count_distinct(text_key("warehouseLabel")).alias("_labels"))
    rows = rows.withColumn("_no", text_key("doNo")).join(sides, [*scope, "_no"], "left")
    rows = resolve(rows, t.md_Warehouse.where(F.col("status") == 1), {"warehouseLabel": "label", "companyId": "companyId"}, "warehouseId", warehouseId="warehouseId")
    rows = resolve(rows, t.poHeader, {"poName": "poName", "companyId": "companyId"}, "poId", poId="poId", supplierId="supplierId")
    rows = resolve(rows, t.poLineItem, {"poId": "poId", "supplierSku": "supplierSku"}, "podetailsId", poDetailsId="podetailsId", invId="invID", _poQty="qty", _poRcv="rcvQty")
    used = t.poReceivedHeader.select(text_key("supplierDO").alias("_uno"), F.col("supplierId").alias("_us"), F.col("companyId").alias("_uc"), F.lit(True).alias("_used")).distinct()
    rows = rows.join(used, (F.col("_no") == F.col("_uno")) & (F.col("supplierId") == F.col("_us")) & (F.col("companyId") == F.col("_uc")), "left").drop("_uno", "_us", "_uc")
    rows = rows.withColumn("_openQty", F.col("_poQty") - F.col("_poRcv"))
    met = shared_rows(rows)  # read once more for the open quantities
    rows = flag_groups(met, [([*scope, "poDetailsId"], {"_over": exceeds("rcvQty", "_openQty")})])
    rules = [
        Rule("Record type {} is neither DO nor DL", ~F.col("_kind").isin("DO", "DL"), F.col("recordType")),
        required("Delivery order number", "doNo"),
        Rule("Delivery order date is required", F.col("_do") & blank("column2")),
        Rule("Warehouse, PO, supplier SKU and quantity are required", F.col("_dl") & (blank("warehouseLabel") | blank("poName") | blank("supplierSku") | blank("_qtyText"))),
        Rule("Delivery order date is not a date", F.col("_do") & ~blank("column2") & missing("_date")),
        Rule("Quantity {} is not a whole number", F.col("_dl") & ~blank("_qtyText") & missing("rcvQty"), F.col("_qtyText")),
        Rule("Delivery order {} lacks its DO or DL rows", ~(F.col("_hasDo") & F.col("_hasDl")), F.col("doNo")),
        unknown("Warehouse", "warehouseId", "warehouseLabel"),
        Rule("Delivery order {} names more than one warehouse", F.col("_dl") & (F.col("_labels") > 1), F.col("doNo")),
        unknown("PO", "poId", "poName"),
        Rule("Supplier SKU {} is not on the PO", F.col("poId").isNotNull() & missing("poDetailsId") & ~blank("supplierSku"), F.col("supplierSku")),
        Rule("Supplier SKU {} is received beyond the PO quantity", F.col("_over"), F.col("supplierSku")),
        Rule("Delivery order {} was received before", F.col("_used"), F.col("doNo")),
    ]
    checked = validate(rows, rules, "poReceivedLogId", scope, strict)
    removed_rows(met)
    accepted = checked.accepted.where(F.col("_dl")).select("poReceivedLogId", "fileName", "companyId", "doNo", F.col("_doDate").alias("doDate"), F.col("_doNotes").alias("doNotes"),
                                                           "poId", "poDetailsId", "supplierId", "warehouseId", "invId", "supplierSku", "rcvQty", F.col("column6").alias("notes"))
    return Checked(accepted, checked.errors)


class ReceiptDocuments(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    movements: DataFrame
    balances: DataFrame
    po_lines: DataFrame
    po_headers: DataFrame


def receive(t: Tables, received: DataFrame, key: list[str], as_of=None) -> ReceiptDocuments:
    """Receipts per delivery order -> documents, ledger rows, balances, PO quantities and closings.

    ``received`` holds companyId, supplierId, warehouseId, poId, poDetailsId, invId, supplierSku, rcvQty, notes, doDate and the ``key`` columns.
    """
    heads = received.groupBy("companyId", *key).agg(F.min("supplierId").alias("supplierId"), F.min("warehouseId").alias("warehouseId"), F.min("doDate").alias("poRcvDate")) \
        .withColumn("poRcvStatus", F.lit(3159))
    lines = received.select(*key, "poDetailsId", "warehouseId", "supplierSku", "rcvQty", "notes", F.lit(3159).alias("poRcvLineItemStatus"))
    moves = received.select("warehouseId", "companyId", "invId", F.lit("DO").alias("action"), F.col("poId").cast("string").alias("actionKey"), F.col("rcvQty").alias("qty"))
    balances = ledger_apply(moves, t.inventoryBalanceWH)
    po_lines = close_received_lines(t.poLineItem, received)
    touched = received.select("poId").distinct()
    done = all_lines_in(po_lines.join(touched, "poId", "left_semi"), "poId", "itemStatus", (1086, 1087), "_done")
    heads_after = lookup(t.poHeader, done, {"poId": "poId"}, _done="_done") \
        .withColumn("poStatus", F.when(F.col("_done"), 1087).otherwise(F.col("poStatus"))).drop("_done")
    return ReceiptDocuments(heads, lines, moves, balances, po_lines, heads_after)


def close_received_lines(po_lines: DataFrame, received: DataFrame) -> DataFrame:
    """PO lines with the received quantity added; fully received lines close, notes are appended."""
    sums = received.groupBy(F.col("poDetailsId").alias("_line")).agg(F.sum("rcvQty").alias("_rcv"), F.array_join(F.array_sort(F.collect_set("notes")), ", ").alias("_notes"))
    joined = po_lines.join(sums, F.col("podetailsId") == F.col("_line"), "left")
    total = F.col("rcvQty") + F.coalesce("_rcv", F.lit(0))
    note = F.when(F.col("_rcv").isNull() | blank("_notes"), F.col("itemNote")).when(blank("itemNote"), F.col("_notes")).otherwise(F.concat("itemNote", F.lit(", "), "_notes"))
    status = F.when(F.col("_rcv").isNotNull() & (total == F.col("qty")), 1087).otherwise(F.col("itemStatus"))
    return joined.withColumns({"itemNote": note, "itemStatus": status, "rcvQty": total.cast("int")}).drop("_line", "_rcv", "_notes")


# --- stock movements ------------------------------------------------------------------------------------------

# Movement actions that need a shipment and order, and the one that needs a reason.
SHIPMENT_ACTIONS = (2152, 2153, 2155)
REASON_ACTION = 2154


def check_movement_file(t: Tables, file: str | None = None, strict: bool = True) -> Checked:
    rows = _staged(t.temp_inventoryMovementLog, "fileLoaded", file).where(F.col("companyId").isNotNull())
    rows = resolve(rows, t.md_Warehouse.where(F.col("status") == 1), {"warehouseLabel": "label", "companyId": "companyId"}, "warehouseId", warehouseId="warehouseId")
    actions = t.md_MasterCategory.where((F.col("categoryParentID") == 2151) & (F.col("status") == 1))
    rows = resolve(rows, actions, {"action": "categoryName"}, "categoryId", actionId="categoryId")
    rows = resolve(rows, t.md_Inventory, {"inventorySku": "inventorySKU", "companyId": "companyId"}, "invID", invId="invID")
    rules = [
        required("Warehouse", "warehouseLabel"), required("Action", "action"), required("Item SKU", "inventorySku"), Rule("Quantity is required", missing("qty")),
        unknown("Warehouse", "warehouseId", "warehouseLabel"), unknown("Action", "actionId", "action"),
        Rule("Shipment and order are required for action {}", F.col("actionId").isin(*SHIPMENT_ACTIONS) & (blank("shipId") | blank("orderNo")), F.col("action")),
        Rule("A reason is required for action {}", (F.col("actionId") == REASON_ACTION) & blank("reason"), F.col("action")),
        unknown("Item SKU", "invId", "inventorySku"),
    ]
    checked = validate(rows, rules, "invMovementLog_Id", ["fileLoaded"], strict)
    accepted = checked.accepted.select("invMovementLog_Id", "fileLoaded", "warehouseId", "companyId", F.upper("action").alias("action"), "shipId", "orderNo", "invId", "qty",
                                       "reason", "enterBy", "enterDate")
    return Checked(accepted, checked.errors)


class MovementDocuments(NamedTuple):
    movements: DataFrame
    balances: DataFrame
    shipment_lines: DataFrame


def movement_documents(t: Tables, accepted: DataFrame) -> MovementDocuments:
    """Ledger rows, balances after them, and shipped quantities adjusted by shipment, order and item."""
    moves = accepted.withColumn("_signed", signed_qty())
    balances = ledger_apply(moves.select(*BALANCE_KEY, F.col("_signed").alias("qty")), t.inventoryBalanceWH)
    ships = t.shipmentHeader.select(F.col("shipmentId"), F.col("shipId"), F.col("soName").alias("orderNo"), F.col("companyId"))
    delta = moves.where(~blank("shipId")).join(ships, ["shipId", "orderNo", "companyId"]).groupBy("shipmentId", "invId").agg(F.sum("_signed").alias("_adj"))
    lines = t.shipmentLineItem.join(delta, ["shipmentId", "invId"], "left") \
        .withColumn("shipQty", (F.col("shipQty") + F.coalesce("_adj", F.lit(0))).cast("int")).drop("_adj")
    return MovementDocuments(accepted.select(*[c for c in accepted.columns if c != "fileLoaded"]), balances, lines)


# --- items ----------------------------------------------------------------------------------------------------

GROSS = ("grossWeight", "grossLength", "grossWidth", "grossHeight")
NET = ("netWeight", "netLength", "netWidth", "netHeight")


def _item_rows(t: Tables, file, company_id) -> DataFrame:
    rows = _staged(t.temp_inventoryLog, "fileName", file, company_id).where(~(blank("productCategory") & blank("productSubCategory") & blank("productType")))
    categories = t.md_InventoryCategory.where(F.col("status") == 1)
    rows = resolve(rows, categories.where(F.col("prodCategoryParentID") == 1), {"productCategory": "prodCategoryName"}, "prodCategoryId",
                   productCategoryId="prodCategoryId", _categoryCode="prodCategoryCode")
    rows = resolve(rows, categories, {"productSubCategory": "prodCategoryName", "productCategoryId": "prodCategoryParentID"}, "prodCategoryId",
                   productSubCategoryId="prodCategoryId", _subCode="prodCategoryCode", isBuffer="isBuffer")
    rows = resolve(rows, t.md_inventoryType.where(F.col("status") == 1), {"productType": "inventoryType", "productSubCategoryId": "prodCategoryId"}, "inventoryTypeId",
                   productTypeId="inventoryTypeId", _template="namingConvention")
    units = t.md_MasterCategory.where((F.col("categoryParentID") == 1069) & (F.col("status") == 1))
    rows = resolve(rows, units, {"measurement": "categoryName"}, "categoryId", measurementId="categoryId")
    rows = resolve(rows, t.md_Inventory, {"itemCode": "itemCode"}, "invID", _existing="invID")
    coded = in_file_duplicates(rows.withColumn("_code", F.when(~blank("itemCode"), F.col("itemCode"))), ["fileName", "_code"], "_twice")
    return coded.withColumn("_twice", F.col("_twice") & ~blank("itemCode")).drop("_code")


def _numeric(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (~blank(c) & number_or_null(c).isNull())
    return bad


def _item_rules() -> list[Rule]:
    return [
        Rule("Item code {} occurs more than once in the file", F.col("_twice"), F.col("itemCode")),
        Rule("Item code {} exists already", F.col("_existing").isNotNull() & ~blank("itemCode"), F.col("itemCode")),
        required("Category", "productCategory"), required("Sub-category", "productSubCategory"), required("Model", "modelNo"), required("Item SKU", "inventorySKU"),
        required("Gross weight and size", *GROSS), Rule("Gross weight and size must be numbers", _numeric(*GROSS)),
        required("Net weight and size", *NET), Rule("Net weight and size must be numbers", _numeric(*NET)),
        required("CBM", "cbm"), Rule("CBM must be a number", _numeric("cbm")), required("Unit", "measurement"),
        unknown("Category", "productCategoryId", "productCategory"),
        Rule("Sub-category {} is not set up", F.col("productCategoryId").isNotNull() & missing("productSubCategoryId"), F.col("productSubCategory")),
        Rule("Type {} is not set up", F.col("productSubCategoryId").isNotNull() & missing("productTypeId"), F.col("productType")),
        unknown("Unit", "measurementId", "measurement"),
    ]


_ITEM_COLUMNS = ["logId", "fileName", "companyId", "itemCode", "productCategoryId", "productSubCategoryId", "productTypeId", "modelNo", "inventorySKU", "productName", "itemDesc",
                 "grossWeight", "netWeight", "cbm", "measurementId", "isVirtual", "isBuffer", "status"]


def _typed_items(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: number_or_null(c).cast("int") for c in ("grossWeight", "netWeight", "cbm")}) \
        .withColumns({"isVirtual": F.when(F.col("virtualProduct") == "Y", 1).otherwise(0), "status": F.lit(1)}).select(*_ITEM_COLUMNS)


def check_item_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    """Items with a given code and name."""
    rows = _item_rows(t, file, company_id)
    rules = [required("Item code", "itemCode"), required("Product name", "productName"), *_item_rules()]
    checked = validate(rows, rules, "logId", ["fileName"], strict)
    named = checked.accepted.withColumn("itemDesc", F.when(blank("description"), F.col("productName")).otherwise(F.col("description")))
    return Checked(_typed_items(named), checked.errors)


def item_file_attributes(t: Tables, accepted: DataFrame) -> DataFrame:
    """Attribute rows of loaded items: colour, packing and size where given."""
    staged = t.temp_inventoryLog.select("logId", "color", "packaging", "size")
    rows = accepted.select("logId", "itemCode").join(staged, "logId")
    pairs = F.array(*[F.struct(F.lit(k).alias("categoryId"), F.col(c).alias("value")) for k, c in ((3194, "color"), (1123, "packaging"), (3187, "size"))])
    return rows.select("itemCode", F.inline(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")))


def _staged_attributes(t: Tables, rows: DataFrame) -> DataFrame:
    """(logId, attributeName, attributeValue) from the numbered name/value column pairs."""
    n = max(int(c.rsplit("_", 1)[1]) for c in rows.columns if c.startswith("attributeName_"))
    pairs = F.array(*[F.struct(F.upper(f"attributeName_{i}").alias("attributeName"), F.upper(f"attributeValue_{i}").alias("attributeValue")) for i in range(1, n + 1)])
    attrs = rows.select("logId", F.inline(pairs)).where(~blank("attributeName"))
    known = t.md_MasterCategory.where((F.col("categoryParentID") == 18) & (F.col("status") == 1))
    return resolve(attrs, known, {"attributeName": "categoryName"}, "categoryId", categoryId="categoryId")


def check_product_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    """Items whose name comes from the type's template and whose blank codes are allocated."""
    rows = _item_rows(t, file, company_id)
    attrs = _staged_attributes(t, rows)
    marks = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in ATTRIBUTE_PLACEHOLDERS.items()]))
    wide = attrs.withColumn("_mark", F.element_at(marks, F.col("attributeName"))).groupBy("logId").agg(
        F.min(F.when(F.col("categoryId").isNull(), F.col("attributeName"))).alias("_badAttribute"),
        *[F.max(F.when(F.col("_mark") == m, F.col("attributeValue"))).alias(f"_a_{m}") for m in dict.fromkeys(ATTRIBUTE_PLACEHOLDERS.values())])
    rows = rows.join(wide, "logId", "left")
    values = {m: F.col(f"_a_{m}") for m in dict.fromkeys(ATTRIBUTE_PLACEHOLDERS.values())}
    values |= {"modelno": F.upper("modelNo"), "netlength": F.col("netLength"), "netwidth": F.col("netWidth"), "netheight": F.col("netHeight"),
               "inventorytype": F.upper("productType")}
    rows = rows.withColumn("productName", product_name(F.col("_template"), values))
    names = t.md_Inventory.where(F.col("status") == 1)
    rows = resolve(rows, names, {"productName": "productName", "companyId": "companyId"}, "invID", _sameName="invID")
    rules = [*_item_rules(), required("Type", "productType"),
             Rule("Attribute {} is not set up", F.col("_badAttribute").isNotNull(), F.col("_badAttribute")),
             Rule("Type {} has no naming template", F.col("productTypeId").isNotNull() & blank("_template"), F.col("productType")),
             Rule("Product name {} exists already", F.col("_sameName").isNotNull() & ~blank("productName"), F.col("productName"))]
    checked = validate(rows, rules, "logId", ["fileName"], strict)
    accepted = checked.accepted.withColumn("itemDesc", F.when(blank("description"), F.col("productName")).otherwise(F.upper("description")))
    blank_code = accepted.where(blank("itemCode"))
    used = t.md_Inventory.select("itemCode").unionByName(accepted.where(~blank("itemCode")).select("itemCode"))
    given = allocate_codes(blank_code, used, "itemCode", "_subCode", ["logId"], 4)
    given = given.withColumn("itemCode", F.col("newCode")).drop("newCode")
    return Checked(_typed_items(accepted.where(~blank("itemCode")).unionByName(given)), checked.errors)


def check_bom_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    """Components: numeric quantity, no components yet for the item, both codes known."""
    rows = keep_if(t.temp_rawBomLog, "fileName", file)
    items = keep_if(t.md_Inventory.where(F.col("status") == 1), "companyId", company_id)
    rows = resolve(rows, items, {"upc": "itemCode"}, "invID", invId="invID", companyId="companyId")
    rows = resolve(rows, items, {"rawBomUpc": "itemCode"}, "invID", rawBomInvId="invID")
    rows = lookup(rows, t.rawBom.select("invId").distinct().withColumn("_has", F.lit(True)), {"invId": "invId"}, _has="_has")
    rows = rows.withColumn("_qty", number_or_null("rawBomQty"))
    rules = [Rule("Quantity {} is not a number", missing("_qty"), F.col("rawBomQty")), Rule("Item {} has components already", F.col("_has"), F.col("upc")),
             unknown("Item", "invId", "upc"), unknown("Component", "rawBomInvId", "rawBomUpc")]
    checked = validate(rows, rules, "rawBomLogId", ["fileName"], strict)
    return Checked(checked.accepted.select("rawBomLogId", "fileName", "companyId", "invId", "rawBomInvId", F.col("_qty").cast("int").alias("rawBomQty"), F.lit(1).alias("status")),
                   checked.errors)


# --- SKUs -----------------------------------------------------------------------------------------------------

def _described(item_desc: str = "itemDesc") -> Column:
    fallback = F.when(blank("_itemDesc"), F.col("_itemName")).otherwise(F.col("_itemDesc"))
    return F.when(blank(item_desc), fallback).otherwise(F.col(item_desc))


def check_customer_sku_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    rows = _staged(t.temp_customerSkuLog, "fileLoaded", file, company_id).where(~blank("customerName") & ~blank("inventorySku"))
    rows = resolve(rows, t.md_Customer.where(F.col("status") == 1), {"customerName": "customerName", "companyId": "companyId"}, "customerId", customerId="customerId")
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = resolve(rows, items, {"inventorySku": "inventorySKU"}, "invID", invID="invID", _itemDesc="itemDesc", _itemName="productName")
    active = t.md_CustomerSku.where(F.col("statusflag") == 1)
    rows = resolve(rows, active, {"customerSku": "customerSku", "merchantSku": "merchantSKU", "customerId": "customerId", "companyId": "companyId"}, "customerskuId",
                   _existing="customerskuId")
    currencies = t.md_MasterCategory.where(F.col("categoryParentID") == 1119)
    rows = resolve(rows, currencies, {"currencyCode": "categoryName"}, "categoryId", _currency="categoryId")
    rows = in_file_duplicates(rows, ["fileLoaded", "customerSku", "merchantSku"], "_twice")
    pair = F.concat("customerSku", F.lit(" / "), "merchantSku")
    rules = [
        required("Customer name, item SKU, customer SKU, merchant SKU and currency", "customerName", "inventorySku", "customerSku", "merchantSku", "currencyCode"),
        unknown("Customer", "customerId", "customerName"), unknown("Item SKU", "invID", "inventorySku"),
        Rule("Customer SKU {} occurs more than once in the file", F.col("_twice"), pair), Rule("Customer SKU {} exists already", F.col("_existing").isNotNull(), pair),
        unknown("Currency", "_currency", "currencyCode"),
    ]
    checked = validate(rows, rules, "customerSkuLog", ["fileLoaded"], strict)
    accepted = checked.accepted.select("customerSkuLog", "fileLoaded", "invID", "customerId", "companyId", "customerSku", "merchantSku", _described().alias("itemDesc"),
                                       F.col("_currency").alias("currencyCode"), number_or_null("customerCost").cast("int").alias("csCost"), F.lit(1).alias("statusflag"))
    return Checked(accepted, checked.errors)


def check_supplier_sku_file(t: Tables, file: str | None = None, company_id=None, strict: bool = True) -> Checked:
    rows = _staged(t.temp_supplierSkuLog, "fileLoaded", file, company_id).where(~blank("supplierName") & ~blank("inventorySku"))
    currencies = t.md_MasterCategory.where(F.col("categoryParentID") == 1119)
    suppliers = lookup(t.md_Supplier.where(F.col("status") == 1), currencies, {"currencyCode": "categoryId"}, "inner", _name="categoryName")
    rows = resolve(rows, suppliers, {"supplierName": "supplierCompanyName", "companyId": "companyId"}, "supplierId", supplierId="supplierId", _own="_name")
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = resolve(rows, items, {"inventorySku": "inventorySKU"}, "invID", invId="invID", _itemDesc="itemDesc", _itemName="productName")
    active = t.md_SupplierSku.where(F.col("statusflag") == 1)
    rows = resolve(rows, active, {"companyId": "companyId", "supplierId": "supplierId", "invId": "invId"}, "supplierskuId", _assigned="supplierskuId")
    rows = resolve(rows, active, {"companyId": "companyId", "supplierId": "supplierId", "supplierSku": "supplierSku"}, "supplierskuId", _existing="supplierskuId")
    rows = resolve(rows, currencies, {"currencyCode": "categoryName"}, "categoryId", _currency="categoryId")
    flag = F.upper(F.trim("isDefault"))
    rules = [
        required("Supplier name, item SKU, supplier SKU, currency, MOQ and default flag", "supplierName", "inventorySku", "supplierSku", "currencyCode", "moq", "isDefault"),
        Rule("Default flag {} is neither YES nor NO", ~blank("isDefault") & ~flag.isin("YES", "NO"), F.col("isDefault")),
        unknown("Supplier", "supplierId", "supplierName"), unknown("Item SKU", "invId", "inventorySku"),
        Rule("Item SKU {} has a supplier SKU already", F.col("_assigned").isNotNull(), F.col("inventorySku")),
        Rule("Supplier SKU {} exists already", F.col("_existing").isNotNull(), F.col("supplierSku")), unknown("Currency", "_currency", "currencyCode"),
        Rule("Currency {} differs from the supplier's", F.col("_currency").isNotNull() & (text_key("_own") != text_key("currencyCode")), F.col("currencyCode")),
    ]
    checked = validate(rows, rules, "supplierSkuLog", ["fileLoaded"], strict)
    accepted = checked.accepted.select("supplierSkuLog", "fileLoaded", "invId", "supplierId", "companyId", "supplierSku", _described().alias("itemDesc"),
                                       F.col("_currency").alias("currencyCode"), number_or_null("supplierCost").cast("int").alias("supCost"), int_or_null("moq").alias("moq"),
                                       F.when(flag == "YES", 1).otherwise(0).alias("isDefault"), F.lit(1).alias("statusflag"))
    return Checked(accepted, checked.errors)


def missing_balances(t: Tables) -> DataFrame:
    """Zero balances for each item and warehouse of its company that has none."""
    pairs = t.md_Inventory.select("companyId", F.col("invID").alias("invId")).join(t.md_Warehouse.select("companyId", "warehouseId"), "companyId")
    return pairs.join(t.inventoryBalanceWH, ["invId", "warehouseId"], "left_anti") \
        .select("companyId", "warehouseId", "invId", F.lit(0).alias("balanceQty"), F.lit(0).alias("lockQty"))
