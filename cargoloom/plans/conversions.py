"""Documents made from documents, and quantities rolled back onto their sources.

All groups are converted in one pass: a group is an aggregate and its number an
ordinal, so no loop over documents is needed.  Functions return the rows to add
and the changed rows of the tables they touch.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import allocate_numbers
from ..functions.payload import parse_payload
from ..functions.text import blank
from ..operators.admission import unserved
from ..operators.history import audit_feed
from ..operators.ledger import BALANCE_KEY, ledger_apply, release
from ..operators.lookup import config_value, keep_if, lookup, rate_at
from ..operators.ordering import removed_rows, shared_rows
from ..operators.validate import Rule, differs, exceeds, flag_groups, flag_rows, validate
from ..sources.tables import Tables
from .loads import ReceiptDocuments, receive
from .transitions import LR, PO, SO, UNTAGGED, WO
from .views import present


def add_qty(lines: DataFrame, changes: DataFrame, key: str, column: str, delta: str, sign: int = 1, changes_key: str | None = None, **sets: Column) -> DataFrame:
    """Only the lines that change, with the summed change on a quantity; ``sets`` may use the new quantity."""
    sums = changes.groupBy(F.col(changes_key or key).alias("_rk")).agg(F.sum(delta).alias("_delta"))
    changed = lines.join(sums, F.col(key) == F.col("_rk")).withColumn(column, (F.col(column) + sign * F.col("_delta")).cast(lines.schema[column].dataType))
    return (changed.withColumns(sets) if sets else changed).select(*lines.columns)


def main_warehouse(t: Tables) -> DataFrame:
    """The lowest warehouse id of each company."""
    return t.md_Warehouse.groupBy("companyId").agg(F.min("warehouseId").alias("warehouseId"))


# --- order -> purchase order ----------------------------------------------------------------------------------

class PurchaseOrders(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    refreshed: DataFrame
    refreshed_lines: DataFrame
    so_lines: DataFrame
    so_headers: DataFrame
    errors: DataFrame
    added_lines: DataFrame
    relinked: DataFrame


def convert_to_purchase_orders(t: Tables, requests: DataFrame, as_of) -> PurchaseOrders:
    """Approved orders with open quantity -> one PO per order, or a refresh of the PO the order has.

    The rate is the one valid on the day for the company and the currency pair;
    a missing rate, price or currency is an error.  Requests are (requestId, soHeaderId).  Lines that an order
    gained after its PO was made are ``added_lines`` of that PO.  ``relinked`` names the request lines (lrDetailsId, soLineItemId,
    poName) whose order line got a line of a new PO; its id is the store's business.
    """
    rows = requests.join(t.soHeader, "soHeaderId")
    lines = t.soLineItem.where((F.col("odrQty") - F.col("poQty") > 0) & (F.col("soLineItemStatus") == SO["approved"])) \
        .select("soLineItemId", F.col("soHeaderId").alias("_h"), "invID", (F.col("odrQty") - F.col("poQty")).alias("openQty"), F.col("merchantSku").alias("_merchant"),
                F.col("customerSku").alias("merchantSku"), "EAN")
    rows = rows.join(lines, F.col("soHeaderId") == F.col("_h"), "left").drop("_h")
    skus = t.md_SupplierSku.where(F.col("statusflag") == 1)
    rows = lookup(rows, skus, {"companyId": "companyId", "supplierId": "supplierId", "invID": "invId"}, supplierskuId="supplierskuId", supplierSku="supplierSku",
                  supCost="supCost", _skuCurrency="currencyCode", _skuDesc="itemDesc")
    rows = lookup(rows, t.md_MasterCategory, {"_skuCurrency": "categoryId"}, currencyCode="categoryName")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, itemCode="itemCode", _sku="inventorySKU", _itemDesc="itemDesc")
    rows = config_value(rows, t.md_DefaultConfig, "companyId", "DefaultCurrency", "homeCurrency").withColumns({"foreignCurrency": F.lit("USD"), "_today": F.lit(as_of).cast("date")})
    rows = rate_at(rows, t.md_CurrencyRate, "companyId", "homeCurrency", "foreignCurrency", "_today", "_rate")
    name = F.col("soName")
    checked = validate(rows, [
        Rule("{} is not approved", F.col("soStatus") != SO["approved"], name), Rule("{} has nothing open", F.col("soLineItemId").isNull(), name),
        Rule("Supplier SKU for {} is not set up", F.col("soLineItemId").isNotNull() & F.col("supplierSku").isNull(), F.col("_sku")),
        Rule("{} has no currency rate", F.col("_rate").isNull(), name)], "soHeaderId", ["requestId"])
    good = checked.accepted
    existing = t.poHeader.groupBy("poReferenceId").agg(F.min("poId").alias("_poId"))
    good = lookup(good, existing, {"soName": "poReferenceId"}, _poId="_poId")
    home_cost = F.col("supCost") * F.col("_rate")
    desc = F.when(blank("_skuDesc"), F.col("_itemDesc")).otherwise(F.col("_skuDesc"))
    item = ["soLineItemId", "invID", "itemCode", "supplierskuId", "supplierSku", "currencyCode", "EAN", "merchantSku"]
    detail = good.select("soHeaderId", "companyId", "soName", "_poId", *item, F.col("supCost").alias("unitPrice"), home_cost.alias("homeCurrencyCost"), desc.alias("poItemDesc"),
                         F.col("_merchant").alias("itemReference1"), F.col("openQty").alias("qty"), F.lit(PO["draft"]).alias("itemStatus"))
    fresh = good.where(F.col("_poId").isNull())
    heads = fresh.groupBy("soHeaderId", "companyId", "supplierId", F.col("soName").alias("poReferenceId"), "shipToId", "portOfLanding", "portOfDestination", "earlyShipDate", "lateShipDate",
                          "foreignCurrency", "homeCurrency", F.col("_rate").alias("foreignCurrencyRate"), F.col("customerPO").alias("reference1"), F.col("thirdPartyPO").alias("reference2")) \
        .agg(F.sum(F.col("openQty") * F.col("supCost")).alias("poNetTotal"), F.sum("openQty").alias("poQty"))
    heads = allocate_numbers(lookup(heads, main_warehouse(t), {"companyId": "companyId"}, warehouseId="warehouseId"), t.md_SequenceNumber, "PO", "companyId", ["soHeaderId"], as_of, "poName") \
        .withColumn("poStatus", F.lit(PO["draft"]))
    new_lines = detail.where(F.col("_poId").isNull()).join(heads.select("soHeaderId", "poName"), "soHeaderId").drop("soHeaderId", "companyId", "soName", "_poId")
    # orders that have a PO: its header takes the order's dates and references, its lines the order quantity
    again = good.where(F.col("_poId").isNotNull()).select(F.col("_poId").alias("poId"), *[F.col(c).alias(f"_{c}") for c in (
        "earlyShipDate", "lateShipDate", "customerPO", "shipToId", "portOfLanding", "portOfDestination", "soNote")]).distinct()
    refreshed = t.poHeader.join(again, "poId").withColumns({"poEarlyShipDate": F.col("_earlyShipDate"), "poLateShipDate": F.col("_lateShipDate"), "reference1": F.col("_customerPO"),
                                                            "shipToId": F.col("_shipToId"), "poStatus": F.lit(PO["draft"]), "poNote": F.col("_soNote")}).select(*t.poHeader.columns)
    ordered = t.soLineItem.select(F.col("soLineItemId").alias("_sl"), F.col("odrQty").alias("_odr"))
    refreshed_lines = t.poLineItem.join(again.select("poId"), "poId", "left_semi").join(ordered, F.col("soLineItemId") == F.col("_sl")) \
        .withColumns({"qty": F.col("_odr"), "itemStatus": F.lit(PO["draft"])}).select(*t.poLineItem.columns)
    # order lines without any PO line, gained after the PO was made
    on_pos = t.poLineItem.where(F.col("soLineItemId").isNotNull()).select("soLineItemId")
    added_lines = lookup(detail.where(F.col("_poId").isNotNull()).join(on_pos, "soLineItemId", "left_anti"), t.poHeader, {"_poId": "poId"}, poName="poName") \
        .select(F.col("_poId").alias("poId"), *new_lines.columns)
    relinked = t.lrLineItem.select("lrDetailsId", "soLineItemId").join(new_lines.select("soLineItemId", "poName"), "soLineItemId").select("lrDetailsId", "soLineItemId", "poName")
    taken = new_lines.select("soLineItemId", "qty").unionByName(refreshed_lines.select("soLineItemId", "qty")).unionByName(added_lines.select("soLineItemId", "qty"))
    # a refreshed PO line carries the whole order quantity, so the ordered quantity is what is on POs now
    on_po = taken.groupBy(F.col("soLineItemId").alias("_sl")).agg(F.sum("qty").alias("_q"))
    so_lines = t.soLineItem.join(on_po, F.col("soLineItemId") == F.col("_sl")).withColumn("poQty", F.least(F.col("poQty") + F.col("_q"), F.col("odrQty")).cast("int"))
    done = F.col("odrQty") == F.col("poQty")
    so_lines = so_lines.withColumn("soLineItemStatus", F.when(done & (F.col("odrQty") == 0), SO["cancelled"]).when(done, SO["production"]).otherwise(F.col("soLineItemStatus"))) \
        .select(*t.soLineItem.columns)
    touched = good.select("soHeaderId").distinct()
    after = t.soLineItem.join(touched, "soHeaderId", "left_semi").select("soLineItemId", "soHeaderId", "odrQty", "poQty") \
        .join(so_lines.select(F.col("soLineItemId").alias("_sl"), F.col("poQty").alias("_po")), F.col("soLineItemId") == F.col("_sl"), "left")
    open_left = after.groupBy("soHeaderId").agg(F.sum(F.col("odrQty") - F.coalesce("_po", "poQty")).alias("_open")).where(F.col("_open") == 0).select("soHeaderId")
    so_heads = t.soHeader.join(open_left, "soHeaderId", "left_semi").withColumn("soStatus", F.lit(SO["production"]))
    return PurchaseOrders(heads, new_lines, refreshed, refreshed_lines, so_lines, so_heads, checked.errors, added_lines, relinked)


# --- purchase order -> the internal supplier's order -----------------------------------------------------------

class InternalOrders(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    updated_lines: DataFrame
    po_headers: DataFrame
    po_lines: DataFrame
    errors: DataFrame
    added_lines: DataFrame


def raise_internal_orders(t: Tables, requests: DataFrame, as_of) -> InternalOrders:
    """Approved POs at an internal supplier -> orders of that branch, or an update of the order it has.

    Lines without division stay draft, and then the order does too.  Requests are (requestId, poId).  Lines that a PO
    gained after its order was raised, and that no order line refers to, are ``added_lines`` of that order, as drafts.
    """
    buyers = t.md_Customer.where(F.col("internal_branchId") != 0).groupBy("companyId", "internal_branchId").agg(F.min("customerId").alias("_buyer"))
    places = t.md_ShipToDestination.groupBy("warehouseId").agg(F.min("shipToId").alias("_shipTo"))
    rows = requests.join(t.poHeader.drop("shipToId"), "poId")
    rows = lookup(rows, t.md_Supplier, {"supplierId": "supplierId"}, branch="internal_branchId")
    rows = lookup(rows, buyers, {"branch": "companyId", "companyId": "internal_branchId"}, buyer="_buyer")
    rows = lookup(lookup(rows, main_warehouse(t), {"companyId": "companyId"}, _wh="warehouseId"), places, {"_wh": "warehouseId"}, shipToId="_shipTo")
    items = t.poLineItem.where((F.col("qty") > F.col("rcvQty")) & (F.col("itemStatus") == PO["approved"])).select(
        F.col("poId").alias("_p"), "podetailsId", "soLineItemId", "supplierSku", "currencyCode", "unitPrice", "qty", "itemReference1", "merchantSku", "poItemDesc")
    rows = rows.join(items, F.col("poId") == F.col("_p"), "left").drop("_p")
    rows = lookup(rows, t.soLineItem, {"soLineItemId": "soLineItemId"}, _odr="odrQty")
    skus = t.md_CustomerSku.where(F.col("statusflag") == 1)
    rows = lookup(rows, skus, {"supplierSku": "customerSku", "branch": "companyId", "buyer": "customerId"}, customerskuId="customerskuId", invID="invID", tagDivision="tagDivision", _desc="itemDesc")
    name = F.col("poName")
    checked = validate(rows, [
        Rule("{} is not approved", F.col("poStatus") != PO["approved"], name), Rule("{} is not with an internal supplier", F.coalesce("branch", F.lit(0)) == 0, name),
        Rule("{} has nothing open", F.col("podetailsId").isNull(), name), Rule("{} asks for more than its order", F.col("qty") > F.col("_odr"), name),
        Rule("SKU {} is not set up at the supplier", (F.coalesce("branch", F.lit(0)) != 0) & F.col("podetailsId").isNotNull() & F.col("customerskuId").isNull(), F.col("supplierSku")),
        Rule("{} has no ship-to", F.col("shipToId").isNull(), name)], "poId", ["requestId"])
    good = checked.accepted
    known = t.soHeader.groupBy("companyId", "customerPO").agg(F.min("soHeaderId").alias("_so"))
    good = lookup(good, known, {"branch": "companyId", "poName": "customerPO"}, _so="_so")
    status = F.when(F.col("tagDivision") == UNTAGGED, SO["draft"]).otherwise(SO["confirmed"])
    fresh = good.where(F.col("_so").isNull())
    heads = fresh.groupBy("poId", F.col("branch").alias("companyId"), F.col("buyer").alias("customerId"), F.col("poName").alias("customerPO"), F.col("customerCode").alias("thirdParty"),
                          F.col("reference1").alias("thirdPartyPO"), F.col("poReferenceId").alias("reference1"), "shipToId", "locNo", "vesselBooking", "portOfLanding", "portOfDestination",
                          F.col("poEarlyShipDate").alias("earlyShipDate"), F.col("poLateShipDate").alias("lateShipDate")) \
        .agg(F.bool_or(F.col("tagDivision") == UNTAGGED).alias("_untagged"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "SO", "companyId", ["poId"], as_of, "_no")
    heads = heads.withColumns({"soName": F.when(F.col("_untagged"), F.concat(F.lit("tempSO_"), "_no")).otherwise(F.col("_no")),
                               "soStatus": F.when(F.col("_untagged"), SO["draft"]).otherwise(SO["confirmed"]),
                               "apiStatus": F.when(~F.col("_untagged"), "_NEW_")}).drop("_no", "_untagged")
    desc = F.when(blank("poItemDesc"), F.col("_desc")).otherwise(F.col("poItemDesc"))
    shaped = good.select("poId", "_so", F.col("podetailsId").alias("ref_poLineItemId"), "invID", "customerskuId", F.col("supplierSku").alias("customerSku"), F.col("unitPrice").alias("csCost"),
                         "currencyCode", F.col("qty").alias("odrQty"), "itemReference1", "merchantSku", desc.alias("soItemDesc"), "tagDivision", status.alias("soLineItemStatus"))
    lines = shaped.where(F.col("_so").isNull()).drop("_so").join(heads.select("poId", "soName"), "poId").drop("poId")
    asked = shaped.where(F.col("_so").isNotNull()).select(F.col("ref_poLineItemId").alias("_ref"), F.col("_so").alias("_h"), F.col("odrQty").alias("_q"))
    updated = t.soLineItem.join(asked, (F.col("ref_poLineItemId") == F.col("_ref")) & (F.col("soHeaderId") == F.col("_h"))).withColumn("odrQty", F.col("_q")).select(*t.soLineItem.columns)
    known_refs = t.soLineItem.where(F.col("ref_poLineItemId").isNotNull()).select("ref_poLineItemId")
    added_lines = shaped.where(F.col("_so").isNotNull()).join(known_refs, "ref_poLineItemId", "left_anti") \
        .select(F.col("_so").alias("soHeaderId"), "ref_poLineItemId", "invID", "customerskuId", "customerSku", "csCost", "currencyCode", "odrQty", "itemReference1",
                F.lit(SO["draft"]).alias("soLineItemStatus"))
    done = good.select("poId").distinct()
    po_heads = t.poHeader.join(done, "poId", "left_semi").withColumn("poStatus", F.lit(PO["released"]))
    po_lines = t.poLineItem.join(done, "poId", "left_semi").withColumn("itemStatus", F.lit(PO["released"]))
    return InternalOrders(heads, lines, updated, po_heads, po_lines, checked.errors, added_lines)


# --- purchase order -> loading request --------------------------------------------------------------------------

class LoadingRequests(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    po_lines: DataFrame
    errors: DataFrame


def convert_to_loading_requests(t: Tables, requests: DataFrame, as_of) -> LoadingRequests:
    """Released POs of one supplier, customer, destination and date, none requested in part -> one request each."""
    rows = requests.join(t.poHeader, "poId")
    rows = lookup(rows, t.soHeader.select("soName", "customerId").groupBy("soName").agg(F.min("customerId").alias("customerId")), {"poReferenceId": "soName"}, customerId="customerId")
    part = t.poLineItem.groupBy("poId").agg(F.max("lrQty").alias("_lr"))
    rows = lookup(rows, part, {"poId": "poId"}, _lr="_lr")
    rows = flag_groups(rows, [(["requestId"], {"_suppliers": differs("supplierId"), "_customers": differs("customerId"), "_places": differs("shipToId"), "_dates": differs("poEarlyShipDate")})])
    name = F.col("poName")
    checked = validate(rows, [Rule("POs of different suppliers", F.col("_suppliers")), Rule("{} is not released", F.col("poStatus") != PO["released"], name),
                              Rule("POs of different customers", F.col("_customers")), Rule("POs of different destinations", F.col("_places")),
                              Rule("POs of different ship dates", F.col("_dates")), Rule("{} is requested in part", F.coalesce("_lr", F.lit(0)) > 0, name)], "poId", ["requestId"])
    heads = allocate_numbers(checked.accepted, t.md_SequenceNumber, "LR", "companyId", ["poId"], as_of, "_no")
    heads = heads.select("poId", "companyId", "supplierId", "customerId", F.concat(F.lit("tempLR_"), "_no").alias("lrName"), F.lit(as_of).cast("date").alias("lrDate"),
                         F.col("poEarlyShipDate").alias("lrShipDate"), F.col("shipToId").alias("lrShipToId"), "reference1", F.lit(LR["draft"]).alias("lrStatus"))
    lines = t.poLineItem.join(heads.select("poId", "lrName"), "poId").where(F.col("qty") > F.col("lrQty"))
    lines = lines.select("lrName", "poId", F.col("podetailsId").alias("poDetailsId"), "soLineItemId", "supplierSku", "invID", "merchantSku", "itemReference1",
                         (F.col("qty") - F.col("lrQty")).alias("qty"), (F.col("qty") - F.col("lrQty")).alias("confirmQty"), F.lit(LR["draft"]).alias("itemStatus"))
    return LoadingRequests(heads, lines, add_qty(t.poLineItem, lines, "podetailsId", "lrQty", "qty", changes_key="poDetailsId"), checked.errors)


class InternalRequests(NamedTuple):
    headers: DataFrame
    containers: DataFrame
    lines: DataFrame
    source_headers: DataFrame
    source_containers: DataFrame
    source_lines: DataFrame
    errors: DataFrame


def raise_internal_requests(t: Tables, requests: DataFrame, as_of) -> InternalRequests:
    """Approved requests at an internal supplier -> mirrored requests, containers and lines with back references."""
    buyers = t.md_Customer.where(F.col("internal_branchId") != 0).groupBy("companyId", "internal_branchId").agg(F.min("customerId").alias("_buyer"))
    heads = lookup(requests.join(t.lrHeader, "lrHeaderId"), t.md_Supplier, {"supplierId": "supplierId"}, branch="internal_branchId")
    lines = t.lrLineItem.where((F.col("itemStatus") != LR["cancelled"]) & (F.col("qty") > F.col("confirmQty"))).drop("lrName")
    lines = lookup(lines, t.poHeader, {"poId": "poId"}, _poStatus="poStatus")
    mirror = t.soLineItem.where(F.col("ref_poLineItemId").isNotNull()).groupBy("ref_poLineItemId") \
        .agg(F.min(F.struct("soLineItemId", "soHeaderId", "customerSku", "invID")).alias("m"))
    lines = lookup(lines, mirror, {"poDetailsId": "ref_poLineItemId"}, _m="m")
    bad = lines.groupBy("lrHeaderId").agg(F.bool_or(F.coalesce("_poStatus", F.lit(0)) != PO["released"]).alias("_unreleased"), F.bool_or(F.col("_m").isNull()).alias("_unmatched"))
    heads = lookup(heads, bad, {"lrHeaderId": "lrHeaderId"}, _unreleased="_unreleased", _unmatched="_unmatched")
    name = F.col("lrName")
    checked = validate(heads, [
        Rule("{} is raised already", F.col("lrStatus") == LR["released"], name), Rule("{} is not approved", F.col("lrStatus") != LR["approved"], name),
        Rule("{} is not with an internal supplier", F.coalesce("branch", F.lit(0)) == 0, name), Rule("{} has POs that are not released", F.col("_unreleased"), name),
        Rule("{} has lines without a supplier order", F.col("_unmatched"), name)], "lrHeaderId", ["requestId"])
    good = lookup(checked.accepted, buyers, {"branch": "companyId", "companyId": "internal_branchId"}, buyer="_buyer")
    new = good.select(F.col("branch").alias("companyId"), F.lit(0).alias("supplierId"), F.col("buyer").alias("customerId"), F.col("lrHeaderId").alias("ref_customerLrHeaderId"),
                      F.col("lrName").alias("customerLrName"), F.lit(as_of).cast("date").alias("lrDate"), "lrShipDate", F.lit(LR["released"]).alias("lrStatus"))
    new = allocate_numbers(new, t.md_SequenceNumber, "LR", "companyId", ["ref_customerLrHeaderId"], as_of, "lrName")
    named = new.select(F.col("ref_customerLrHeaderId").alias("lrHeaderId"), F.col("lrName").alias("_newName"))
    boxes = t.lrContainer.join(named, "lrHeaderId").withColumns({"lrName": F.col("_newName"), "ref_lrContainerId": F.col("lrContainerId"), "containerStatus": F.lit(LR["released"])}) \
        .drop("_newName", "lrHeaderId", "lrContainerId")
    picked = lines.join(named, "lrHeaderId")
    new_lines = picked.select(F.col("_newName").alias("lrName"), F.col("lrContainerId").alias("ref_lrContainerId"), F.col("lrDetailsId").alias("ref_lrLineItemId"), "_m.soHeaderId",
                              "_m.soLineItemId", F.col("_m.customerSku").alias("supplierSku"), "_m.invID", "qty", "itemNote", F.lit(LR["released"]).alias("itemStatus"))
    old_lines = t.lrLineItem.join(picked.select("lrDetailsId"), "lrDetailsId", "left_semi").withColumns({"confirmQty": (F.col("confirmQty") + F.col("qty")).cast("int"), "itemStatus": F.lit(LR["released"])})
    old_boxes = t.lrContainer.join(picked.select("lrContainerId").distinct(), "lrContainerId", "left_semi").withColumn("containerStatus", F.lit(LR["released"]))
    old_heads = t.lrHeader.join(named.select("lrHeaderId"), "lrHeaderId", "left_semi").withColumns({"lrStatus": F.lit(LR["released"]), "apiStatus": F.lit("_REL_")})
    return InternalRequests(new, boxes, new_lines, old_heads, old_boxes, old_lines, checked.errors)


# --- shipments --------------------------------------------------------------------------------------------------

class Shipments(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    addresses: DataFrame
    movements: DataFrame
    balances: DataFrame
    locks: DataFrame
    lr_lines: DataFrame
    lr_headers: DataFrame
    so_lines: DataFrame
    so_headers: DataFrame
    errors: DataFrame


def ship_loading_requests(t: Tables, requests: DataFrame, as_of) -> Shipments:
    """Released containers -> one bill of lading per container and one shipment per order in it.

    A request passes when its demand fits what the accepted requests before
    it in the batch have left of the stock of the company's main warehouse; a rejected one holds nothing.
    """
    heads = requests.join(t.lrHeader.select("lrHeaderId", "companyId", "lrName"), "lrHeaderId")
    heads = lookup(heads, main_warehouse(t), {"companyId": "companyId"}, warehouseId="warehouseId")
    boxes = present(t.lrContainer.where(F.col("containerStatus") == LR["released"]), "lrContainerId", "lrHeaderId", "containerTypeId", "containerSeq", "containerNo", "containerSealNo", "portId",
                    "forwarderId", "forwarderBookingNo", "haulierId", "ETD", "ETA")
    lines = t.lrLineItem.where((F.col("qty") > F.col("processQty")) & (F.col("itemStatus") == LR["released"])) \
        .select("lrDetailsId", "lrContainerId", "soHeaderId", "soLineItemId", F.col("invID").alias("invId"), "supplierSku", (F.col("qty") - F.col("processQty")).alias("shipQty"), "itemNote")
    rows = lines.join(boxes, "lrContainerId").join(heads, "lrHeaderId")
    demand = lookup(rows.select("requestId", "lrHeaderId", *BALANCE_KEY, "shipQty"), t.inventoryBalanceWH, {c: c for c in BALANCE_KEY}, _stock="balanceQty")
    rows = flag_rows(rows, unserved(demand, "requestId", "lrHeaderId", BALANCE_KEY, "shipQty", "_stock"), ["requestId", *BALANCE_KEY], "_short")
    checked = validate(rows, [Rule("{} has not enough stock", F.col("_short"), F.col("supplierSku"))], "lrDetailsId", ["requestId"])
    good = checked.accepted.drop("_short")

    bols = allocate_numbers(good.select("companyId", "lrContainerId").distinct(), t.md_SequenceNumber, "BOL", "companyId", ["lrContainerId"], as_of, "bol")
    ships = allocate_numbers(good.select("companyId", "lrContainerId", "soHeaderId").distinct(), t.md_SequenceNumber, "SHIP", "companyId", ["lrContainerId", "soHeaderId"], as_of, "shipId")
    good = good.join(bols.select("lrContainerId", "bol"), "lrContainerId").join(ships.select("lrContainerId", "soHeaderId", "shipId"), ["lrContainerId", "soHeaderId"])
    good = lookup(good, t.md_Inventory, {"invId": "invID"}, _weight="grossWeight")
    box_columns = [c for c in boxes.columns if c not in ("lrContainerId", "lrHeaderId", "portId")]
    ship_heads = good.groupBy("shipId", "bol", "companyId", "warehouseId", "lrHeaderId", "lrName", "soHeaderId", "portId", *box_columns) \
        .agg(F.sum(F.col("shipQty") * F.col("_weight")).alias("shipmentWeight"))
    orders = lookup(t.soHeader, t.md_Customer, {"customerId": "customerId"}, _term="paymentTerm")
    ship_heads = lookup(ship_heads, orders, {"soHeaderId": "soHeaderId"}, customerId="customerId", soName="soName", customerPO="customerPO", shipToId="shipToId", pol="portOfLanding", paymentTermId="_term")
    ship_heads = lookup(ship_heads, t.md_Port, {"portId": "portId"}, pod="portName")
    countries = lookup(t.md_Company, t.md_MasterCategory, {"country": "categoryId"}, _origin="categoryName")
    ship_heads = lookup(ship_heads, countries, {"companyId": "companyId"}, countryOfOrigin="_origin")
    per_bol = ship_heads.groupBy("bol").agg(F.sum("shipmentWeight").alias("bolTotalShipmentWeight"))
    ship_heads = ship_heads.join(per_bol, "bol").withColumns({"shipmentDate": F.lit(as_of).cast("date"), "shipmentStatus": F.lit(2149)}).withColumnRenamed("warehouseId", "pickupAddrId").drop("portId")
    ship_lines = lookup(good, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", customerSku="customerSku", merchantSku="merchantSku") \
        .select("shipId", "soLineItemId", "lrDetailsId", "invId", "customerSku", "merchantSku", F.col("shipQty").alias("shipmentQty"), "shipQty", F.col("itemNote").alias("lineItemNotes"),
                F.lit(2149).alias("lineItemStatus"))
    places = present(t.md_ShipToDestination, "shipToId", "locNo", "shipToName", "shipToLabel", "shipToAddressLine1", "shipToCity", "shipToPostCode", "country")
    addresses = ship_heads.select("shipId", "shipToId").join(places, "shipToId").drop("shipToId")
    moves = good.join(t.soHeader.select("soHeaderId", "soName"), "soHeaderId").select("warehouseId", "companyId", F.lit("SHIP").alias("action"), F.col("shipId").alias("actionKey"), "invId",
                                                                                    (-F.col("shipQty")).alias("qty"), F.col("soName").alias("reason"))
    balances = ledger_apply(moves, t.inventoryBalanceWH, moves.select(*BALANCE_KEY, F.col("qty").alias("lockQty")))
    locks = release(t.inventoryBalanceWh_Lock, good.select("soLineItemId", F.col("shipQty").alias("qty"))).join(good.select("soLineItemId").distinct(), "soLineItemId", "left_semi")
    target = F.when(F.col("confirmQty") == 0, F.col("qty")).otherwise(F.col("confirmQty"))
    lr_lines = _shipped_lines(t.lrLineItem, good, "lrHeaderId", "lrDetailsId", "processQty", "itemStatus", target, LR["closed"])
    lr_heads = _complete(t.lrHeader, t.lrLineItem, lr_lines, "lrHeaderId", "lrDetailsId", "itemStatus", (LR["closed"], LR["cancelled"]), "lrStatus", LR["closed"])
    so_lines = _shipped_lines(t.soLineItem, good, "soHeaderId", "soLineItemId", "shpQty", "soLineItemStatus", F.col("odrQty"), SO["closed"])
    so_heads = _complete(t.soHeader, t.soLineItem, so_lines, "soHeaderId", "soLineItemId", "soLineItemStatus", (SO["cancelled"], SO["closed"]), "soStatus", SO["closed"])
    return Shipments(ship_heads, ship_lines, addresses, moves, balances, locks, lr_lines, lr_heads, so_lines, so_heads, checked.errors)


def _shipped_lines(lines: DataFrame, shipped: DataFrame, document: str, key: str, column: str, status: str, target: Column, closed: int) -> DataFrame:
    """Changed lines of the shipped documents: quantity up, and closed where it reaches its target (also lines that had reached it before)."""
    sums = shipped.groupBy(F.col(key).alias("_rk")).agg(F.sum("shipQty").alias("_delta"))
    rows = lines.join(shipped.select(document).distinct(), document, "left_semi").join(sums, F.col(key) == F.col("_rk"), "left")
    rows = rows.withColumns({"_was": F.col(status), column: (F.col(column) + F.coalesce("_delta", F.lit(0))).cast(lines.schema[column].dataType)})
    rows = rows.withColumn(status, F.when(target == F.col(column), closed).otherwise(F.col(status)))
    return rows.where(F.col("_delta").isNotNull() | (F.col("_was") != F.col(status))).select(*lines.columns)


def _complete(heads: DataFrame, lines: DataFrame, changed: DataFrame, key: str, line_key: str, status: str, states: tuple[int, ...], head_status: str, to: int) -> DataFrame:
    """Headers of changed lines all of whose lines, after the change, are in the given states."""
    touched = changed.select(key).distinct()
    after = lines.join(touched, key, "left_semi").select(line_key, key, status) \
        .join(changed.select(F.col(line_key).alias("_l"), F.col(status).alias("_s")), F.col(line_key) == F.col("_l"), "left")
    done = after.groupBy(key).agg(F.bool_and(F.coalesce("_s", status).isin(*states)).alias("_done")).where("_done").select(key)
    return heads.join(done, key, "left_semi").withColumn(head_status, F.lit(to))


class ProcessShipments(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    movements: DataFrame
    balances: DataFrame
    process_lines: DataFrame
    process_headers: DataFrame
    errors: DataFrame


def ship_order_processes(t: Tables, requests: DataFrame, as_of) -> ProcessShipments:
    """Confirmed order processes -> shipments; rejected when the confirmed quantity exceeds the free stock."""
    heads = lookup(requests.join(t.orderProcess, "opId"), main_warehouse(t), {"companyId": "companyId"}, warehouseId="warehouseId")
    lines = t.orderProcessLineItem.select("opLineItemId", "opId", "soLineItemId", "invId", "confirmQty", "lineStatus")
    rows = heads.select("requestId", "opId", "opName", "opStatus", "companyId", "customerId", "shipToId", "warehouseId").join(lines, "opId")
    asked = rows = shared_rows(rows)  # read for the demand, its order and the rules
    stock = t.inventoryBalanceWH.groupBy("companyId", "invId").agg(F.sum(F.col("balanceQty") - F.col("lockQty")).alias("_free"))
    need = lookup(rows.select("requestId", "opId", "companyId", "invId", "confirmQty"), stock, {"companyId": "companyId", "invId": "invId"}, _free="_free")
    barred = rows.where(~F.col("opStatus").eqNullSafe(1091)).select("requestId")
    rows = flag_rows(rows, unserved(need, "requestId", "opId", ["companyId", "invId"], "confirmQty", "_free", barred), ["requestId", "companyId", "invId"], "_short")
    rows = lookup(rows, t.soLineItem, {"soLineItemId": "soLineItemId"}, customerSku="customerSku", merchantSku="merchantSku")
    checked = validate(rows, [Rule("{} is shipped already", F.col("opStatus") == 1090, F.col("opName")), Rule("{} is not confirmed", F.col("opStatus") != 1091, F.col("opName")),
                              Rule("{} has not enough stock", F.col("_short"), F.col("customerSku"))], "opLineItemId", ["requestId"])
    removed_rows(asked)
    good = lookup(checked.accepted, t.md_Inventory, {"invId": "invID"}, _weight="grossWeight")
    ships = good.groupBy("opId", "opName", "companyId", "customerId", "shipToId", "warehouseId").agg(F.sum(F.col("confirmQty") * F.col("_weight")).alias("shipmentWeight"))
    ships = allocate_numbers(ships, t.md_SequenceNumber, "SHIP", "companyId", ["opId"], as_of, "shipId")
    ships = ships.withColumns({"shipmentDate": F.lit(as_of).cast("date"), "paymentDueDate": F.add_months(F.lit(as_of).cast("date"), 3), "shipmentStatus": F.lit(2149)}) \
        .withColumnRenamed("warehouseId", "pickupAddrId")
    good = good.join(ships.select("opId", "shipId"), "opId")
    ship_lines = good.select("shipId", "soLineItemId", "invId", "customerSku", "merchantSku", F.col("confirmQty").alias("shipmentQty"), F.col("confirmQty").alias("shipQty"),
                             F.lit(2149).alias("lineItemStatus"))
    moves = good.select("warehouseId", "companyId", F.lit("SHIP").alias("action"), F.col("shipId").alias("actionKey"), "invId", (-F.col("confirmQty")).alias("qty"))
    p_lines = t.orderProcessLineItem.join(good.select("opLineItemId"), "opLineItemId", "left_semi").withColumn("lineStatus", F.lit(1090))
    p_heads = t.orderProcess.join(ships.select("opId"), "opId", "left_semi").withColumn("opStatus", F.lit(1090))
    return ProcessShipments(ships, ship_lines, moves, ledger_apply(moves, t.inventoryBalanceWH), p_lines, p_heads, checked.errors)


# --- order -> work order ----------------------------------------------------------------------------------------

class WorkOrders(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    so_lines: DataFrame
    errors: DataFrame


def convert_to_work_orders(t: Tables, as_of, company_id=None, lines: DataFrame | None = None, default_location: str = "L1",
                           forced_warehouse: int | None = None) -> WorkOrders:
    """Open order lines -> one work order per customer, ship date, port and third party; due seven days before shipping.

    ``lines`` may hold the wanted ``soLineItemId`` values; with ``forced_warehouse``, those whose order has no location go
    to the location of that warehouse, instead of the default one.  An open line whose location has no warehouse is an
    error and gets no work order; the others do.
    """
    if forced_warehouse is not None and lines is None:
        raise ValueError("a forced warehouse needs the lines it is for")
    open_lines = t.soLineItem.where((F.col("odrQty") > F.col("processQty")) & ~F.col("soLineItemStatus").isin(SO["cancelled"], SO["closed"], SO["draft"])) \
        .select("soLineItemId", "soHeaderId", F.col("invID").alias("invId"), (F.col("odrQty") - F.col("processQty")).alias("woQty"))
    if lines is not None:
        open_lines = open_lines.join(lines, "soLineItemId", "left_semi")
    orders = keep_if(t.soHeader, "companyId", company_id).where(~F.col("soStatus").isin(SO["cancelled"], SO["closed"], SO["draft"]))
    places = t.md_Warehouse.groupBy("locNo").agg(F.min("warehouseId").alias("warehouseId"))
    fallback = F.lit(default_location)
    if forced_warehouse is not None:
        forced = t.md_Warehouse.where(F.col("warehouseId") == forced_warehouse).agg(F.min("locNo").alias("locNo"))
        fallback = F.coalesce(forced.scalar(), F.lit(f"of warehouse {forced_warehouse}"))
    orders = orders.withColumn("_loc", F.when(blank("locNo"), fallback).otherwise(F.col("locNo")))
    orders = lookup(orders, places, {"_loc": "locNo"}, warehouseId="warehouseId")
    group = ["companyId", "customerId", "earlyShipDate", "portOfDestination", "thirdParty"]
    rows = open_lines.join(orders.select("soHeaderId", "soName", "warehouseId", "_loc", *group), "soHeaderId")
    checked = validate(rows, [Rule("Location {} has no warehouse", F.col("warehouseId").isNull(), F.col("_loc"))], "soLineItemId", ["soHeaderId"], strict=False)
    rows = checked.accepted.drop("_loc")
    heads = rows.groupBy(*group).agg(F.min("warehouseId").alias("warehouseId"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "WO", "companyId", ["customerId", "earlyShipDate", "portOfDestination", "thirdParty"], as_of, "workOrderName")
    made = rows.drop("warehouseId").join(heads.select(*group, "workOrderName"), group)
    heads = heads.withColumns({"workOrderDate": F.lit(as_of).cast("date"), "targetCompleteDate": F.date_sub("earlyShipDate", 7), "workOrderStatus": F.lit(WO["open"])}) \
        .withColumnRenamed("earlyShipDate", "shipDate")
    wo_lines = made.select("workOrderName", "soHeaderId", "soName", "soLineItemId", "invId", F.col("woQty").alias("qty"), F.col("woQty").alias("confirmQty"), F.lit(WO["open"]).alias("workOrderItemStatus"))
    return WorkOrders(heads, wo_lines, add_qty(t.soLineItem, wo_lines, "soLineItemId", "processQty", "qty"), checked.errors)


# --- procurement ------------------------------------------------------------------------------------------------

class Demand(NamedTuple):
    demand: DataFrame
    so_lines: DataFrame
    errors: DataFrame


def procure_materials(t: Tables, requests: DataFrame) -> Demand:
    """Open order quantity x components -> material demand; every item must have components."""
    rows = requests.join(t.soHeader.select("soHeaderId", "companyId", "soName"), "soHeaderId") \
        .join(t.soLineItem.select("soLineItemId", F.col("soHeaderId").alias("_h"), F.col("invID").alias("invId"), (F.col("odrQty") - F.col("poQty")).alias("processQty")),
              F.col("soHeaderId") == F.col("_h")).drop("_h")
    boms = t.rawBom.where(F.col("status") == 1)
    having = boms.select("companyId", "invId").distinct().withColumn("_has", F.lit(True))
    rows = rows.join(having, ["companyId", "invId"], "left")
    rows = lookup(rows, t.md_Inventory, {"invId": "invID"}, _sku="inventorySKU")
    checked = validate(rows, [Rule("{} has no components", F.col("_has").isNull(), F.col("_sku"))], "soLineItemId", ["requestId"])
    made = checked.accepted.drop("_has", "_sku").join(boms.select("companyId", "invId", "rawBomInvId", "rawBomQty"), ["companyId", "invId"]) \
        .withColumns({"rawBomTotalQty": F.col("processQty") * F.col("rawBomQty"), "status": F.lit(0)})
    taken = made.select(F.col("soLineItemId").alias("_l"), F.col("processQty").alias("_q")).distinct()
    so_lines = t.soLineItem.join(taken, F.col("soLineItemId") == F.col("_l")).withColumn("poQty", F.col("_q")).select(*t.soLineItem.columns)
    return Demand(made, so_lines, checked.errors)


class ProcurementOrders(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    demand: DataFrame
    so_lines: DataFrame
    errors: DataFrame


def order_materials(t: Tables, requests: DataFrame, as_of) -> ProcurementOrders:
    """Demand rows (requestId, procurementProcessId, supplierId, orderQty) -> one PO per company and supplier."""
    demand = t.procurementProcess.where(F.col("status") == 0)
    rows = requests.join(demand, "procurementProcessId")
    skus = t.md_SupplierSku.where(F.col("statusflag") == 1)
    rows = lookup(rows, skus, {"companyId": "companyId", "supplierId": "supplierId", "rawBomInvId": "invId"}, supplierSku="supplierSku", supCost="supCost", _currency="currencyCode")
    rows = lookup(rows, t.md_MasterCategory, {"_currency": "categoryId"}, foreignCurrency="categoryName")
    rows = lookup(rows, t.md_Inventory, {"rawBomInvId": "invID"}, itemCode="itemCode", _sku="inventorySKU")
    rows = config_value(rows, t.md_DefaultConfig, "companyId", "DefaultCurrency", "homeCurrency").withColumn("_today", F.lit(as_of).cast("date"))
    rows = rate_at(rows, t.md_CurrencyRate, "companyId", "homeCurrency", "foreignCurrency", "_today", "_found")
    same = F.col("homeCurrency") == F.col("foreignCurrency")
    rows = rows.withColumn("_rate", F.when(same, F.lit(1000000).cast("long")).otherwise(F.col("_found")))
    checked = validate(rows, [Rule("{} has no order quantity", F.coalesce("orderQty", F.lit(0)) == 0, F.col("procurementProcessId")),
                              Rule("Supplier SKU for {} is not set up", F.col("supplierSku").isNull(), F.col("_sku")),
                              Rule("Currency {} has no rate", F.col("supplierSku").isNotNull() & F.col("_rate").isNull(), F.col("foreignCurrency"))], "procurementProcessId", ["requestId"])
    good = checked.accepted
    heads = good.groupBy("companyId", "supplierId", "foreignCurrency", "homeCurrency", F.col("_rate").alias("foreignCurrencyRate")) \
        .agg(F.sum(F.col("orderQty") * F.col("supCost")).alias("poNetTotal"), F.sum("orderQty").alias("poQty"))
    heads = allocate_numbers(heads, t.md_SequenceNumber, "PO", "companyId", ["supplierId", "foreignCurrency"], as_of, "poName").withColumn("poStatus", F.lit(PO["draft"]))
    lines = good.groupBy("companyId", "supplierId", "foreignCurrency", "soLineItemId", "rawBomInvId", "itemCode", "supplierSku", "supCost", "_rate").agg(F.sum("orderQty").alias("qty"))
    lines = lines.join(heads.select("companyId", "supplierId", "foreignCurrency", "poName"), ["companyId", "supplierId", "foreignCurrency"]) \
        .select("poName", "soLineItemId", F.col("rawBomInvId").alias("invID"), "itemCode", "supplierSku", "qty", F.col("foreignCurrency").alias("currencyCode"), F.col("supCost").alias("unitPrice"),
                (F.col("supCost") * F.col("_rate")).alias("homeCurrencyCost"), F.lit(PO["draft"]).alias("itemStatus"))
    sums = good.groupBy(F.col("procurementProcessId").alias("_p")).agg(F.sum("orderQty").alias("_q"))
    after = t.procurementProcess.join(sums, F.col("procurementProcessId") == F.col("_p")).withColumn("poQty", (F.col("poQty") + F.col("_q")).cast(t.procurementProcess.schema["poQty"].dataType))
    after = after.withColumn("status", F.when(F.col("poQty") == F.col("rawBomTotalQty"), 1).otherwise(F.col("status"))).select(*t.procurementProcess.columns)
    return ProcurementOrders(heads, lines, after, add_qty(t.soLineItem, lines, "soLineItemId", "poQty", "qty"), checked.errors)


RECEIPT_FIELDS = {"poId": "bigint", "DO": "string", "warehouseId": "int"}
RECEIPT_LINE_FIELDS = {"poDetailsId": "string", "rcvQty": "int"}


def receive_payload(t: Tables, payloads: DataFrame, column: str, as_of) -> tuple[ReceiptDocuments, DataFrame]:
    """Nested JSON receipts -> receipt documents; over-received lines are errors of their delivery order."""
    rows = parse_payload(payloads, column, RECEIPT_FIELDS, nested={"poList": RECEIPT_LINE_FIELDS})
    rows = lookup(rows, t.poLineItem, {"poDetailsId": "podetailsId"}, invId="invID", supplierSku="supplierSku", _open=F.col("qty") - F.col("rcvQty"))
    rows = lookup(rows, t.poHeader, {"poId": "poId"}, companyId="companyId", supplierId="supplierId", poName="poName")
    rows = flag_groups(rows, [(["poDetailsId"], {"_over": exceeds("rcvQty", "_open")})])
    checked = validate(rows, [Rule("PO {} is unknown", F.col("companyId").isNull(), F.col("poId")), Rule("PO line {} is unknown", F.col("invId").isNull(), F.col("poDetailsId")),
                              Rule("{} is received beyond the PO quantity", F.col("_over"), F.col("supplierSku"))], "poDetailsId", ["DO"])
    good = checked.accepted.select("DO", "companyId", "supplierId", "warehouseId", "poId", "poDetailsId", "invId", "supplierSku", "rcvQty", F.lit("").alias("notes"), F.lit(as_of).cast("date").alias("doDate"))
    return receive(t, good, ["DO"]), checked.errors


class Locked(NamedTuple):
    balances: DataFrame
    demand: DataFrame
    locks: DataFrame
    errors: DataFrame


def lock_stock(t: Tables, requests: DataFrame) -> Locked:
    """Reserve stock for demand rows (requestId, procurementProcessId, warehouseId, newLockQty).

    The stated quantity replaces the locked one.  A request's rows must fit the free
    stock that the accepted requests before it have left; demand locked in full is done.
    """
    rows = requests.join(t.procurementProcess.select("procurementProcessId", "companyId", "soLineItemId", F.col("rawBomInvId").alias("invId"), "lockQty", "rawBomTotalQty"), "procurementProcessId")
    rows = rows.withColumn("_delta", F.col("newLockQty") - F.col("lockQty"))
    asked = rows = shared_rows(lookup(rows, t.inventoryBalanceWH, {c: c for c in BALANCE_KEY}, _free=F.col("balanceQty") - F.col("lockQty")))  # read for the demand, its order and the rules
    known = rows.where(F.col("_free").isNotNull())
    barred = rows.where(F.col("_free").isNull()).select("requestId")
    short = unserved(known, "requestId", "procurementProcessId", BALANCE_KEY, "_delta", "_free", barred)
    rows = flag_rows(rows, short, ["requestId", *BALANCE_KEY], "_short")
    checked = validate(rows, [Rule("Warehouse {} has not enough free stock", F.col("_free").isNull() | F.col("_short"), F.col("warehouseId"))], "procurementProcessId", ["requestId"])
    removed_rows(asked)
    good = checked.accepted
    locks = good.select("procurementProcessId", "companyId", "soLineItemId", "warehouseId", "invId", F.col("_delta").alias("lockQty"))
    none = good.select(*BALANCE_KEY, F.lit(0).alias("qty"))
    sums = good.groupBy(F.col("procurementProcessId").alias("_p")).agg(F.sum("_delta").alias("_d"))
    demand = t.procurementProcess.join(sums, F.col("procurementProcessId") == F.col("_p")).withColumn("lockQty", F.col("lockQty") + F.col("_d"))
    demand = demand.withColumn("status", F.when(F.col("lockQty") == F.col("rawBomTotalQty"), 1).otherwise(0)).select(*t.procurementProcess.columns)
    return Locked(ledger_apply(none, t.inventoryBalanceWH, locks), demand, locks, checked.errors)


# --- corrections of shipped quantities --------------------------------------------------------------------------

class Corrected(NamedTuple):
    shipment_lines: DataFrame
    shipments: DataFrame
    movements: DataFrame
    balances: DataFrame
    so_lines: DataFrame
    so_headers: DataFrame


def _shipped_changes(t: Tables, changes: DataFrame) -> DataFrame:
    """Changes (shipmentLineItemId, newShipQty, newNotes) with the old quantity, warehouse and order."""
    rows = changes.join(t.shipmentLineItem, "shipmentLineItemId").join(t.shipmentHeader.select("shipmentId", "shipId", "bol", "companyId", F.col("pickupAddrId").alias("warehouseId"), "soName"), "shipmentId")
    return rows.withColumn("adjustQty", F.col("shipQty") - F.col("newShipQty"))


def correct_checkout(t: Tables, changes: DataFrame) -> Corrected:
    """Corrected shipped quantities: stock gets the difference back, order lines reopen, weights are summed again."""
    rows = _shipped_changes(t, changes)
    lines = rows.withColumns({"shipQty": F.col("newShipQty"), "lineItemNotes": F.col("newNotes")}).select(*t.shipmentLineItem.columns)
    moves = rows.select("warehouseId", "companyId", F.lit("SHIPADJ").alias("action"), F.col("shipId").alias("actionKey"), "invId", F.col("adjustQty").alias("qty"))
    touched = rows.select("shipmentId").distinct()
    weighed = lookup(t.shipmentLineItem.join(touched, "shipmentId", "left_semi").select("shipmentLineItemId", "shipmentId", "invId", "shipQty"), t.md_Inventory, {"invId": "invID"}, _w="grossWeight")
    weighed = lookup(weighed, lines, {"shipmentLineItemId": "shipmentLineItemId"}, _new="shipQty")
    sums = weighed.groupBy("shipmentId").agg(F.sum(F.coalesce("_new", "shipQty") * F.col("_w")).alias("_weight"))
    bols = rows.where(~blank("bol")).select("bol").distinct()
    near = t.shipmentHeader.join(bols, "bol", "left_semi")
    near = lookup(near, sums, {"shipmentId": "shipmentId"}, _weight="_weight").withColumn("shipmentWeight", F.coalesce("_weight", "shipmentWeight"))
    totals = near.groupBy(F.col("bol").alias("_bol")).agg(F.sum("shipmentWeight").alias("_total"))
    ships = near.join(totals, F.col("bol") == F.col("_bol")).withColumn("bolTotalShipmentWeight", F.col("_total")).select(*t.shipmentHeader.columns)
    so_lines = add_qty(t.soLineItem, rows, "soLineItemId", "shpQty", "adjustQty", -1, soLineItemStatus=F.lit(SO["production"]))
    so_heads = t.soHeader.join(so_lines.select("soHeaderId").distinct(), "soHeaderId", "left_semi").withColumn("soStatus", F.lit(SO["production"]))
    return Corrected(lines, ships, moves, ledger_apply(moves, t.inventoryBalanceWH), so_lines, so_heads)


class Reversed(NamedTuple):
    shipment_lines: DataFrame
    movements: DataFrame
    balances: DataFrame
    so_lines: DataFrame
    lr_lines: DataFrame
    lr_containers: DataFrame
    lr_headers: DataFrame
    errors: DataFrame


def reverse_shipment_lines(t: Tables, changes: DataFrame) -> Reversed:
    """Shipped quantities taken back (only down, only open lines) with order, request and stock following."""
    rows = _shipped_changes(t, changes)
    rows = lookup(rows, t.lrLineItem, {"lrDetailsId": "lrDetailsId"}, lrHeaderId="lrHeaderId", lrContainerId="lrContainerId")
    checked = validate(rows, [Rule("{} can only go down", F.col("newShipQty") > F.col("shipQty"), F.col("shipmentLineItemId")),
                              Rule("{} is closed", F.col("lineItemStatus") != 2149, F.col("shipmentLineItemId"))], "shipmentLineItemId", ["shipmentId"])
    good = checked.accepted
    lines = good.withColumns({"shipQty": F.col("newShipQty"), "lineItemNotes": F.col("newNotes")}).select(*t.shipmentLineItem.columns)
    reason = F.concat("newNotes", F.lit("|Reverse shipQty From "), F.col("shipQty").cast("string"), F.lit(" to "), F.col("newShipQty").cast("string"))
    moves = good.select("warehouseId", "companyId", F.lit("REVSHIP").alias("action"), F.col("shipId").alias("actionKey"), "invId", F.col("adjustQty").alias("qty"), reason.alias("reason"))
    so_lines = add_qty(t.soLineItem, good, "soLineItemId", "shpQty", "adjustQty", -1)
    lr_lines = add_qty(t.lrLineItem, good, "lrDetailsId", "processQty", "adjustQty", -1, itemStatus=F.lit(LR["released"]))
    boxes = t.lrContainer.join(good.select("lrContainerId").distinct(), "lrContainerId", "left_semi").withColumn("containerStatus", F.lit(LR["released"]))
    heads = t.lrHeader.join(good.select("lrHeaderId").distinct(), "lrHeaderId", "left_semi").withColumn("lrStatus", F.lit(LR["released"]))
    return Reversed(lines, moves, ledger_apply(moves, t.inventoryBalanceWH), so_lines, lr_lines, boxes, heads, checked.errors)


class PickedUp(NamedTuple):
    shipments: DataFrame
    receipts: DataFrame


def confirm_pickup(t: Tables, bols: DataFrame, as_of) -> PickedUp:
    """Pull-out date on the shipments of bills of lading, and one receipt payload per shipment and PO for the buyer."""
    ships = t.shipmentHeader.join(bols, "bol", "left_semi")
    lines = t.shipmentLineItem.join(ships.select("shipmentId", "shipId", "shipToId"), "shipmentId")
    lines = lookup(lines, t.md_ShipToDestination, {"shipToId": "shipToId"}, warehouseId="warehouseId")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", _ref="ref_poLineItemId")
    lines = lookup(lines, t.poLineItem, {"_ref": "podetailsId"}, "inner", poId="poId", poDetailsId="podetailsId")
    one = F.struct("poDetailsId", F.col("shipQty").alias("rcvQty"))
    receipts = lines.groupBy("poId", F.concat("shipId", F.lit(".csv")).alias("DO"), "warehouseId").agg(F.array_sort(F.collect_list(one)).alias("poList"))
    receipts = receipts.select("poId", "DO", F.to_json(F.array(F.struct("poId", "DO", "warehouseId", "poList"))).alias("payload"))
    return PickedUp(ships.withColumn("containerPullOutDate", F.lit(as_of).cast("date")), receipts)


# --- prices, rates, dates ---------------------------------------------------------------------------------------

class Repriced(NamedTuple):
    headers: DataFrame
    lines: DataFrame


def _po_totals(t: Tables, changed: DataFrame, legacy_total: bool) -> DataFrame:
    """Net and gross totals of the POs of changed lines; ``legacy_total`` sums unit prices without quantity."""
    touched = changed.select("poId").distinct()
    lines = t.poLineItem.join(touched, "poId", "left_semi").select("podetailsId", "poId", "qty", "unitPrice", "itemStatus")
    lines = lookup(lines, changed, {"podetailsId": "podetailsId"}, _new="unitPrice").where(F.col("itemStatus") != PO["cancelled"])
    price = F.coalesce("_new", "unitPrice")
    total = price if legacy_total else price * F.col("qty")
    return lines.groupBy("poId").agg(F.sum(total).alias("_net"))


def _with_totals(heads: DataFrame, totals: DataFrame) -> DataFrame:
    have = {c.lower() for c in heads.columns}
    tax = F.coalesce("poTax", F.lit(0)) if "potax" in have else F.lit(0)
    discount = F.coalesce("poDiscount", F.lit(0)) if "podiscount" in have else F.lit(0)
    net = F.coalesce("_net", F.lit(0))
    return lookup(heads, totals, {"poId": "poId"}, _net="_net").withColumns({"poNetTotal": net, "poGrossTotal": net + tax - discount}).drop("_net")


def rerate_purchase_orders(t: Tables, rates: DataFrame, legacy_total: bool = False) -> Repriced:
    """New currency rate per PO (poId, currencyRate): home cost of every line and the totals."""
    lines = t.poLineItem.join(rates, "poId").withColumn("homeCurrencyCost", F.coalesce("unitPrice", F.lit(0)) * F.col("currencyRate"))
    heads = t.poHeader.join(rates, "poId").withColumn("foreignCurrencyRate", F.col("currencyRate")).drop("currencyRate")
    return Repriced(_with_totals(heads, _po_totals(t, lines, legacy_total)), lines.drop("currencyRate"))


def reprice_lines(t: Tables, prices: DataFrame, legacy_total: bool = False) -> Repriced:
    """New unit price per PO line (podetailsId, unitCost): home cost of the line and the totals of its PO."""
    lines = t.poLineItem.join(prices, "podetailsId").join(t.poHeader.select("poId", "foreignCurrencyRate"), "poId")
    lines = lines.withColumns({"unitPrice": F.col("unitCost"), "homeCurrencyCost": F.col("unitCost") * F.col("foreignCurrencyRate")}).drop("unitCost", "foreignCurrencyRate")
    heads = t.poHeader.join(lines.select("poId").distinct(), "poId", "left_semi")
    return Repriced(_with_totals(heads, _po_totals(t, lines, legacy_total)), lines)


class Rescheduled(NamedTuple):
    so_headers: DataFrame
    po_headers: DataFrame


def move_ship_dates(t: Tables, moves: DataFrame, as_of) -> Rescheduled:
    """New ship dates (soHeaderId, newShipDate) on orders and their POs; dates before today are left out."""
    today = F.lit(as_of).cast("date")
    good = moves.where(F.col("newShipDate") >= today)
    heads = t.soHeader.join(good, "soHeaderId").withColumns({"earlyShipDate": F.col("newShipDate"), "lateShipDate": F.date_add("newShipDate", 7),
                                                            "lastUpdatedDate": F.when(F.col("soStatus") != SO["draft"], today)})
    names = heads.select(F.col("soName").alias("poReferenceId"), "newShipDate")
    pos = t.poHeader.join(names, "poReferenceId").withColumns({"poEarlyShipDate": F.col("newShipDate"), "poLateShipDate": F.date_add("newShipDate", 7)})
    return Rescheduled(heads.select(*t.soHeader.columns), pos.select(*t.poHeader.columns))


# --- file-shaped exports ----------------------------------------------------------------------------------------

class Export(NamedTuple):
    rows: DataFrame
    errors: DataFrame


def export_loading_template(t: Tables, requests: DataFrame) -> Export:
    """Open PO lines of running orders in the column layout of the loading file."""
    rows = requests.join(t.soHeader.select("soHeaderId", "soName", "soStatus"), "soHeaderId")
    pos = t.poHeader.select("poId", "poName", "poStatus", F.col("poReferenceId").alias("soName"), "reference1", F.col("shipToId").alias("_st"), "poEarlyShipDate")
    rows = rows.join(pos, "soName", "left")
    rows = lookup(lookup(rows, t.md_ShipToDestination, {"_st": "shipToId"}, _pod="pod"), t.md_Port, {"_pod": "portId"}, pod="portName")
    checked = validate(rows, [Rule("{} is not in production", F.col("soStatus") != SO["production"], F.col("soName")),
                              Rule("{} is neither approved nor released", F.col("poId").isNotNull() & ~F.col("poStatus").isin(PO["released"], PO["approved"]), F.col("poName"))],
                       "soHeaderId", ["requestId"])
    lines = t.poLineItem.where(F.col("itemStatus").isin(PO["released"], PO["approved"]) & (F.col("qty") > F.col("lrQty"))) \
        .select(F.col("poId").alias("_p"), "podetailsId", "invID", "supplierSku", "merchantSku", (F.col("qty") - F.col("lrQty")).alias("qty"))
    out = lookup(checked.accepted.join(lines, F.col("poId") == F.col("_p")), t.md_Inventory, {"invID": "invID"}, "inner", productName="productName")
    empty = F.lit("")
    return Export(out.select("poName", F.col("reference1").alias("customerPo"), "pod", "productName", "supplierSku", "merchantSku", F.col("qty").cast("string").alias("lrQty"),
                             F.date_format("poEarlyShipDate", "yyyyMMdd").alias("shipDate"), empty.alias("containerType"), empty.alias("containerSeq"), empty.alias("notes"),
                             empty.alias("qtyPerCarton"), F.col("podetailsId").alias("poDetailsId")), checked.errors)


def export_receipt_template(t: Tables, as_of, ids: DataFrame | None = None) -> DataFrame:
    """Released POs in the two-record layout of the receipt file: one DO row and a DL row per line."""
    pos = t.poHeader.where(F.col("poStatus") == PO["released"])
    pos = pos if ids is None else pos.join(ids, "poId", "left_semi")
    lines = t.poLineItem.where(F.col("itemStatus") == PO["released"]).select("poId", "supplierSku", "qty").join(pos.select("poId", "poName"), "poId")
    empty = F.lit("")
    head = lines.select("poId").distinct().select("poId", F.lit("DO").alias("recordType"), empty.alias("doNo"), F.lit(str(as_of)).alias("column2"), empty.alias("column3"),
                                                  empty.alias("column4"), empty.alias("column5"), empty.alias("column6"))
    tail = lines.select("poId", F.lit("DL").alias("recordType"), empty.alias("doNo"), F.col("poName").alias("column2"), empty.alias("column3"), F.col("supplierSku").alias("column4"),
                        F.col("qty").cast("string").alias("column5"), empty.alias("column6"))
    return head.unionByName(tail)


# --- work-order corrections -------------------------------------------------------------------------------------

class WorkOrderCorrected(NamedTuple):
    lines: DataFrame
    so_lines: DataFrame
    headers: DataFrame
    audit: DataFrame
    errors: DataFrame


def correct_confirm_qty(t: Tables, requests: DataFrame) -> WorkOrderCorrected:
    """New quantities (requestId, workOrderLineItemId, newQty, newConfirmQty, notes): the difference goes back to the order line."""
    rows = requests.join(t.workOrderLineItem, "workOrderLineItemId")
    checked = validate(rows, [Rule("A note is required", blank("notes")), Rule("{} confirms more than its quantity", F.col("newConfirmQty") > F.col("newQty"), F.col("workOrderLineItemId"))],
                       "workOrderLineItemId", ["requestId"])
    good = checked.accepted
    note = F.when(blank("workOrderItemNote"), F.col("notes")).otherwise(F.concat("workOrderItemNote", F.lit(", "), "notes"))
    lines = good.withColumns({"qty": F.col("newQty"), "confirmQty": F.col("newConfirmQty"), "workOrderItemNote": note}).select(*t.workOrderLineItem.columns)
    delta = good.withColumn("_back", F.col("confirmQty") - F.col("newConfirmQty"))
    so_lines = add_qty(t.soLineItem, delta, "soLineItemId", "processQty", "_back", -1)
    counts = good.groupBy("workOrderHeaderId").agg(F.count(F.lit(1)).alias("_n"))
    heads = t.workOrderHeader.join(counts, "workOrderHeaderId").withColumn("revision", (F.col("revision") + F.col("_n")).cast("int")).select(*t.workOrderHeader.columns)
    changes = good.select("workOrderHeaderId", "workOrderLineItemId", F.lit("UpdateConfirmQty").alias("column"), F.col("confirmQty").cast("string").alias("oldValue"),
                          F.col("newConfirmQty").cast("string").alias("newValue"))
    return WorkOrderCorrected(lines, so_lines, heads, audit_feed(changes, "workOrderHeaderId", ["workOrderLineItemId"], t.workOrderHeader), checked.errors)


class Retargeted(NamedTuple):
    headers: DataFrame
    audit: DataFrame


def move_target_dates(t: Tables, requests: DataFrame) -> Retargeted:
    """New target dates (workOrderHeaderId, newTargetDate), revision up, old and new date in the audit feed."""
    rows = requests.where(F.col("newTargetDate").isNotNull()).join(t.workOrderHeader, "workOrderHeaderId")
    heads = rows.withColumns({"targetCompleteDate": F.col("newTargetDate"), "revision": (F.col("revision") + 1).cast("int")}).select(*t.workOrderHeader.columns)
    changes = rows.select("workOrderHeaderId", F.lit("TargetCompleteDate").alias("column"), F.col("targetCompleteDate").cast("string").alias("oldValue"),
                          F.col("newTargetDate").cast("string").alias("newValue"))
    return Retargeted(heads, audit_feed(changes, "workOrderHeaderId", ["newValue"], t.workOrderHeader))
