"""Outbound digests: rows waiting at an ``apiStatus`` flag, their lines, recipients, and the advanced flag.

A digest is a table of lines, one row per document line with its document's
facts, so a company with very many documents is not gathered anywhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators.lookup import lookup, resolve
from ..operators.validate import Rule, validate
from ..sources.tables import Tables
from .transitions import LR, SO


class Digest(NamedTuple):
    lines: DataFrame
    recipients: DataFrame
    advanced: DataFrame


def recipients(t: Tables, action: str) -> DataFrame:
    """Addresses of each company for a kind of message, a row each."""
    kinds = t.md_EmailCategory.where(F.col("actionName") == action).select("emailCategoryId")
    live = t.md_EmailList.where(F.col("status") == 1).join(kinds, "emailCategoryId", "left_semi")
    return live.select("companyId", "emailAddress").distinct()


def _advance(heads: DataFrame, picked: DataFrame, key: str, to: str) -> DataFrame:
    return heads.join(picked.select(key), key, "left_semi").withColumn("apiStatus", F.lit(to))


def new_sales_orders(t: Tables) -> Digest:
    heads = t.soHeader.where(F.col("apiStatus") == "_NEW_")
    kind = F.when(F.col("lastUpdatedDate").isNotNull(), "REVISED").otherwise("NEW")
    lines = t.soLineItem.where(F.col("soLineItemStatus") != SO["cancelled"]).select("soLineItemId", "soHeaderId", "invID", "customerSku", "merchantSku", "odrQty")
    rows = lines.join(heads.select("soHeaderId", "companyId", "soName", kind.alias("kind"), "soDate", "customerPO", "earlyShipDate", "thirdParty"), "soHeaderId")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, inventorySku="inventorySKU").drop("invID")
    return Digest(rows, recipients(t, "New SO"), _advance(t.soHeader, heads, "soHeaderId", "_ACK_"))


def _order_digest(t: Tables, heads: DataFrame, action: str) -> Digest:
    """Order facts with PO and destination, lines, and the order's total quantity."""
    facts = lookup(heads, t.md_Company, {"companyId": "companyId"}, company="companyShortCode")
    facts = lookup(facts, t.md_ShipToDestination, {"shipToId": "shipToId"}, shipTo=F.coalesce("shipToLabel", F.lit("")))
    facts = resolve(facts, t.poHeader.select("poReferenceId", "poName", "poId"), {"soName": "poReferenceId"}, "poId", poName="poName")
    lines = lookup(t.soLineItem.select("soLineItemId", "soHeaderId", "invID", "customerSku", "merchantSku", "odrQty"), t.md_Inventory, {"invID": "invID"}, "inner",
                   itemCode="itemCode", modelNo="modelNo", inventorySku="inventorySKU", itemDesc="itemDesc")
    rows = lines.drop("invID").join(facts.select("soHeaderId", "companyId", "company", "soName", "customerPO", F.col("earlyShipDate").alias("shipDate"), "shipTo", "poName"), "soHeaderId")
    totals = rows.groupBy("soHeaderId").agg(F.sum("odrQty").alias("totalQty"))
    return Digest(rows.join(totals, "soHeaderId"), recipients(t, action), _advance(t.soHeader, heads, "soHeaderId", "_ACK_"))


def cancelled_sales_orders(t: Tables) -> Digest:
    """Cancelled orders; orders that never got beyond their temporary name are left alone."""
    return _order_digest(t, t.soHeader.where((F.col("apiStatus") == "_CXL_") & ~F.lower("soName").startswith("tempso")), "Cancel SO")


def reopened_sales_orders(t: Tables) -> Digest:
    return _order_digest(t, t.soHeader.where(F.col("apiStatus") == "_REOP_"), "Reopen SO")


def _request_digest(t: Tables, heads: DataFrame, boxes: DataFrame, action: str, to: str) -> Digest:
    rows = t.lrLineItem.where(F.col("itemStatus") == LR["released"]).select("lrDetailsId", "lrContainerId", "soHeaderId", "invID", F.col("qty").alias("lrQty"))
    rows = rows.join(boxes.select("lrContainerId", "lrHeaderId", "containerSeq", "earlyShipDate", "forwarderBookingNo"), "lrContainerId")
    rows = rows.join(heads.select("lrHeaderId", "companyId", "lrName", "lrShipDate"), "lrHeaderId")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, inventorySku="inventorySKU", itemDesc="productName")
    rows = lookup(rows, t.soHeader, {"soHeaderId": "soHeaderId"}, soName="soName", customerPO="customerPO", thirdParty="thirdParty")
    return Digest(rows.drop("invID", "lrContainerId", "soHeaderId"), recipients(t, action), _advance(t.lrHeader, heads, "lrHeaderId", to))


def released_loading_requests(t: Tables) -> Digest:
    return _request_digest(t, t.lrHeader.where(F.col("apiStatus") == "_REL_"), t.lrContainer.where(F.col("containerStatus") == LR["released"]), "Released LR", "_ACK_")


def ready_loading_requests(t: Tables) -> Digest:
    """Requests flagged ready whose containers have a booking number."""
    booked = t.lrContainer.where(~blank("forwarderBookingNo"))
    heads = t.lrHeader.where(F.col("apiStatus") == "_READYLOAD_").join(booked.select("lrHeaderId").distinct(), "lrHeaderId", "left_semi")
    return _request_digest(t, heads, booked, "Ready LR", "_ACKLOAD_")


def new_work_orders(t: Tables) -> Digest:
    heads = lookup(t.workOrderHeader.where(F.col("apiStatus") == "_NEW_"), t.md_Warehouse, {"warehouseId": "warehouseId"}, warehouse="label")
    rows = t.workOrderLineItem.select("workOrderLineItemId", "workOrderHeaderId", "soHeaderId", "soName", "invId", "qty") \
        .join(heads.select("workOrderHeaderId", "companyId", "workOrderName", "warehouse", "shipDate"), "workOrderHeaderId")
    rows = lookup(rows, t.soHeader, {"soHeaderId": "soHeaderId"}, customerPO="customerPO", thirdParty="thirdParty")
    rows = lookup(rows, t.md_Inventory, {"invId": "invID"}, itemCode="itemCode", SKU="inventorySKU", itemDesc="productName")
    return Digest(rows.drop("soHeaderId", "invId"), recipients(t, "New WO"), _advance(t.workOrderHeader, heads, "workOrderHeaderId", "_ACK_"))


class ShipmentMessage(NamedTuple):
    bols: DataFrame
    shipments: DataFrame
    advanced: DataFrame
    errors: DataFrame
    items: DataFrame
    ship_to: DataFrame


# States a shipment may be in for each message, and the state it gets.
_GATES = {"ASN": (("_RTG_", "_ASN_"), "_ASN_"), "RTG": (("_NEW_", "_RTG_"), "_RTG_"), "INV": (("_ASN_",), "_ASN_")}


def _ship_to(t: Tables, shipments: DataFrame) -> DataFrame:
    """The place a bill of lading goes to, that of its lowest shipment; a second street line moves the town to the third line."""
    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))
    first = shipments.groupBy("bol").agg(F.min_by("shipToId", "shipmentId").alias("shipToId"))
    places = t.md_ShipToDestination
    for column in ("shipToAddressLine2", "shipToState"):
        if column not in places.columns:
            places = places.withColumn(column, F.lit(""))
    parts = ["locNo", "shipToLabel", "shipToName", "shipToAddressLine1", "shipToAddressLine2", "shipToCity", "shipToState", "shipToPostCode", "country"]
    rows = lookup(first, places, {"shipToId": "shipToId"}, "inner", **{p: p for p in parts})
    rows = lookup(rows, t.md_MasterCategory.where(F.col("categoryParentID") == 1), {"country": "categoryId"}, _country="categoryName")
    town = F.concat(text("shipToCity"), F.lit(", "), text("shipToState"), F.lit(" "), text("shipToPostCode"), F.lit(", "), text("_country"))
    return rows.select("bol", "locNo", "shipToLabel", F.col("shipToName").alias("addressName"), F.concat(text("shipToAddressLine1"), F.lit(", ")).alias("address"),
                       F.when(blank("shipToAddressLine2"), town).otherwise(F.concat("shipToAddressLine2", F.lit(", "))).alias("address2"),
                       F.when(blank("shipToAddressLine2"), F.lit("")).otherwise(town).alias("address3"))


def shipment_message(t: Tables, kind: str, bols: DataFrame | None = None) -> ShipmentMessage:
    """Per bill of lading: gate on state and needed fields, then orders, quantity and weight, the items shipped and the place they go to.

    ASN needs the pick-up date, RTG the carrier's haulier and booking number;
    INV has the gate only.  One failing shipment stops its bill of lading.
    """
    states, to = _GATES[kind]
    ships = t.shipmentHeader if bols is None else t.shipmentHeader.join(bols, "bol", "left_semi")
    bol = F.col("bol")
    rules = [Rule("BOL is required", blank("bol")), Rule("{} is not in a state for the message", ~F.coalesce("apiStatus", F.lit("")).isin(*states), bol)]
    if kind == "ASN":
        rules.append(Rule("{} has no pick-up date", F.col("containerPullOutDate").isNull(), bol))
    if kind == "RTG":
        rules += [Rule("{} has no haulier", F.coalesce("haulierId", F.lit(0)) == 0, bol), Rule("{} has no booking", blank("forwarderBookingNo"), bol)]
    checked = validate(ships, rules, "shipmentId", ["bol"])
    good = checked.accepted
    shipped = t.shipmentLineItem.groupBy("shipmentId").agg(F.sum("shipQty").alias("ttlShipQty"))
    rows = good.select("bol", "companyId", "shipmentId", "shipId", "soName", "shipmentWeight").join(shipped, "shipmentId")
    per_bol = rows.groupBy("bol", "companyId").agg(F.count(F.lit(1)).alias("totalOrders"), F.sum("ttlShipQty").alias("totalOrdersQty"), F.sum("shipmentWeight").alias("totalWeight"))
    advanced = good.withColumn("apiStatus", F.lit(to)).select(*t.shipmentHeader.columns) if kind != "INV" else good.limit(0).select(*t.shipmentHeader.columns)
    items = good.select("bol", "shipmentId").join(t.shipmentLineItem.select("shipmentId", "shipmentLineItemId", "customerSku", "merchantSku", "shipQty"), "shipmentId")
    return ShipmentMessage(per_bol, rows, advanced, checked.errors, items, _ship_to(t, good))
