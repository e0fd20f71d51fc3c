"""The document transitions: one spec or short function each.

Functions take the tables and ``requests`` (requestId, key, notes) and return a
named tuple of the rows that change.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import allocate_numbers
from ..functions.text import blank
from ..operators.history import audit_feed
from ..operators.ledger import BALANCE_KEY, ledger_apply
from ..operators.lookup import lookup
from ..operators.transitions import LineSpec, TransitionSpec, append_note, move_lines, status_transition
from ..operators.validate import Rule, differs, flag_groups, validate
from ..sources.tables import Tables

# Document states.
SO = dict(draft=1105, confirmed=1106, approved=6237, production=2125, reopened=2144, cancelled=1107, closed=1108)
PO = dict(draft=1079, confirmed=1080, approved=1085, rejected=1078, released=1077, hold=2143, cancelled=1086, closed=1087)
LR = dict(draft=2132, confirmed=2133, approved=2129, rejected=2134, released=2135, reopened=2145, cancelled=2130, closed=2131)
WO = dict(open=5230, closed=5231, cancelled=5236)
SHIPMENT_CANCELLED = 2150
UNTAGGED = 3234


class Changed(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    errors: DataFrame


def _so(allowed, to, rejects=(), other="{} cannot change", **sets) -> TransitionSpec:
    return TransitionSpec("soHeaderId", "soName", "soStatus", tuple(SO[a] for a in allowed), SO[to], tuple((SO[s], m) for s, m in rejects), other, sets)


def _po(allowed, to, rejects=(), other="{} cannot change", **sets) -> TransitionSpec:
    return TransitionSpec("poId", "poName", "poStatus", tuple(PO[a] for a in allowed), PO[to], tuple((PO[s], m) for s, m in rejects), other, sets)


def _lr(allowed, to, rejects=(), other="{} cannot change", **sets) -> TransitionSpec:
    return TransitionSpec("lrHeaderId", "lrName", "lrStatus", tuple(LR[a] for a in allowed), LR[to], tuple((LR[s], m) for s, m in rejects), other, sets)


def _need_reason(name: str) -> Rule:
    return Rule("{} needs a reason", blank("notes"), F.col(name))


# --- sales orders ---------------------------------------------------------------------------------------------

def confirm_sales_orders(t: Tables, requests: DataFrame) -> Changed:
    lines = t.soLineItem.groupBy("soHeaderId").agg(
        F.bool_or(F.col("soLineItemStatus").isin(SO["draft"], SO["confirmed"], SO["reopened"], SO["production"])).alias("_live"),
        F.bool_or(F.col("tagDivision") == UNTAGGED).alias("_untagged"))
    heads = lookup(lookup(t.soHeader, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing"), lines, {"soHeaderId": "soHeaderId"},
                   _live="_live", _untagged="_untagged")
    name = F.col("soName")
    rules = [Rule("{} has no port", F.coalesce("portOfDestination", F.lit(0)) == 0, name),
             Rule("{} has no supplier", (F.coalesce("supplierId", F.lit(0)) == 0) & (F.col("_marketing") == 1), name),
             Rule("{} has no line to confirm", ~F.coalesce("_live", F.lit(False)), name),
             Rule("{} has lines without a division", F.col("_untagged") & (F.col("_marketing") == 0), name)]
    spec = _so(("reopened", "draft"), "confirmed",
               [("confirmed", "{} is confirmed already"), ("approved", "{} is approved already"), ("cancelled", "{} is cancelled"), ("closed", "{} is closed")],
               soName=F.replace("soName", F.lit("tempSO_"), F.lit("")), apiStatus=F.lit("_NEW_"))
    done = status_transition(heads, requests, spec, rules)
    lines = move_lines(t.soLineItem, done.accepted, LineSpec("soHeaderId", "soLineItemStatus", (SO["reopened"], SO["draft"])), SO["confirmed"])
    return Changed(done.headers.select(*t.soHeader.columns), lines, done.errors)


def approve_sales_orders(t: Tables, requests: DataFrame) -> Changed:
    spec = _so(("confirmed",), "approved", [("approved", "{} is approved already"), ("production", "{} is in production"), ("cancelled", "{} is cancelled"),
                                            ("closed", "{} is closed")], apiStatus=F.lit("_APPR_"))
    done = status_transition(t.soHeader, requests, spec)
    return Changed(done.headers, move_lines(t.soLineItem, done.accepted, LineSpec("soHeaderId", "soLineItemStatus", (SO["confirmed"],)), SO["approved"]), done.errors)


class OrderCascade(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    po_headers: DataFrame
    po_lines: DataFrame
    errors: DataFrame


def cancel_sales_orders(t: Tables, requests: DataFrame) -> OrderCascade:
    """Orders without PO quantity; their POs on hold are cancelled with them."""
    raised = t.soLineItem.where(F.col("soLineItemStatus") != SO["cancelled"]).groupBy("soHeaderId").agg(F.sum("poQty").alias("_poQty"))
    heads = lookup(t.soHeader, raised, {"soHeaderId": "soHeaderId"}, _poQty="_poQty")
    spec = _so(("draft", "confirmed", "approved", "production", "reopened"), "cancelled", [("closed", "{} is closed"), ("cancelled", "{} is cancelled already")], None,
               soNote=append_note("soNote"), apiStatus=F.lit("_CXL_"))
    done = status_transition(heads, requests, spec, [Rule("{} has a PO, cancel that first", F.coalesce("_poQty", F.lit(0)) != 0, F.col("soName"))])
    lines = move_lines(t.soLineItem, done.accepted, LineSpec("soHeaderId", "soLineItemStatus", None), SO["cancelled"])
    names = done.accepted.select(F.col("soName").alias("poReferenceId")).distinct()
    pos = t.poHeader.where(F.col("poStatus") == PO["hold"]).join(names, "poReferenceId", "left_semi").withColumn("poStatus", F.lit(PO["cancelled"])).select(*t.poHeader.columns)
    po_lines = move_lines(t.poLineItem, pos, LineSpec("poId", "itemStatus", (PO["hold"],)), PO["cancelled"])
    return OrderCascade(done.headers.select(*t.soHeader.columns), lines, pos, po_lines, done.errors)


class LinesCancelled(NamedTuple):
    deleted: DataFrame
    lines: DataFrame
    headers: DataFrame


def cancel_sales_order_lines(t: Tables, requests: DataFrame, as_of) -> LinesCancelled:
    """Lines of draft orders are deleted; of other orders marked cancelled with quantity 0."""
    asked = requests.select("soHeaderId", "soLineItemId").distinct().join(t.soHeader.select("soHeaderId", "soStatus"), "soHeaderId")
    picked = t.soLineItem.join(asked, ["soHeaderId", "soLineItemId"])
    draft = F.col("soStatus") == SO["draft"]
    columns = t.soLineItem.columns
    changed = picked.where(~draft).withColumns({"soLineItemStatus": F.lit(SO["cancelled"]), "odrQty": F.lit(0)}).select(*columns)
    touched = asked.where(~draft).select("soHeaderId").distinct()
    heads = t.soHeader.join(touched, "soHeaderId", "left_semi").withColumn("lastUpdatedDate", F.lit(as_of).cast("date"))
    return LinesCancelled(picked.where(draft).select("soLineItemId"), changed, heads)


def close_sales_orders(t: Tables, requests: DataFrame) -> Changed:
    """Orders none of whose POs is still running (neither cancelled nor closed)."""
    running = t.poHeader.where(~F.col("poStatus").isin(PO["cancelled"], PO["closed"])).select("poReferenceId").distinct()
    heads = lookup(t.soHeader, running, {"soName": "poReferenceId"}, _running="poReferenceId")
    spec = _so(("draft", "confirmed", "approved", "production", "reopened", "closed"), "closed", other=None, apiStatus=F.lit("_NEW_"))
    done = status_transition(heads, requests, spec, [_need_reason("soName"), Rule("{} has a PO that is not closed", F.col("_running").isNotNull(), F.col("soName"))])
    lines = move_lines(t.soLineItem, done.accepted, LineSpec("soHeaderId", "soLineItemStatus", None, (SO["cancelled"],)), SO["closed"])
    return Changed(done.headers.select(*t.soHeader.columns), lines, done.errors)


def reopen_sales_orders(t: Tables, requests: DataFrame, as_of) -> OrderCascade:
    """Confirmed or running orders reopen; POs of the running ones go on hold."""
    spec = _so(("confirmed", "production"), "reopened", [("cancelled", "{} is cancelled")], None, apiStatus=F.lit("_REOP_"), lastUpdatedDate=F.lit(as_of).cast("date"))
    done = status_transition(t.soHeader, requests, spec)
    lines = move_lines(t.soLineItem, done.accepted, LineSpec("soHeaderId", "soLineItemStatus", None, (SO["cancelled"],), {"poQty": F.lit(0)}), SO["reopened"])
    names = done.accepted.where(F.col("soStatus") == SO["production"]).select(F.col("soName").alias("poReferenceId")).distinct()
    pos = t.poHeader.join(names, "poReferenceId", "left_semi").withColumn("poStatus", F.lit(PO["hold"])).select(*t.poHeader.columns)
    po_lines = move_lines(t.poLineItem, pos, LineSpec("poId", "itemStatus", None), PO["hold"])
    return OrderCascade(done.headers, lines, pos, po_lines, done.errors)


# --- purchase orders ------------------------------------------------------------------------------------------

def _po_change(t: Tables, requests: DataFrame, spec: TransitionSpec, rules=()) -> Changed:
    done = status_transition(t.poHeader, requests, spec, rules)
    return Changed(done.headers, move_lines(t.poLineItem, done.accepted, LineSpec("poId", "itemStatus", spec.allowed), spec.to), done.errors)


def confirm_purchase_orders(t: Tables, requests: DataFrame) -> Changed:
    return _po_change(t, requests, _po(("draft", "rejected"), "confirmed", [("confirmed", "{} is confirmed already")]))


def approve_purchase_orders(t: Tables, requests: DataFrame) -> Changed:
    return _po_change(t, requests, _po(("confirmed",), "approved", [("approved", "{} is approved already"), ("rejected", "{} is rejected")], "{} is not confirmed"))


def reject_purchase_orders(t: Tables, requests: DataFrame) -> Changed:
    spec = _po(("confirmed",), "rejected", [("approved", "{} is approved already"), ("rejected", "{} is rejected already"), ("cancelled", "{} is cancelled")],
               "{} is not confirmed", poNote=append_note("poNote"))
    return _po_change(t, requests, spec, [_need_reason("poName")])


def cancel_purchase_orders(t: Tables, requests: DataFrame) -> OrderCascade:
    """PO and all its lines; the order lines behind them go back to confirmed with PO quantity 0."""
    spec = _po(("draft", "confirmed", "rejected", "released", "hold"), "cancelled",
               [("approved", "{} is approved"), ("cancelled", "{} is cancelled already"), ("closed", "{} is closed")], None, poNote=append_note("poNote"))
    done = status_transition(t.poHeader, requests, spec, [_need_reason("poName")])
    po_lines = move_lines(t.poLineItem, done.accepted, LineSpec("poId", "itemStatus", None), PO["cancelled"])
    bought = po_lines.select("soLineItemId").distinct()
    lines = t.soLineItem.join(bought, "soLineItemId", "left_semi").withColumns({"poQty": F.lit(0), "soLineItemStatus": F.lit(SO["confirmed"])}).select(*t.soLineItem.columns)
    names = done.accepted.select(F.col("poReferenceId").alias("soName")).distinct()
    heads = t.soHeader.join(names, "soName", "left_semi").withColumn("soStatus", F.lit(SO["confirmed"])).select(*t.soHeader.columns)
    return OrderCascade(heads, lines, done.headers, po_lines, done.errors)


# --- loading requests -----------------------------------------------------------------------------------------

class RequestChange(NamedTuple):
    headers: DataFrame
    containers: DataFrame
    lines: DataFrame
    errors: DataFrame


def _lr_change(t: Tables, requests: DataFrame, spec: TransitionSpec, rules=(), heads: DataFrame | None = None, containers=True, sets=None) -> RequestChange:
    done = status_transition(t.lrHeader if heads is None else heads, requests, spec, rules)
    boxes = move_lines(t.lrContainer, done.accepted, LineSpec("lrHeaderId", "containerStatus", spec.allowed, sets=sets or {}), spec.to)
    boxes = boxes if containers else boxes.limit(0)
    lines = move_lines(t.lrLineItem, done.accepted, LineSpec("lrHeaderId", "itemStatus", spec.allowed), spec.to)
    return RequestChange(done.headers.select(*t.lrHeader.columns), boxes, lines, done.errors)


def confirm_loading_requests(t: Tables, requests: DataFrame) -> RequestChange:
    typed = t.lrContainer.groupBy("lrHeaderId").agg(F.bool_and(F.coalesce("containerTypeId", F.lit(0)) != 0).alias("_typed"))
    heads = lookup(t.lrHeader, typed, {"lrHeaderId": "lrHeaderId"}, _typed="_typed")
    plain = F.replace("lrName", F.lit("tempLR_"), F.lit(""))
    spec = _lr(("draft", "rejected", "reopened"), "confirmed", [("confirmed", "{} is confirmed already")], lrName=plain)
    return _lr_change(t, requests, spec, [Rule("{} has a container without type", ~F.coalesce("_typed", F.lit(False)), F.col("lrName"))], heads, sets={"lrName": plain})


def approve_loading_requests(t: Tables, requests: DataFrame) -> RequestChange:
    return _lr_change(t, requests, _lr(("confirmed",), "approved", [("approved", "{} is approved already"), ("rejected", "{} is rejected")], "{} is not confirmed"))


def reject_loading_requests(t: Tables, requests: DataFrame) -> RequestChange:
    return _lr_change(t, requests, _lr(("confirmed",), "rejected", [("rejected", "{} is rejected already"), ("approved", "{} is approved")], "{} is not confirmed"), containers=False)


def reopen_loading_requests(t: Tables, requests: DataFrame) -> RequestChange:
    return _lr_change(t, requests, _lr(("approved",), "reopened", [("cancelled", "{} is cancelled"), ("closed", "{} is closed")], None), containers=False)


class RequestCancelled(NamedTuple):
    headers: DataFrame
    containers: DataFrame
    lines: DataFrame
    po_lines: DataFrame
    errors: DataFrame


LR_CANCELLABLE = (LR["draft"], LR["rejected"], LR["reopened"], LR["released"])


def _give_back(t: Tables, cancelled: DataFrame) -> DataFrame:
    """PO lines with the cancelled quantity taken off their requested quantity."""
    back = cancelled.groupBy(F.col("poDetailsId").alias("_line")).agg(F.sum("qty").alias("_back"))
    return t.poLineItem.join(back, F.col("podetailsId") == F.col("_line")).withColumn("lrQty", (F.col("lrQty") - F.col("_back")).cast("int")).select(*t.poLineItem.columns)


def _mirrors(table: DataFrame, ref: str, cancelled: DataFrame, key: str, status: str, allowed: tuple[int, ...]) -> DataFrame:
    keys = cancelled.select(F.col(key).alias(ref)).distinct()
    return table.where(F.col(status).isin(*allowed)).join(keys, ref, "left_semi").withColumn(status, F.lit(LR["cancelled"])).select(*table.columns)


def cancel_loading_requests(t: Tables, requests: DataFrame) -> RequestCancelled:
    """Requests with containers, lines and their mirrors on the supplier's side; PO lines get the quantity back."""
    spec = _lr(("draft", "rejected", "reopened", "released"), "cancelled", [("cancelled", "{} is cancelled already"), ("closed", "{} is closed")])
    done = status_transition(t.lrHeader, requests, spec)
    boxes = move_lines(t.lrContainer, done.accepted, LineSpec("lrHeaderId", "containerStatus", LR_CANCELLABLE), LR["cancelled"])
    lines = move_lines(t.lrLineItem, done.accepted, LineSpec("lrHeaderId", "itemStatus", LR_CANCELLABLE, sets={"confirmQty": F.lit(0)}), LR["cancelled"])
    more_heads = _mirrors(t.lrHeader, "ref_customerLrHeaderId", done.headers, "lrHeaderId", "lrStatus", (LR["released"],))
    more_boxes = _mirrors(t.lrContainer, "ref_lrContainerId", boxes, "lrContainerId", "containerStatus", LR_CANCELLABLE)
    more_lines = _mirrors(t.lrLineItem, "ref_lrLineItemId", lines, "lrDetailsId", "itemStatus", LR_CANCELLABLE)
    return RequestCancelled(done.headers.unionByName(more_heads.join(done.headers, "lrHeaderId", "left_anti")),
                            boxes.unionByName(more_boxes.join(boxes, "lrContainerId", "left_anti")),
                            lines.unionByName(more_lines.join(lines, "lrDetailsId", "left_anti")), _give_back(t, lines), done.errors)


def cancel_containers(t: Tables, requests: DataFrame) -> RequestCancelled:
    """Single containers (requestId, lrContainerId) with their lines and mirrors."""
    named = t.lrContainer.withColumn("_label", F.concat("lrName", F.lit(" container "), F.col("containerSeq").cast("string")))
    spec = TransitionSpec("lrContainerId", "_label", "containerStatus", (LR["draft"], LR["rejected"], LR["reopened"]), LR["cancelled"],
                          ((LR["cancelled"], "{} is cancelled already"), (LR["closed"], "{} is closed")))
    done = status_transition(named, requests, spec)
    boxes = done.headers.select(*t.lrContainer.columns)
    lines = move_lines(t.lrLineItem, done.accepted, LineSpec("lrContainerId", "itemStatus", spec.allowed, sets={"confirmQty": F.lit(0)}), LR["cancelled"])
    more_boxes = _mirrors(t.lrContainer, "ref_lrContainerId", boxes, "lrContainerId", "containerStatus", spec.allowed)
    more_lines = _mirrors(t.lrLineItem, "ref_lrLineItemId", lines, "lrDetailsId", "itemStatus", spec.allowed)
    return RequestCancelled(t.lrHeader.limit(0), boxes.unionByName(more_boxes.join(boxes, "lrContainerId", "left_anti")),
                            lines.unionByName(more_lines.join(lines, "lrDetailsId", "left_anti")), _give_back(t, lines), done.errors)


# --- work orders ----------------------------------------------------------------------------------------------

class WorkOrderClosed(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    movements: DataFrame
    locks: DataFrame
    balances: DataFrame
    errors: DataFrame


def close_work_orders(t: Tables, requests: DataFrame) -> WorkOrderClosed:
    """Open work orders close: production enters stock and is locked for the order lines behind it."""
    spec = TransitionSpec("workOrderHeaderId", "workOrderName", "workOrderStatus", (WO["open"],), WO["closed"], other="{} is not open")
    done = status_transition(t.workOrderHeader, requests, spec)
    lines = move_lines(t.workOrderLineItem, done.accepted, LineSpec("workOrderHeaderId", "workOrderItemStatus", (WO["open"],)), WO["closed"])
    made = lines.join(done.accepted.select("workOrderHeaderId", "workOrderName", "companyId", "warehouseId"), "workOrderHeaderId")
    moves = made.select("warehouseId", "companyId", F.lit("PROD").alias("action"), F.col("workOrderName").alias("actionKey"), "invId", "qty", F.col("soName").alias("reason"))
    backed = made.where(F.col("soLineItemId").isNotNull() & ~blank("soLineItemId"))
    locks = backed.select("companyId", "warehouseId", "invId", "soHeaderId", "soLineItemId", F.col("qty").alias("lockQty"))
    return WorkOrderClosed(done.headers, lines, moves, locks, ledger_apply(moves, t.inventoryBalanceWH, locks), done.errors)


class LineCancelled(NamedTuple):
    lines: DataFrame
    so_lines: DataFrame
    headers: DataFrame
    audit: DataFrame
    errors: DataFrame


def _join_notes(old: str, new: str):
    return F.when(blank(new), F.col(old)).when(blank(old), F.col(new)).otherwise(F.concat(old, F.lit(", "), new))


def cancel_work_order_lines(t: Tables, requests: DataFrame) -> LineCancelled:
    """Lines (requestId, workOrderLineItemId, notes) are cancelled; their old confirmed quantity goes back to the order line."""
    picked = requests.join(t.workOrderLineItem, "workOrderLineItemId")
    checked = validate(picked, [Rule("A note is required", blank("notes")), Rule("{} is cancelled already", F.col("workOrderItemStatus") == WO["cancelled"], F.col("workOrderLineItemId"))],
                       "workOrderLineItemId", ["requestId"])
    before = checked.accepted
    lines = before.withColumns({"confirmQty": F.lit(0), "workOrderItemStatus": F.lit(WO["cancelled"]), "workOrderItemNote": _join_notes("workOrderItemNote", "notes")}) \
        .select(*t.workOrderLineItem.columns)
    back = before.groupBy(F.col("soLineItemId").alias("_line")).agg(F.sum("confirmQty").alias("_back"))
    so_lines = t.soLineItem.join(back, F.col("soLineItemId") == F.col("_line")).withColumn("processQty", (F.col("processQty") - F.col("_back")).cast("int")).select(*t.soLineItem.columns)
    counts = before.groupBy("workOrderHeaderId").agg(F.count(F.lit(1)).alias("_n"))
    heads = t.workOrderHeader.join(counts, "workOrderHeaderId").withColumn("revision", (F.col("revision") + F.col("_n")).cast("int")).select(*t.workOrderHeader.columns)
    changes = before.select("workOrderHeaderId", "workOrderLineItemId", F.lit("CancelItem").alias("column"), F.col("confirmQty").cast("string").alias("oldValue"), F.lit("0").alias("newValue"))
    return LineCancelled(lines, so_lines, heads, audit_feed(changes, "workOrderHeaderId", ["workOrderLineItemId"], t.workOrderHeader), checked.errors)


# --- shipments, items, notices --------------------------------------------------------------------------------

class Invoiced(NamedTuple):
    headers: DataFrame
    errors: DataFrame


def create_invoices(t: Tables, requests: DataFrame, as_of) -> Invoiced:
    """One invoice number per request, for live, not yet invoiced shipments of one date."""
    picked = flag_groups(requests.join(t.shipmentHeader, "shipmentId"), [(["requestId"], {"_dates": differs("shipmentDate")})])
    rules = [Rule("{} have different shipment dates", F.col("_dates"), F.col("bol")), Rule("{} is cancelled", F.col("shipmentStatus") == SHIPMENT_CANCELLED, F.col("bol")),
             Rule("{} has an invoice already", ~blank("invoiceId"), F.col("bol"))]
    checked = validate(picked, rules, "shipmentId", ["requestId"])
    per_request = checked.accepted.groupBy("requestId").agg(F.min("companyId").alias("companyId"))
    numbered = allocate_numbers(per_request, t.md_SequenceNumber, "INV", "companyId", ["requestId"], as_of, "_invoice").select("requestId", "_invoice")
    heads = checked.accepted.join(numbered, "requestId").withColumns({"invoiceId": F.col("_invoice"), "invoiceDate": F.lit(as_of).cast("date")})
    return Invoiced(heads.select(*t.shipmentHeader.columns), checked.errors)


class ItemsChanged(NamedTuple):
    items: DataFrame
    errors: DataFrame


def deactivate_items(t: Tables, requests: DataFrame) -> ItemsChanged:
    """Items without active customer or supplier SKU become inactive."""
    sold = t.md_CustomerSku.where(F.col("statusflag") == 1).select(F.col("invID").alias("_i")).distinct()
    bought = t.md_SupplierSku.where(F.col("statusflag") == 1).select(F.col("invId").alias("_i")).distinct()
    picked = requests.join(t.md_Inventory, "invID")
    picked = lookup(lookup(picked, sold, {"invID": "_i"}, _sold="_i"), bought, {"invID": "_i"}, _bought="_i")
    sku = F.col("inventorySKU")
    rules = [Rule("{} is inactive already", F.col("status") == 0, sku), Rule("{} has an active customer SKU", F.col("_sold").isNotNull(), sku),
             Rule("{} has an active supplier SKU", F.col("_bought").isNotNull(), sku)]
    checked = validate(picked, rules, "invID", ["requestId"])
    return ItemsChanged(checked.accepted.withColumn("status", F.lit(0)).select(*t.md_Inventory.columns), checked.errors)


def switch_boms(t: Tables, requests: DataFrame) -> DataFrame:
    """Component rows of items switched off (DeleteRawBom) or on (ReactiveRawBom); requests are (invId, action)."""
    wanted = F.when(F.col("action") == "DeleteRawBom", 0).when(F.col("action") == "ReactiveRawBom", 1)
    asked = requests.select("invId", wanted.alias("_to")).where(F.col("_to").isNotNull()).distinct()
    return t.rawBom.join(asked, "invId").where(F.col("status") != F.col("_to")).withColumn("status", F.col("_to")).select(*t.rawBom.columns)


def mark_read(t: Tables, requests: DataFrame) -> DataFrame:
    """Unread notices of a user about a record become read; requests are (userID, corporateId, sourceModule, sourceRecordId)."""
    key = ["corporateId", "sourceModule", "sourceRecordId"]
    hits = t.actionNotification.select(F.col("actionNotificationID").alias("notificationID"), *key).join(requests.distinct(), key).select("notificationID", "userID")
    unread = t.notificationRecipient.where(F.col("isRead").cast("int") == 0)
    return unread.join(hits.distinct(), ["notificationID", "userID"], "left_semi").withColumn("isRead", F.lit(1).cast(unread.schema["isRead"].dataType)) \
        .select(*t.notificationRecipient.columns)
