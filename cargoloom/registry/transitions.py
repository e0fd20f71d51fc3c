"""Transitions over requests for all documents, grouped as callers would: same state, neighbouring keys."""

from pyspark.sql import functions as F

from ..plans import transitions as T
from . import register

AS_OF = "1999-06-30"


def _requests(df, key, status):
    return df.select(F.concat(F.col(status).cast("string"), F.lit("-"), (F.col(key) - F.col(key) % 40).cast("string")).alias("requestId"), key,
                     F.when(F.col(key) % 13 == 0, "").otherwise("reason").alias("notes"))


def _q(table, key, status):
    return f"""q AS (SELECT CAST({status} AS VARCHAR) || '-' || CAST({key} - {key} % 40 AS VARCHAR) AS requestId, {key},
                     CASE WHEN {key} % 13 = 0 THEN '' ELSE 'reason' END AS notes FROM {table})"""


class Check:
    """CTEs ``r`` (requested rows) and ``k`` (accepted rows) for a list of SQL rules."""

    def __init__(self, table, key, status, rules, extra="", allowed=None, ctes=""):
        self.key = key
        self.rules = rules
        any_rule = " OR ".join(f"coalesce({c}, false)" for c, _ in rules) or "false"
        within = f" AND {status} IN {allowed}" if allowed else ""
        self.sql = f"""WITH {ctes}{_q(table, key, status)}, r AS (SELECT q.requestId, q.notes, h.* {extra} FROM q JOIN {table} h ON h.{key} = q.{key}),
            k AS (SELECT * FROM r WHERE requestId NOT IN (SELECT requestId FROM r WHERE {any_rule}){within})"""

    def errors(self):
        return self.sql + " " + " UNION ALL ".join(f"SELECT requestId, {self.key}, {i} AS ruleNo, CAST({n} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, n) in enumerate(self.rules, 1))

    def __call__(self, text):
        return f"{self.sql} {text}"


def _errors(run):
    return lambda t: run(t).errors.drop("rule")


def _pick(run, part, *columns):
    return lambda t: getattr(run(t), part).select(*columns)


# --- sales orders
def _so(t):
    return _requests(t.soHeader, "soHeaderId", "soStatus")


confirm = lambda t: T.confirm_sales_orders(t, _so(t))
_c = Check("soHeader", "soHeaderId", "soStatus", [
    ("coalesce(portOfDestination, 0) = 0", "soName"), ("supplierId = 0 AND isMarketing = 1", "soName"), ("NOT live", "soName"), ("untagged AND isMarketing = 0", "soName"),
    ("soStatus = 1106", "soName"), ("soStatus = 6237", "soName"), ("soStatus = 1107", "soName"), ("soStatus = 1108", "soName"), ("soStatus NOT IN (2144, 1105)", "soName")],
    extra=""", (SELECT isMarketing FROM md_Company x WHERE x.companyId = h.companyId) AS isMarketing,
    EXISTS (SELECT 1 FROM soLineItem l WHERE l.soHeaderId = h.soHeaderId AND l.soLineItemStatus IN (1105, 1106, 2144, 2125)) AS live,
    EXISTS (SELECT 1 FROM soLineItem l WHERE l.soHeaderId = h.soHeaderId AND l.tagDivision = 3234) AS untagged""")
register("confirm_sales_orders_errors", _errors(confirm), _c.errors())
register("confirm_sales_orders_headers", _pick(confirm, "headers", "soHeaderId", "soName", "soStatus", "apiStatus"),
         _c("SELECT soHeaderId, replace(soName, 'tempSO_', '') AS soName, 1106 AS soStatus, '_NEW_' AS apiStatus FROM k"))
register("confirm_sales_orders_lines", _pick(confirm, "lines", "soLineItemId", "soLineItemStatus"),
         _c("SELECT l.soLineItemId, 1106 AS soLineItemStatus FROM soLineItem l JOIN k ON k.soHeaderId = l.soHeaderId WHERE l.soLineItemStatus IN (2144, 1105)"))

approve = lambda t: T.approve_sales_orders(t, _so(t))
_c = Check("soHeader", "soHeaderId", "soStatus", [(f"soStatus = {s}", "soName") for s in (6237, 2125, 1107, 1108)] + [("soStatus <> 1106", "soName")])
register("approve_sales_orders_errors", _errors(approve), _c.errors())
register("approve_sales_orders_headers", _pick(approve, "headers", "soHeaderId", "soStatus", "apiStatus"), _c("SELECT soHeaderId, 6237 AS soStatus, '_APPR_' AS apiStatus FROM k"))
register("approve_sales_orders_lines", _pick(approve, "lines", "soLineItemId", "soLineItemStatus"),
         _c("SELECT l.soLineItemId, 6237 AS soLineItemStatus FROM soLineItem l JOIN k ON k.soHeaderId = l.soHeaderId WHERE l.soLineItemStatus = 1106"))

cancel = lambda t: T.cancel_sales_orders(t, _so(t))
_c = Check("soHeader", "soHeaderId", "soStatus", [("poQty <> 0", "soName"), ("soStatus = 1108", "soName"), ("soStatus = 1107", "soName")],
           extra=", coalesce((SELECT sum(poQty) FROM soLineItem l WHERE l.soHeaderId = h.soHeaderId AND l.soLineItemStatus <> 1107), 0) AS poQty")
register("cancel_sales_orders_errors", _errors(cancel), _c.errors())
register("cancel_sales_orders_headers", _pick(cancel, "headers", "soHeaderId", "soStatus", "soNote", "apiStatus"),
         _c("SELECT soHeaderId, 1107 AS soStatus, CASE WHEN soNote <> '' THEN soNote || '|' ELSE '' END || notes AS soNote, '_CXL_' AS apiStatus FROM k"))
register("cancel_sales_orders_lines", _pick(cancel, "lines", "soLineItemId", "soLineItemStatus"),
         _c("SELECT l.soLineItemId, 1107 AS soLineItemStatus FROM soLineItem l JOIN k ON k.soHeaderId = l.soHeaderId"))
register("cancel_sales_orders_po_lines", _pick(cancel, "po_lines", "podetailsId", "itemStatus"),
         _c("""SELECT l.podetailsId, 1086 AS itemStatus FROM poLineItem l JOIN poHeader p ON p.poId = l.poId AND p.poStatus = 2143 JOIN k ON k.soName = p.poReferenceId WHERE l.itemStatus = 2143"""))

_line_requests = lambda t: t.soLineItem.select("soHeaderId", "soLineItemId")
cancel_lines = lambda t: T.cancel_sales_order_lines(t, _line_requests(t), AS_OF)
register("cancel_sales_order_lines_deleted", lambda t: cancel_lines(t).deleted,
         "SELECT l.soLineItemId FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId WHERE h.soStatus = 1105")
register("cancel_sales_order_lines_marked", _pick(cancel_lines, "lines", "soLineItemId", "soLineItemStatus", "odrQty"), """
SELECT l.soLineItemId, 1107 AS soLineItemStatus, 0 AS odrQty FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId WHERE h.soStatus <> 1105""")
register("cancel_sales_order_lines_headers", _pick(cancel_lines, "headers", "soHeaderId", "lastUpdatedDate"), f"""
SELECT DISTINCT h.soHeaderId, '{AS_OF}' AS lastUpdatedDate FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId WHERE h.soStatus <> 1105""")

close = lambda t: T.close_sales_orders(t, t.soHeader.select(F.concat(F.col("soStatus").cast("string"), F.lit("-"), F.col("soHeaderId").cast("string")).alias("requestId"), "soHeaderId",
                                                            F.when(F.col("soHeaderId") % 13 == 0, "").otherwise("reason").alias("notes")))
_CLOSE = """WITH k AS (SELECT * FROM soHeader h WHERE soHeaderId % 13 <> 0 AND soStatus <> 1107
    AND NOT EXISTS (SELECT 1 FROM poHeader p WHERE p.poReferenceId = h.soName AND p.poStatus NOT IN (1086, 1087)))"""
register("close_sales_orders_headers", _pick(close, "headers", "soHeaderId", "soStatus", "apiStatus"), _CLOSE + " SELECT soHeaderId, 1108 AS soStatus, '_NEW_' AS apiStatus FROM k")
register("close_sales_orders_lines", _pick(close, "lines", "soLineItemId", "soLineItemStatus"),
         _CLOSE + " SELECT l.soLineItemId, 1108 AS soLineItemStatus FROM soLineItem l JOIN k ON k.soHeaderId = l.soHeaderId WHERE l.soLineItemStatus <> 1107")

reopen = lambda t: T.reopen_sales_orders(t, _so(t), AS_OF)
_c = Check("soHeader", "soHeaderId", "soStatus", [("soStatus = 1107", "soName")], allowed="(1106, 2125)")
register("reopen_sales_orders_errors", _errors(reopen), _c.errors())
register("reopen_sales_orders_headers", _pick(reopen, "headers", "soHeaderId", "soStatus", "apiStatus", "lastUpdatedDate"),
         _c(f"SELECT soHeaderId, 2144 AS soStatus, '_REOP_' AS apiStatus, '{AS_OF}' AS lastUpdatedDate FROM k"))
register("reopen_sales_orders_lines", _pick(reopen, "lines", "soLineItemId", "soLineItemStatus", "poQty"),
         _c("SELECT l.soLineItemId, 2144 AS soLineItemStatus, 0 AS poQty FROM soLineItem l JOIN k ON k.soHeaderId = l.soHeaderId WHERE l.soLineItemStatus <> 1107"))
register("reopen_sales_orders_po_lines", _pick(reopen, "po_lines", "podetailsId", "itemStatus"),
         _c("SELECT l.podetailsId, 2143 AS itemStatus FROM poLineItem l JOIN poHeader p ON p.poId = l.poId JOIN k ON k.soName = p.poReferenceId AND k.soStatus = 2125"))


# --- purchase orders
def _po(t):
    return _requests(t.poHeader, "poId", "poStatus")


def _po_pair(name, run, check, to, allowed, note="poNote"):
    register(f"{name}_errors", _errors(run), check.errors())
    register(f"{name}_headers", _pick(run, "headers", "poId", "poStatus", "poNote"), check(f"SELECT poId, {to} AS poStatus, {note} AS poNote FROM k"))
    register(f"{name}_lines", _pick(run, "lines", "podetailsId", "itemStatus"),
             check(f"SELECT l.podetailsId, {to} AS itemStatus FROM poLineItem l JOIN k ON k.poId = l.poId WHERE l.itemStatus IN {allowed}"))


_NOTED = "CASE WHEN poNote <> '' THEN poNote || '|' ELSE '' END || notes"
_po_pair("confirm_purchase_orders", lambda t: T.confirm_purchase_orders(t, _po(t)),
         Check("poHeader", "poId", "poStatus", [("poStatus = 1080", "poName"), ("poStatus NOT IN (1079, 1078)", "poName")]), 1080, "(1079, 1078)")
_po_pair("approve_purchase_orders", lambda t: T.approve_purchase_orders(t, _po(t)),
         Check("poHeader", "poId", "poStatus", [("poStatus = 1085", "poName"), ("poStatus = 1078", "poName"), ("poStatus <> 1080", "poName")]), 1085, "(1080)")
_po_pair("reject_purchase_orders", lambda t: T.reject_purchase_orders(t, _po(t)),
         Check("poHeader", "poId", "poStatus", [("notes = ''", "poName"), ("poStatus = 1085", "poName"), ("poStatus = 1078", "poName"), ("poStatus = 1086", "poName"), ("poStatus <> 1080", "poName")]),
         1078, "(1080)", _NOTED)
cancel_po = lambda t: T.cancel_purchase_orders(t, _po(t))
_c = Check("poHeader", "poId", "poStatus", [("notes = ''", "poName"), ("poStatus = 1085", "poName"), ("poStatus = 1086", "poName"), ("poStatus = 1087", "poName")])
register("cancel_purchase_orders_errors", _errors(cancel_po), _c.errors())
register("cancel_purchase_orders_headers", _pick(cancel_po, "po_headers", "poId", "poStatus", "poNote"), _c(f"SELECT poId, 1086 AS poStatus, {_NOTED} AS poNote FROM k"))
register("cancel_purchase_orders_order_lines", _pick(cancel_po, "lines", "soLineItemId", "soLineItemStatus", "poQty"),
         _c("SELECT DISTINCT s.soLineItemId, 1106 AS soLineItemStatus, 0 AS poQty FROM soLineItem s JOIN poLineItem l ON l.soLineItemId = s.soLineItemId JOIN k ON k.poId = l.poId"))
register("cancel_purchase_orders_orders", _pick(cancel_po, "headers", "soHeaderId", "soStatus"),
         _c("SELECT s.soHeaderId, 1106 AS soStatus FROM soHeader s WHERE s.soName IN (SELECT poReferenceId FROM k)"))


# --- loading requests
def _lr(t):
    return t.lrHeader.select(F.concat(F.col("lrStatus").cast("string"), F.lit("-"), (F.col("lrHeaderId") - F.col("lrHeaderId") % 40).cast("string")).alias("requestId"), "lrHeaderId",
                             F.lit("reason").alias("notes"))


def _lr_set(name, run, check, to, allowed, boxes=True):
    register(f"{name}_errors", _errors(run), check.errors())
    register(f"{name}_headers", _pick(run, "headers", "lrHeaderId", "lrName", "lrStatus"), check(f"SELECT lrHeaderId, lrName, {to} AS lrStatus FROM k"))
    if boxes:
        register(f"{name}_containers", _pick(run, "containers", "lrContainerId", "containerStatus"),
                 check(f"SELECT c.lrContainerId, {to} AS containerStatus FROM lrContainer c JOIN k ON k.lrHeaderId = c.lrHeaderId WHERE c.containerStatus IN {allowed}"))
    register(f"{name}_lines", _pick(run, "lines", "lrDetailsId", "itemStatus"),
             check(f"SELECT l.lrDetailsId, {to} AS itemStatus FROM lrLineItem l JOIN k ON k.lrHeaderId = l.lrHeaderId WHERE l.itemStatus IN {allowed}"))


def _states(*pairs):
    return [(c, "lrName") for c in pairs]


_lr_set("confirm_loading_requests", lambda t: T.confirm_loading_requests(t, _lr(t)),
        Check("lrHeader", "lrHeaderId", "lrStatus", _states("NOT EXISTS (SELECT 1 FROM lrContainer c WHERE c.lrHeaderId = r.lrHeaderId)", "lrStatus = 2133", "lrStatus NOT IN (2132, 2134, 2145)")),
        2133, "(2132, 2134, 2145)")
_lr_set("approve_loading_requests", lambda t: T.approve_loading_requests(t, _lr(t)),
        Check("lrHeader", "lrHeaderId", "lrStatus", _states("lrStatus = 2129", "lrStatus = 2134", "lrStatus <> 2133")), 2129, "(2133)")
_lr_set("reject_loading_requests", lambda t: T.reject_loading_requests(t, _lr(t)),
        Check("lrHeader", "lrHeaderId", "lrStatus", _states("lrStatus = 2134", "lrStatus = 2129", "lrStatus <> 2133")), 2134, "(2133)", boxes=False)
_lr_set("reopen_loading_requests", lambda t: T.reopen_loading_requests(t, _lr(t)),
        Check("lrHeader", "lrHeaderId", "lrStatus", _states("lrStatus = 2130", "lrStatus = 2131"), allowed="(2129)"), 2145, "(2129)", boxes=False)

cancel_lr = lambda t: T.cancel_loading_requests(t, _lr(t))
_c = Check("lrHeader", "lrHeaderId", "lrStatus", _states("lrStatus = 2130", "lrStatus = 2131", "lrStatus NOT IN (2132, 2134, 2145, 2135)"))
register("cancel_loading_requests_errors", _errors(cancel_lr), _c.errors())
register("cancel_loading_requests_headers", _pick(cancel_lr, "headers", "lrHeaderId", "lrStatus"), _c("""
SELECT lrHeaderId, 2130 AS lrStatus FROM k UNION SELECT m.lrHeaderId, 2130 FROM lrHeader m JOIN k ON m.ref_customerLrHeaderId = k.lrHeaderId WHERE m.lrStatus = 2135"""))
register("cancel_loading_requests_containers", _pick(cancel_lr, "containers", "lrContainerId", "containerStatus"), _c("""
, b AS (SELECT c.* FROM lrContainer c JOIN k ON k.lrHeaderId = c.lrHeaderId WHERE c.containerStatus IN (2132, 2134, 2145, 2135))
SELECT lrContainerId, 2130 AS containerStatus FROM b UNION SELECT m.lrContainerId, 2130 FROM lrContainer m JOIN b ON m.ref_lrContainerId = b.lrContainerId WHERE m.containerStatus IN (2132, 2134, 2145, 2135)"""))
register("cancel_loading_requests_po_lines", _pick(cancel_lr, "po_lines", "podetailsId", "lrQty"), _c("""
SELECT p.podetailsId, CAST(p.lrQty - sum(l.qty) AS INT) AS lrQty FROM lrLineItem l JOIN k ON k.lrHeaderId = l.lrHeaderId JOIN poLineItem p ON p.podetailsId = l.poDetailsId
WHERE l.itemStatus IN (2132, 2134, 2145, 2135) GROUP BY p.podetailsId, p.lrQty"""))

cancel_box = lambda t: T.cancel_containers(t, t.lrContainer.select(F.col("lrContainerId").cast("string").alias("requestId"), "lrContainerId"))
_BOX = """WITH b AS (SELECT * FROM lrContainer WHERE containerStatus IN (2132, 2134, 2145))"""
register("cancel_containers_errors", _errors(cancel_box), """
SELECT CAST(lrContainerId AS VARCHAR) AS requestId, lrContainerId, ruleNo, lrName || ' container ' || containerSeq AS "key" FROM (
  SELECT *, 1 AS ruleNo FROM lrContainer WHERE containerStatus = 2130 UNION ALL SELECT *, 2 FROM lrContainer WHERE containerStatus = 2131
  UNION ALL SELECT *, 3 FROM lrContainer WHERE containerStatus NOT IN (2132, 2134, 2145))""")
register("cancel_containers_containers", _pick(cancel_box, "containers", "lrContainerId", "containerStatus"), _BOX + """
SELECT lrContainerId, 2130 AS containerStatus FROM b UNION SELECT m.lrContainerId, 2130 FROM lrContainer m JOIN b ON m.ref_lrContainerId = b.lrContainerId WHERE m.containerStatus IN (2132, 2134, 2145)""")
register("cancel_containers_po_lines", _pick(cancel_box, "po_lines", "podetailsId", "lrQty"), _BOX + """
SELECT p.podetailsId, CAST(p.lrQty - sum(l.qty) AS INT) AS lrQty FROM lrLineItem l JOIN b ON b.lrContainerId = l.lrContainerId JOIN poLineItem p ON p.podetailsId = l.poDetailsId
WHERE l.itemStatus IN (2132, 2134, 2145) GROUP BY p.podetailsId, p.lrQty""")


# --- work orders
def _wo(t):
    return t.workOrderHeader.select(F.concat(F.col("workOrderStatus").cast("string"), F.lit("-"), (F.col("workOrderHeaderId") - F.col("workOrderHeaderId") % 40).cast("string")).alias("requestId"),
                                    "workOrderHeaderId")


close_wo = lambda t: T.close_work_orders(t, _wo(t))
_c = Check("workOrderHeader", "workOrderHeaderId", "workOrderStatus", [("workOrderStatus <> 5230", "workOrderName")])
_MADE = ", m AS (SELECT l.*, k.companyId, k.warehouseId, k.workOrderName FROM workOrderLineItem l JOIN k ON k.workOrderHeaderId = l.workOrderHeaderId WHERE l.workOrderItemStatus = 5230)"
register("close_work_orders_errors", _errors(close_wo), _c.errors())
register("close_work_orders_headers", _pick(close_wo, "headers", "workOrderHeaderId", "workOrderStatus"), _c("SELECT workOrderHeaderId, 5231 AS workOrderStatus FROM k"))
register("close_work_orders_movements", lambda t: close_wo(t).movements, _c(_MADE + """
SELECT warehouseId, companyId, 'PROD' AS action, workOrderName AS actionKey, invId, qty, soName AS reason FROM m"""))
register("close_work_orders_locks", lambda t: close_wo(t).locks, _c(_MADE + " SELECT companyId, warehouseId, invId, soHeaderId, soLineItemId, qty AS lockQty FROM m"))
register("close_work_orders_balances", lambda t: close_wo(t).balances, _c(_MADE + """
, d AS (SELECT warehouseId, companyId, invId, CAST(sum(qty) AS BIGINT) AS q FROM m GROUP BY ALL)
SELECT coalesce(b.warehouseId, d.warehouseId) AS warehouseId, coalesce(b.companyId, d.companyId) AS companyId, coalesce(b.invId, d.invId) AS invId,
       coalesce(b.balanceQty, 0) + coalesce(d.q, 0) AS balanceQty, coalesce(b.lockQty, 0) + coalesce(d.q, 0) AS lockQty
FROM inventoryBalanceWH b FULL JOIN d ON d.warehouseId = b.warehouseId AND d.companyId = b.companyId AND d.invId = b.invId"""))

cancel_wo = lambda t: T.cancel_work_order_lines(t, t.workOrderLineItem.select(
    F.col("workOrderLineItemId").alias("requestId"), "workOrderLineItemId", F.when(F.col("qty") == 3, "").otherwise("broken").alias("notes")))
_WOL = "WITH k AS (SELECT * FROM workOrderLineItem WHERE qty <> 3 AND workOrderItemStatus <> 5236)"
register("cancel_work_order_lines_errors", _errors(cancel_wo), """
SELECT workOrderLineItemId AS requestId, workOrderLineItemId, 1 AS ruleNo, '' AS "key" FROM workOrderLineItem WHERE qty = 3
UNION ALL SELECT workOrderLineItemId, workOrderLineItemId, 2, CAST(workOrderLineItemId AS VARCHAR) FROM workOrderLineItem WHERE workOrderItemStatus = 5236""")
register("cancel_work_order_lines_lines", _pick(cancel_wo, "lines", "workOrderLineItemId", "confirmQty", "workOrderItemStatus", "workOrderItemNote"),
         _WOL + " SELECT workOrderLineItemId, 0 AS confirmQty, 5236 AS workOrderItemStatus, 'broken' AS workOrderItemNote FROM k")
register("cancel_work_order_lines_order_lines", _pick(cancel_wo, "so_lines", "soLineItemId", "processQty"),
         _WOL + " SELECT s.soLineItemId, CAST(s.processQty - k.confirmQty AS INT) AS processQty FROM soLineItem s JOIN k ON k.soLineItemId = s.soLineItemId")
register("cancel_work_order_lines_headers", _pick(cancel_wo, "headers", "workOrderHeaderId", "revision"), _WOL + """
SELECT h.workOrderHeaderId, CAST(h.revision + count(*) AS INT) AS revision FROM workOrderHeader h JOIN k ON k.workOrderHeaderId = h.workOrderHeaderId GROUP BY h.workOrderHeaderId, h.revision""")
register("cancel_work_order_lines_audit", _pick(cancel_wo, "audit", "workOrderHeaderId", "workOrderLineItemId", "revisionNo", "payload"), _WOL + """
SELECT k.workOrderHeaderId, k.workOrderLineItemId, h.revision + row_number() OVER (PARTITION BY k.workOrderHeaderId ORDER BY k.workOrderLineItemId) AS revisionNo,
       '{"column":"CancelItem","oldValue":"' || k.confirmQty || '","newValue":"0"}' AS payload
FROM k JOIN workOrderHeader h ON h.workOrderHeaderId = k.workOrderHeaderId""")

# --- shipments, items, notices
_ship_requests = lambda t: t.shipmentHeader.select(F.concat(F.col("shipmentDate").cast("string"), F.lit("-"), F.col("companyId").cast("string"), F.lit("-"),
                                                            (F.col("shipmentId") % 6).cast("string")).alias("requestId"), "shipmentId")
invoice = lambda t: T.create_invoices(t, _ship_requests(t), AS_OF)
_INV = """WITH r AS (SELECT CAST(shipmentDate AS VARCHAR) || '-' || companyId || '-' || shipmentId % 6 AS requestId, * FROM shipmentHeader),
k AS (SELECT * FROM r WHERE requestId NOT IN (SELECT requestId FROM r WHERE shipmentStatus = 2150 OR invoiceId <> '')),"""
register("create_invoices_headers", _pick(invoice, "headers", "shipmentId", "invoiceId", "invoiceDate"), _INV + f"""
g AS (SELECT requestId, min(companyId) AS companyId FROM k GROUP BY 1), n AS (SELECT requestId, companyId, row_number() OVER (PARTITION BY companyId ORDER BY requestId) AS n FROM g)
SELECT k.shipmentId, replace(replace(s.ItemFormat, 'yy', '99'), 'xxxxx', lpad(CAST(s.NextNum + n.n - 1 AS VARCHAR), 5, '0')) AS invoiceId, '{AS_OF}' AS invoiceDate
FROM k JOIN n ON n.requestId = k.requestId JOIN md_SequenceNumber s ON s.csID = n.companyId AND s.condition = 'INV'""")
register("create_invoices_errors", _errors(invoice), _INV.rstrip(",") + """
SELECT requestId, shipmentId, 2 AS ruleNo, bol AS "key" FROM r WHERE shipmentStatus = 2150 UNION ALL SELECT requestId, shipmentId, 3, bol FROM r WHERE invoiceId <> ''""")

deactivate = lambda t: T.deactivate_items(t, t.md_Inventory.select(F.col("invID").cast("string").alias("requestId"), "invID"))
_ITEM = """WITH r AS (SELECT i.*, EXISTS (SELECT 1 FROM md_CustomerSku c WHERE c.invID = i.invID AND c.statusflag = 1) AS sold,
    EXISTS (SELECT 1 FROM md_SupplierSku s WHERE s.invId = i.invID AND s.statusflag = 1) AS bought FROM md_Inventory i)"""
register("deactivate_items_changed", _pick(deactivate, "items", "invID", "status"), _ITEM + " SELECT invID, 0 AS status FROM r WHERE status <> 0 AND NOT sold AND NOT bought")
register("deactivate_items_errors", _errors(deactivate), _ITEM + """
SELECT CAST(invID AS VARCHAR) AS requestId, invID, 1 AS ruleNo, inventorySKU AS "key" FROM r WHERE status = 0 UNION ALL SELECT CAST(invID AS VARCHAR), invID, 2, inventorySKU FROM r WHERE sold
UNION ALL SELECT CAST(invID AS VARCHAR), invID, 3, inventorySKU FROM r WHERE bought""")
register("switch_boms", lambda t: T.switch_boms(t, t.md_Inventory.select(F.col("invID").alias("invId"), F.when(F.col("isBuffer") == 1, "ReactiveRawBom").otherwise("DeleteRawBom").alias("action")))
         .select("rawBomId", "invId", "status"), """
SELECT b.rawBomId, b.invId, i.isBuffer AS status FROM rawBom b JOIN md_Inventory i ON i.invID = b.invId WHERE b.status <> i.isBuffer""")
register("mark_notices_read", lambda t: T.mark_read(t, t.soHeader.select(F.lit(1).alias("userID"), F.col("companyId").alias("corporateId"), F.lit("SalesOrder").alias("sourceModule"),
                                                                          F.col("soHeaderId").alias("sourceRecordId"))), """
SELECT n.recipientId, n.notificationID, n.userID, 1 AS isRead FROM notificationRecipient n JOIN actionNotification a ON a.actionNotificationID = n.notificationID
JOIN soHeader h ON h.soHeaderId = a.sourceRecordId AND h.companyId = a.corporateId WHERE a.sourceModule = 'SalesOrder' AND n.userID = 1 AND n.isRead = 0""")
