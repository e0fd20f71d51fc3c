"""Building blocks, functions, change capture and digests over whole tables."""

from pyspark.sql import functions as F

from ..functions import numbering
from ..functions.address import party_addresses
from ..functions.calendar import date_dimension, numbers_of
from ..functions.naming import product_name
from ..functions.payload import id_list, parse_payload, payload_text
from ..operators import history, ledger
from ..operators.lookup import config_value, lookup, pivot_attributes, rate_at, resolve
from ..operators.transitions import merge_rows
from ..operators.validate import in_file_duplicates, open_qty_guard, single_value_per_group
from ..plans import digests as D
from ..plans import transitions as T
from . import register
from .reports import _address, _config
from .transitions import _so

# --- payloads
# one payload per forty neighbouring orders, the size of a request
_payloads = lambda t: payload_text(t.soHeader.select((F.col("soHeaderId") - F.col("soHeaderId") % 40).alias("requestNo"), F.col("soHeaderId").cast("string").alias("soHeaderId"), "customerPO"), ["requestNo"],
                                   ["soHeaderId", "customerPO"], "soList")
register("payload_ids", lambda t: id_list(_payloads(t), "payload", "soList", "soHeaderId"), "SELECT soHeaderId FROM soHeader")
register("payload_rows", lambda t: parse_payload(_payloads(t), "payload", {"soHeaderId": "bigint", "customerPO": "int"}, "soList", keep=("requestNo",)),
         "SELECT soHeaderId - soHeaderId % 40 AS requestNo, soHeaderId, try_cast(customerPO AS INT) AS customerPO FROM soHeader")
register("payload_object", lambda t: parse_payload(t.soHeader.select(F.to_json(F.struct(F.col("soHeaderId").cast("string").alias("soHeaderId"), "soName")).alias("p")), "p", {"soHeaderId": "bigint", "soName": "string"}),
         "SELECT soHeaderId, soName FROM soHeader")

# --- look-ups and checks
register("resolve_lowest", lambda t: resolve(t.poLineItem.select("podetailsId", F.concat(F.upper("supplierSku"), F.lit("  ")).alias("sku")), t.poLineItem.select("supplierSku", "podetailsId", "qty"),
                                             {"sku": "supplierSku"}, "podetailsId", firstLine="podetailsId").drop("sku"),
         "SELECT podetailsId, min(podetailsId) OVER (PARTITION BY lower(supplierSku)) AS firstLine FROM poLineItem")
register("config_values", lambda t: config_value(t.soHeader.select("soHeaderId", "companyId"), t.md_DefaultConfig, "companyId", "CargoReadyDate", "days"),
         f"SELECT soHeaderId, companyId, {_config('h.companyId', 'CargoReadyDate')} AS days FROM soHeader h")
register("rates_at_order_date", lambda t: rate_at(config_value(t.soHeader.select("soHeaderId", "companyId", "soDate"), t.md_DefaultConfig, "companyId", "DefaultCurrency", "home").withColumn("fc", F.lit("USD")),
                                                  t.md_CurrencyRate, "companyId", "home", "fc", "soDate").select("soHeaderId", "rate"), """
SELECT h.soHeaderId, (SELECT arg_max(foreignRate, rateId) FROM md_CurrencyRate r WHERE r.status = 1 AND r.companyId = h.companyId AND r.homeCurrency = CASE h.companyId WHEN 2 THEN 'MYR' ELSE 'SGD' END
   AND r.foreignCurrency = 'USD' AND h.soDate BETWEEN r.startDate AND r.endDate) AS rate FROM soHeader h""")
register("attribute_columns", lambda t: pivot_attributes(lookup(t.inventory_attributes, t.md_MasterCategory, {"categoryId": "categoryId"}, _n="categoryName"), "invID", "_n", "value", ["color", "packing", "customer"]),
         """SELECT invID, max(CASE WHEN categoryId = 3194 THEN value END) AS color, max(CASE WHEN categoryId = 1123 THEN value END) AS packing, max(CASE WHEN categoryId = 3186 THEN value END) AS customer
            FROM inventory_attributes GROUP BY invID""")
register("duplicate_keys", lambda t: in_file_duplicates(t.soLineItem.select("soLineItemId", "soHeaderId", "invID"), ["soHeaderId", "invID"], "twice"),
         "SELECT soLineItemId, soHeaderId, invID, count(*) OVER (PARTITION BY soHeaderId, invID) > 1 AS twice FROM soLineItem")
register("mixed_groups", lambda t: single_value_per_group(t.lrLineItem.select("lrDetailsId", "lrContainerId", "itemStatus"), ["lrContainerId"], "itemStatus", "mixed"),
         "SELECT lrDetailsId, lrContainerId, itemStatus, min(itemStatus) OVER (PARTITION BY lrContainerId) <> max(itemStatus) OVER (PARTITION BY lrContainerId) AS mixed FROM lrLineItem")
register("over_requested", lambda t: open_qty_guard(lookup(t.lrLineItem.select("lrDetailsId", "poDetailsId", "qty"), t.poLineItem, {"poDetailsId": "podetailsId"}, openQty=F.col("qty") - F.col("lrQty")),
                                                    "poDetailsId", "qty", "openQty", "over"), """
SELECT l.lrDetailsId, l.poDetailsId, l.qty, p.qty - p.lrQty AS openQty, sum(l.qty) OVER (PARTITION BY l.poDetailsId) > p.qty - p.lrQty AS over FROM lrLineItem l LEFT JOIN poLineItem p ON p.podetailsId = l.poDetailsId""")

# --- ledger
register("ledger_balances", lambda t: ledger.balances_of(t.inventoryMovement), "SELECT warehouseId, companyId, invId, CAST(sum(qty) AS BIGINT) AS balanceQty FROM inventoryMovement GROUP BY ALL")
register("running_balance", lambda t: ledger.running_balance(t.inventoryMovement).select("inventoryMovementId", "whBalanceQty"), """
SELECT inventoryMovementId, CAST(sum(qty) OVER (PARTITION BY warehouseId, companyId, invId ORDER BY enterDate, inventoryMovementId ROWS UNBOUNDED PRECEDING) AS BIGINT) AS whBalanceQty FROM inventoryMovement""")
register("ledger_apply", lambda t: ledger.ledger_apply(t.inventoryMovement, t.inventoryBalanceWH), """
SELECT coalesce(b.warehouseId, d.warehouseId) AS warehouseId, coalesce(b.companyId, d.companyId) AS companyId, coalesce(b.invId, d.invId) AS invId, coalesce(b.balanceQty, 0) + coalesce(d.q, 0) AS balanceQty, coalesce(b.lockQty, 0) AS lockQty
FROM inventoryBalanceWH b FULL JOIN (SELECT warehouseId, companyId, invId, CAST(sum(qty) AS BIGINT) AS q FROM inventoryMovement GROUP BY ALL) d
  ON d.warehouseId = b.warehouseId AND d.companyId = b.companyId AND d.invId = b.invId""")
register("rolled_up_quantity", lambda t: ledger.roll_up_qty(t.soLineItem, t.shipmentLineItem, "soLineItemId", "shpQty", "shipQty").select("soLineItemId", "shpQty"),
         "SELECT l.soLineItemId, CAST(l.shpQty + coalesce((SELECT sum(shipQty) FROM shipmentLineItem s WHERE s.soLineItemId = l.soLineItemId), 0) AS INT) AS shpQty FROM soLineItem l")
register("complete_documents", lambda t: ledger.all_lines_in(t.poLineItem, "poId", "itemStatus", (1086, 1087)), "SELECT poId, bool_and(itemStatus IN (1086, 1087)) AS complete FROM poLineItem GROUP BY poId")
register("reserved_differences", lambda t: ledger.reserve(t.inventoryBalanceWh_Lock.withColumnRenamed("invid", "invId"), t.inventoryBalanceWh_Lock.select("companyId", "soLineItemId", "warehouseId", F.col("invid").alias("invId"),
                                                                                                                    (F.col("lockQty") + 1).alias("newLockQty"))), """
SELECT companyId, soLineItemId, warehouseId, invid AS invId, lockQty + 1 AS newLockQty, lockQty + 1 - (lockQty - releaseQty) AS lockDelta FROM inventoryBalanceWh_Lock""")

# --- calendar and numbers
_DIM = """WITH s AS (SELECT min(soDate) AS a, max(soDate) AS b FROM soHeader), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM s)
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS DateKey, CAST(d AS VARCHAR) AS "Date", CAST(day(d) AS INT) AS "Day",
  CASE WHEN day(d) IN (11, 12, 13) THEN 'th' WHEN day(d) % 10 = 1 THEN 'st' WHEN day(d) % 10 = 2 THEN 'nd' WHEN day(d) % 10 = 3 THEN 'rd' ELSE 'th' END AS DaySuffix,
  CAST(dayofweek(d) + 1 AS INT) AS "Weekday", dayname(d) AS WeekDayName, CAST(dayofyear(d) AS INT) AS DayOfYear,
  CAST((day(d) - 1 + dayofweek(date_trunc('month', d))) // 7 + 1 AS INT) AS WeekOfMonth, CAST((dayofyear(d) - 1 + dayofweek(date_trunc('year', d))) // 7 + 1 AS INT) AS WeekOfYear,
  CAST(weekofyear(d) AS INT) AS ISOWeekOfYear, CAST(month(d) AS INT) AS "Month", monthname(d) AS MonthName, CAST(quarter(d) AS INT) AS "Quarter",
  CASE quarter(d) WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 3 THEN 'Third' ELSE 'Fourth' END AS QuarterName, CAST(year(d) AS INT) AS "Year", strftime(d, '%m%Y') AS MMYYYY, strftime(d, '%b-%Y') AS MonthYear,
  CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS FirstDayOfMonth, CAST(last_day(d) AS VARCHAR) AS LastDayOfMonth, CAST(CAST(date_trunc('quarter', d) AS DATE) AS VARCHAR) AS FirstDayOfQuarter,
  CAST(CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS LastDayOfQuarter, CAST(CAST(date_trunc('year', d) AS DATE) AS VARCHAR) AS FirstDayOfYear,
  CAST(CAST(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS LastDayOfYear, CAST(CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS FirstDayOfNextMonth,
  CAST(CAST(date_trunc('year', d) + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS FirstDayOfNextYear FROM d"""
register("order_calendar", lambda t: date_dimension(t.soHeader.agg(F.min("soDate").alias("a"), F.max("soDate").alias("b")), "a", "b"), _DIM)
register("container_slots", lambda t: numbers_of(t.lrContainer.groupBy("lrHeaderId").agg(F.max("containerSeq").alias("n")), 1, "n").select("lrHeaderId", "i"),
         "SELECT lrHeaderId, CAST(unnest(generate_series(1, n)) AS INT) AS i FROM (SELECT lrHeaderId, max(containerSeq) AS n FROM lrContainer GROUP BY 1)")
register("running_numbers", lambda t: numbering.allocate_numbers(t.soHeader.select("soHeaderId", "companyId"), t.md_SequenceNumber, "PO", "companyId", ["soHeaderId"], "2001-02-03", "number"), """
SELECT soHeaderId, companyId, replace(replace(ItemFormat, 'yy', '01'), 'xxxxx', CASE WHEN length(CAST(v AS VARCHAR)) >= 5 THEN CAST(v AS VARCHAR) ELSE lpad(CAST(v AS VARCHAR), 5, '0') END) AS number
FROM (SELECT h.soHeaderId, h.companyId, z.ItemFormat, z.NextNum - 1 + row_number() OVER (PARTITION BY h.companyId ORDER BY soHeaderId) AS v FROM soHeader h JOIN md_SequenceNumber z ON z.csID = h.companyId AND z.condition = 'PO')""")
register("advanced_counters", lambda t: numbering.advance_counters(t.soHeader, t.md_SequenceNumber, "PO", "companyId").select("Id", "NextNum"), """
SELECT Id, CASE WHEN condition = 'PO' THEN NextNum + coalesce((SELECT count(*) FROM soHeader h WHERE h.companyId = csID), 0) ELSE NextNum END AS NextNum FROM md_SequenceNumber""")
register("dated_numbers", lambda t: numbering.dated_numbers(t.poHeader.select("poId", "companyId", F.when(F.col("poId") % 2 == 0, F.concat(F.lit("A(b)"), "poName")).otherwise("plain").alias("n")), t.md_SequenceNumber,
                                                            "WO", "companyId", "n", ["poId"], "2001-02-03", "number").select("poId", "number"), """
SELECT poId, CASE WHEN poId % 2 = 0 THEN 'A(b)P-0-' || v || '-010203' ELSE ItemFormat || v || '010203' END AS number FROM (
  SELECT p.poId, z.ItemFormat, lpad(CAST(z.NextNum - 1 + row_number() OVER (PARTITION BY p.companyId ORDER BY p.poId) AS VARCHAR), 5, '0') AS v FROM poHeader p JOIN md_SequenceNumber z ON z.csID = p.companyId AND z.condition = 'WO')""")
register("item_codes", lambda t: numbering.allocate_codes(t.md_Inventory.select("invID", F.concat(F.lit("00"), (F.col("productSubCategory") % 10).cast("string")).alias("prefix")), t.md_Inventory, "itemCode", "prefix",
                                                          ["invID"], 4).select("invID", "newCode"), """
WITH r AS (SELECT invID, '00' || productSubCategory % 10 AS px, row_number() OVER (PARTITION BY productSubCategory % 10 ORDER BY invID) AS k FROM md_Inventory),
f AS (SELECT px, num, row_number() OVER (PARTITION BY px ORDER BY num) AS k FROM (SELECT DISTINCT px FROM r), range(1, 9000) g(num) WHERE px || '.' || lpad(CAST(num AS VARCHAR), 4, '0') NOT IN (SELECT itemCode FROM md_Inventory))
SELECT r.invID, r.px || '.' || lpad(CAST(num AS VARCHAR), 4, '0') AS newCode FROM r JOIN f ON f.px = r.px AND f.k = r.k""")

# --- names and addresses
register("product_names", lambda t: lookup(lookup(t.md_Inventory, t.md_inventoryType, {"productType": "inventoryTypeId"}, _t="namingConvention", _y="inventoryType"), t.inventory_attributes.where("categoryId = 3194"), {"invID": "invID"}, _c="value")
         .select("invID", product_name(F.col("_t"), {"modelno": F.col("modelNo"), "color": F.col("_c"), "inventorytype": F.col("_y")}).alias("name")), """
SELECT i.invID, replace(replace(replace(regexp_replace(regexp_replace(y.namingConvention, '\\[modelno\\]', i.modelNo, 'gi'), '\\[color\\]', coalesce(a.value, ''), 'gi'), '[space]', ' '), '[,]', ','), '+', '') AS name
FROM md_Inventory i LEFT JOIN md_inventoryType y ON y.inventoryTypeId = i.productType LEFT JOIN inventory_attributes a ON a.invID = i.invID AND a.categoryId = 3194""")
_A = ("c.customerAddress", "c.customerAddressLine2", "c.customerCity", "c.customerStates", "c.customerPostcode", "c.customerCountry")
for _template in (1, 2):
    _two = _address(*_A, 2)
    register(f"customer_addresses_template_{_template}", lambda t, k=_template: party_addresses(t.md_Customer, t.md_MasterCategory, "customer", k), f"""
SELECT customerId AS id, upper(customerName) AS name, {_address(*_A, 1) if _template == 1 else 'upper(c.customerAddress)'} AS line1, {'NULL' if _template == 1 else _two} AS line2, customerContactNumber AS phone, '' AS fax FROM md_Customer c""")

# --- change capture
_new_heads = lambda t: t.workOrderHeader.withColumn("targetCompleteDate", F.when(F.col("workOrderHeaderId") % 11 == 0, F.date_add("targetCompleteDate", 2)).otherwise(F.col("targetCompleteDate")))
_new_lines = lambda t: t.workOrderLineItem.withColumns({"qty": F.when(F.col("soHeaderId") % 11 == 0, F.col("qty") + 1).otherwise(F.col("qty")), "confirmQty": F.when(F.col("soHeaderId") % 7 == 0, 0).otherwise(F.col("confirmQty"))})
dates = lambda t: history.target_date_notices(t.workOrderHeader, _new_heads(t), t.workOrderLineItem)
quantities = lambda t: history.line_qty_notices(t.workOrderLineItem, _new_lines(t), t.workOrderHeader)
_TD = """WITH m AS (SELECT workOrderHeaderId, companyId, '{"column":"targetCompleteDate","oldValue":"' || targetCompleteDate || '","newValue":"' || CAST(targetCompleteDate + INTERVAL 2 DAY AS DATE) || '"}' AS payload
    FROM workOrderHeader WHERE workOrderHeaderId % 11 = 0),
n AS (SELECT companyId, 'WorkOrder' AS sourceModule, workOrderHeaderId AS sourceRecordId, 'TargetDateChange' AS eventType, payload FROM m
    UNION SELECT m.companyId, 'SalesOrder', l.soHeaderId, 'TargetDateChange', m.payload FROM m JOIN workOrderLineItem l ON l.workOrderHeaderId = m.workOrderHeaderId)"""
register("target_date_notices", dates, _TD + " SELECT * FROM n")
register("line_qty_notices", quantities, """
WITH l AS (SELECT l.*, h.companyId FROM workOrderLineItem l JOIN workOrderHeader h ON h.workOrderHeaderId = l.workOrderHeaderId),
m AS (SELECT companyId, workOrderHeaderId, soHeaderId, 'Change qty' AS eventType, '{"column":"qty","oldValue":"' || qty || '","newValue":"' || qty + 1 || '"}' AS payload FROM l WHERE soHeaderId % 11 = 0
      UNION ALL SELECT companyId, workOrderHeaderId, soHeaderId, 'Change confirmQty', '{"column":"confirmQty","oldValue":"' || confirmQty || '","newValue":"0"}' FROM l WHERE soHeaderId % 7 = 0 AND confirmQty <> 0)
SELECT companyId, 'WorkOrder' AS sourceModule, workOrderHeaderId AS sourceRecordId, eventType, payload FROM m UNION SELECT companyId, 'SalesOrder', soHeaderId, eventType, payload FROM m""")
register("notice_recipients", lambda t: history.notify_recipients(dates(t), t, exclude_user=1), _TD + """
SELECT n.*, u.userId, r.roleName AS notifyGroup, 0 AS isRead FROM n JOIN companyRole c ON c.companyId = n.companyId JOIN md_Role r ON r.roleId = c.roleId
 AND CASE WHEN r.roleName IN ('planning', 'loading') THEN 'WorkOrder' ELSE 'SalesOrder' END = n.sourceModule
JOIN userRole u ON u.userrolecompanyroleid = c.companyRoleId JOIN md_User x ON x.userId = u.userId AND x.status = 1 WHERE u.userId <> 1""")
_events = lambda t: t.inventoryMovement.select("inventoryMovementId", "invId", "enterDate", "qty")
register("version_history", lambda t: history.build_history(_events(t), "invId", "enterDate", "inventoryMovementId"), """
SELECT inventoryMovementId, invId, qty, CAST(enterDate AS VARCHAR) AS ValidFrom, CAST(lead(enterDate) OVER (PARTITION BY invId ORDER BY inventoryMovement.enterDate, inventoryMovementId) AS VARCHAR) AS ValidTo FROM inventoryMovement""")
register("versions_as_of", lambda t: history.as_of(history.build_history(_events(t), "invId", "enterDate", "inventoryMovementId"), "2024-01-15 12:00:00").select("inventoryMovementId", "invId", "qty"), """
SELECT inventoryMovementId, invId, qty FROM inventoryMovement WHERE enterDate <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY invId ORDER BY enterDate DESC, inventoryMovementId DESC) = 1""")
register("versions_joined_as_of", lambda t: history.as_of_join(
    t.actionNotification.select("actionNotificationID", (F.col("actionNotificationID") % 150).alias("invId"), "createDate"),
    history.build_history(_events(t).drop("qty"), "invId", "enterDate", "inventoryMovementId"), "invId", "createDate", "actionNotificationID")
    .select("actionNotificationID", "invId", "inventoryMovementId"), """
SELECT a.actionNotificationID, a.actionNotificationID % 150 AS invId, m.inventoryMovementId FROM actionNotification a ASOF LEFT JOIN inventoryMovement m
 ON m.invId = a.actionNotificationID % 150 AND m.enterDate <= a.createDate""")
register("default_naming", lambda t: history.default_naming(t.md_inventoryType, t.md_InventoryCategory, [0], 13, "[inventoryType] [modelno]").select("inventoryTypeId", "namingConvention"), """
SELECT y.inventoryTypeId, CASE WHEN c.prodCategoryParentID = 13 AND y.namingConvention = '' THEN '[inventoryType] [modelno]' ELSE y.namingConvention END AS namingConvention
FROM md_inventoryType y LEFT JOIN md_InventoryCategory c ON c.prodCategoryId = y.prodCategoryId""")
register("merged_table", lambda t: merge_rows(t.soHeader, T.approve_sales_orders(t, _so(t)).headers, ["soHeaderId"]).select("soHeaderId", "soStatus"), """
WITH r AS (SELECT soHeaderId, soStatus, CAST(soStatus AS VARCHAR) || '-' || CAST(soHeaderId - soHeaderId % 40 AS VARCHAR) AS q FROM soHeader)
SELECT soHeaderId, CASE WHEN soStatus = 1106 THEN 6237 ELSE soStatus END AS soStatus FROM r""")

# --- digests
_WHO = """SELECT DISTINCT l.companyId, l.emailAddress FROM md_EmailList l JOIN md_EmailCategory c ON c.emailCategoryId = l.emailCategoryId
WHERE c.actionName = '{action}' AND l.status = 1"""


def _digest(name, build, action, lines, advanced, key):
    register(f"{name}_digest", lambda t: build(t).lines, lines)
    register(f"{name}_recipients", lambda t: build(t).recipients, _WHO.format(action=action))
    register(f"{name}_acknowledged", lambda t: build(t).advanced.select(key, "apiStatus"), advanced)


_digest("new_sales_orders", D.new_sales_orders, "New SO", """
SELECT l.soHeaderId, l.soLineItemId, l.customerSku, l.merchantSku, l.odrQty, h.companyId, h.soName, CASE WHEN h.lastUpdatedDate IS NOT NULL THEN 'REVISED' ELSE 'NEW' END AS kind, CAST(h.soDate AS VARCHAR) AS soDate,
       h.customerPO, CAST(h.earlyShipDate AS VARCHAR) AS earlyShipDate, h.thirdParty, i.inventorySKU AS inventorySku
FROM soHeader h JOIN soLineItem l ON l.soHeaderId = h.soHeaderId LEFT JOIN md_Inventory i ON i.invID = l.invID WHERE h.apiStatus = '_NEW_' AND l.soLineItemStatus <> 1107""",
        "SELECT soHeaderId, '_ACK_' AS apiStatus FROM soHeader WHERE apiStatus = '_NEW_'", "soHeaderId")
_OD = """SELECT l.soHeaderId, l.soLineItemId, l.customerSku, l.merchantSku, l.odrQty, i.itemCode, i.modelNo, i.inventorySKU AS inventorySku, i.itemDesc, h.companyId, x.companyShortCode AS company, h.soName, h.customerPO,
       CAST(h.earlyShipDate AS VARCHAR) AS shipDate, coalesce(d.shipToLabel, '') AS shipTo, p.poName, CAST(sum(l.odrQty) OVER (PARTITION BY l.soHeaderId) AS BIGINT) AS totalQty
FROM soHeader h JOIN soLineItem l ON l.soHeaderId = h.soHeaderId JOIN md_Inventory i ON i.invID = l.invID LEFT JOIN md_Company x ON x.companyId = h.companyId
LEFT JOIN md_ShipToDestination d ON d.shipToId = h.shipToId LEFT JOIN poHeader p ON p.poReferenceId = h.soName WHERE h.apiStatus = '{flag}'"""
_digest("cancelled_sales_orders", D.cancelled_sales_orders, "Cancel SO", _OD.format(flag="_CXL_"), "SELECT soHeaderId, '_ACK_' AS apiStatus FROM soHeader WHERE apiStatus = '_CXL_'", "soHeaderId")
_digest("reopened_sales_orders", D.reopened_sales_orders, "Reopen SO", _OD.format(flag="_REOP_"), "SELECT soHeaderId, '_ACK_' AS apiStatus FROM soHeader WHERE apiStatus = '_REOP_'", "soHeaderId")
_RD = """SELECT l.lrDetailsId, c.lrHeaderId, c.containerSeq, CAST(c.earlyShipDate AS VARCHAR) AS earlyShipDate, c.forwarderBookingNo, l.qty AS lrQty, h.companyId, h.lrName, CAST(h.lrShipDate AS VARCHAR) AS lrShipDate, i.inventorySKU AS inventorySku,
       i.productName AS itemDesc, s.soName, s.customerPO, s.thirdParty
FROM lrHeader h JOIN lrContainer c ON c.lrHeaderId = h.lrHeaderId JOIN lrLineItem l ON l.lrContainerId = c.lrContainerId AND l.itemStatus = 2135 LEFT JOIN md_Inventory i ON i.invID = l.invID LEFT JOIN soHeader s ON s.soHeaderId = l.soHeaderId
WHERE {where}"""
_digest("released_loading_requests", D.released_loading_requests, "Released LR", _RD.format(where="h.apiStatus = '_REL_' AND c.containerStatus = 2135"),
        "SELECT lrHeaderId, '_ACK_' AS apiStatus FROM lrHeader WHERE apiStatus = '_REL_'", "lrHeaderId")
_digest("ready_loading_requests", D.ready_loading_requests, "Ready LR", _RD.format(where="h.apiStatus = '_READYLOAD_' AND c.forwarderBookingNo <> ''"),
        "SELECT lrHeaderId, '_ACKLOAD_' AS apiStatus FROM lrHeader WHERE apiStatus = '_READYLOAD_' AND lrHeaderId IN (SELECT lrHeaderId FROM lrContainer WHERE forwarderBookingNo <> '')", "lrHeaderId")
_digest("new_work_orders", D.new_work_orders, "New WO", """
SELECT l.workOrderHeaderId, l.workOrderLineItemId, l.soName, l.qty, h.companyId, h.workOrderName, w.label AS warehouse, CAST(h.shipDate AS VARCHAR) AS shipDate, s.customerPO, s.thirdParty, i.itemCode, i.inventorySKU AS "SKU", i.productName AS itemDesc
FROM workOrderHeader h JOIN workOrderLineItem l ON l.workOrderHeaderId = h.workOrderHeaderId LEFT JOIN md_Warehouse w ON w.warehouseId = h.warehouseId LEFT JOIN soHeader s ON s.soHeaderId = l.soHeaderId
LEFT JOIN md_Inventory i ON i.invID = l.invId WHERE h.apiStatus = '_NEW_'""", "SELECT workOrderHeaderId, '_ACK_' AS apiStatus FROM workOrderHeader WHERE apiStatus = '_NEW_'", "workOrderHeaderId")


for _kind, _bad, _to in (("ASN", ["apiStatus NOT IN ('_RTG_', '_ASN_')", "containerPullOutDate IS NULL"], "_ASN_"), ("RTG", ["apiStatus NOT IN ('_NEW_', '_RTG_')", "coalesce(haulierId, 0) = 0", "coalesce(forwarderBookingNo, '') = ''"], "_RTG_"),
                         ("INV", ["apiStatus <> '_ASN_'"], None)):
    _ms = f"WITH h AS (SELECT * FROM shipmentHeader), g AS (SELECT * FROM h WHERE bol NOT IN (SELECT bol FROM h WHERE {' OR '.join(_bad)})), q AS (SELECT shipmentId, CAST(sum(shipQty) AS BIGINT) AS n FROM shipmentLineItem GROUP BY 1)"
    register(f"shipment_message_{_kind.lower()}", lambda t, k=_kind: D.shipment_message(t, k).bols, _ms + """
SELECT bol, companyId, count(*) AS totalOrders, CAST(sum(q.n) AS BIGINT) AS totalOrdersQty, CAST(sum(shipmentWeight) AS BIGINT) AS totalWeight FROM g JOIN q ON q.shipmentId = g.shipmentId GROUP BY bol, companyId""")
    register(f"shipment_message_{_kind.lower()}_errors", lambda t, k=_kind: D.shipment_message(t, k).errors.drop("rule"), "WITH h AS (SELECT * FROM shipmentHeader) " + " UNION ALL ".join(
        f"SELECT bol, shipmentId, {i} AS ruleNo, bol AS \"key\" FROM h WHERE {c}" for i, c in enumerate(_bad, 2)))
    if _to:
        register(f"shipment_message_{_kind.lower()}_items", lambda t, k=_kind: D.shipment_message(t, k).items, _ms +
                 " SELECT g.bol, g.shipmentId, l.shipmentLineItemId, l.customerSku, l.merchantSku, l.shipQty FROM g JOIN shipmentLineItem l ON l.shipmentId = g.shipmentId")
        register(f"shipment_message_{_kind.lower()}_ship_to", lambda t, k=_kind: D.shipment_message(t, k).ship_to, _ms + """
SELECT f.bol, d.locNo, d.shipToLabel, d.shipToName AS addressName, concat(d.shipToAddressLine1, ', ') AS address,
       concat(d.shipToCity, ',  ', d.shipToPostCode, ', ', (SELECT c.categoryName FROM md_MasterCategory c WHERE c.categoryId = d.country AND c.categoryParentID = 1)) AS address2, '' AS address3
FROM (SELECT bol, arg_min(shipToId, shipmentId) AS shipToId FROM g GROUP BY bol) f JOIN md_ShipToDestination d ON d.shipToId = f.shipToId""")
        register(f"shipment_message_{_kind.lower()}_advanced", lambda t, k=_kind: D.shipment_message(t, k).advanced.select("shipmentId", "apiStatus"), _ms + f" SELECT shipmentId, '{_to}' AS apiStatus FROM g")
