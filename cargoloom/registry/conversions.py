"""Conversions and quantity flows, one request per document, over all documents."""

from pyspark.sql import functions as F

from ..functions.payload import id_list, parse_payload, payload_text
from ..operators.transitions import merge_rows
from ..plans import conversions as C
from . import register

AS_OF = "1999-06-30"


def _each(df, key, *more):
    return df.select(F.col(key).cast("string").alias("requestId"), key, *more)


def _part(run, part, *columns):
    return lambda t: getattr(run(t), part).select(*columns) if columns else getattr(run(t), part)


def _errors(run):
    return lambda t: run(t).errors.drop("rule")


def _err(rules, scope, row):
    return " UNION ALL ".join(f"SELECT {scope} AS requestId, {row}, {i} AS ruleNo, CAST({k} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(rules, 1))


def _bad(rules):
    return " OR ".join(f"coalesce({c}, false)" for c, _ in rules)


def _no(key, n="n"):
    return f"""replace(replace(z.ItemFormat, 'yy', '99'), 'xxxxx', CASE WHEN z.NextNum + {n} - 1 > 99999 THEN CAST(z.NextNum + {n} - 1 AS VARCHAR) ELSE lpad(CAST(z.NextNum + {n} - 1 AS VARCHAR), 5, '0') END)"""


_BALANCES = """SELECT coalesce(b.warehouseId, d.warehouseId) AS warehouseId, coalesce(b.companyId, d.companyId) AS companyId, coalesce(b.invId, d.invId) AS invId,
       coalesce(b.balanceQty, 0) + coalesce(d.q, 0) AS balanceQty, coalesce(b.lockQty, 0) + coalesce(d.lk, 0) AS lockQty
FROM inventoryBalanceWH b FULL JOIN d ON d.warehouseId = b.warehouseId AND d.companyId = b.companyId AND d.invId = b.invId"""
_HOME = "CASE {c} WHEN 2 THEN 'MYR' ELSE 'SGD' END"

# --- order -> purchase order; some orders have none, and some have gained lines since theirs was made
def _before_conversion(t):
    return t.replace(poHeader=t.poHeaderBeforeConversion, poLineItem=t.poLineItemBeforeConversion)


convert = lambda t: C.convert_to_purchase_orders(_before_conversion(t), _each(t.soHeader, "soHeaderId"), AS_OF)
_PO_RULES = [("soStatus <> 6237", "soName"), ("soLineItemId IS NULL", "soName"), ("soLineItemId IS NOT NULL AND supplierSku IS NULL", "sku"), ("rate IS NULL", "soName")]
_PO = f"""WITH r AS (SELECT h.*, l.soLineItemId, l.invID, l.odrQty - l.poQty AS openQty, l.merchantSku AS mk, l.customerSku AS ck, l.EAN, k.supplierskuId, k.supplierSku, k.supCost,
        m.categoryName AS currencyCode, i.itemCode, i.inventorySKU AS sku, CASE WHEN coalesce(k.itemDesc, '') = '' THEN i.itemDesc ELSE k.itemDesc END AS dsc, {_HOME.format(c='h.companyId')} AS home,
        (SELECT arg_max(foreignRate, rateId) FROM md_CurrencyRate c WHERE c.status = 1 AND c.companyId = h.companyId AND c.homeCurrency = {_HOME.format(c='h.companyId')} AND c.foreignCurrency = 'USD'
            AND DATE '{AS_OF}' BETWEEN c.startDate AND c.endDate) AS rate
    FROM soHeader h LEFT JOIN soLineItem l ON l.soHeaderId = h.soHeaderId AND l.odrQty > l.poQty AND l.soLineItemStatus = 6237
    LEFT JOIN md_SupplierSku k ON k.statusflag = 1 AND k.companyId = h.companyId AND k.supplierId = h.supplierId AND k.invId = l.invID
    LEFT JOIN md_MasterCategory m ON m.categoryId = k.currencyCode LEFT JOIN md_Inventory i ON i.invID = l.invID),
g AS (SELECT r.*, (SELECT min(poId) FROM poHeaderBeforeConversion p WHERE p.poReferenceId = r.soName) AS pid FROM r WHERE soHeaderId NOT IN (SELECT soHeaderId FROM r WHERE {_bad(_PO_RULES)})),
w AS (SELECT companyId, min(warehouseId) AS warehouseId FROM md_Warehouse GROUP BY 1),
hd AS (SELECT soHeaderId, companyId, supplierId, soName, shipToId, portOfLanding, portOfDestination, earlyShipDate, lateShipDate, home, rate, customerPO, thirdPartyPO,
              CAST(sum(openQty * supCost) AS BIGINT) AS net, CAST(sum(openQty) AS BIGINT) AS qty, row_number() OVER (PARTITION BY companyId ORDER BY soHeaderId) AS n
       FROM g WHERE pid IS NULL GROUP BY soHeaderId, companyId, supplierId, soName, shipToId, portOfLanding, portOfDestination, earlyShipDate, lateShipDate, home, rate, customerPO, thirdPartyPO),
hn AS (SELECT hd.*, {_no('PO')} AS poName FROM hd JOIN md_SequenceNumber z ON z.csID = hd.companyId AND z.condition = 'PO'),
nl AS (SELECT hn.poName, g.soLineItemId, g.invID, g.itemCode, g.supplierskuId, g.supplierSku, g.currencyCode, g.EAN, g.ck AS merchantSku, g.supCost AS unitPrice, g.supCost * g.rate AS homeCurrencyCost,
              g.dsc AS poItemDesc, g.mk AS itemReference1, g.openQty AS qty, 1079 AS itemStatus FROM g JOIN hn ON hn.soHeaderId = g.soHeaderId),
rl AS (SELECT l.podetailsId, l.soLineItemId, s.odrQty AS qty FROM poLineItemBeforeConversion l JOIN (SELECT DISTINCT pid FROM g WHERE pid IS NOT NULL) x ON x.pid = l.poId JOIN soLineItem s ON s.soLineItemId = l.soLineItemId),
al AS (SELECT g.pid AS poId, h.poName, g.soLineItemId, g.invID, g.itemCode, g.supplierskuId, g.supplierSku, g.currencyCode, g.EAN, g.ck AS merchantSku, g.supCost AS unitPrice, g.supCost * g.rate AS homeCurrencyCost,
              g.dsc AS poItemDesc, g.mk AS itemReference1, g.openQty AS qty, 1079 AS itemStatus FROM g JOIN poHeaderBeforeConversion h ON h.poId = g.pid
       WHERE NOT EXISTS (SELECT 1 FROM poLineItemBeforeConversion l WHERE l.soLineItemId = g.soLineItemId)),
sl AS (SELECT s.soLineItemId, s.soHeaderId, s.odrQty, s.soLineItemStatus, CAST(least(s.poQty + q.q, s.odrQty) AS INT) AS poQty
       FROM soLineItem s JOIN (SELECT soLineItemId, sum(qty) AS q FROM (SELECT soLineItemId, qty FROM nl UNION ALL SELECT soLineItemId, qty FROM rl UNION ALL SELECT soLineItemId, qty FROM al) GROUP BY 1) q ON q.soLineItemId = s.soLineItemId)"""
register("convert_to_purchase_orders_errors", _errors(convert), _PO + " " + _err(_PO_RULES, "CAST(soHeaderId AS VARCHAR)", "soHeaderId"))
register("convert_to_purchase_orders_headers", _part(convert, "headers"), _PO + f"""
SELECT hn.soHeaderId, hn.companyId, hn.supplierId, hn.soName AS poReferenceId, hn.shipToId, hn.portOfLanding, hn.portOfDestination, CAST(hn.earlyShipDate AS VARCHAR) AS earlyShipDate,
       CAST(hn.lateShipDate AS VARCHAR) AS lateShipDate, 'USD' AS foreignCurrency, hn.home AS homeCurrency, hn.rate AS foreignCurrencyRate, hn.customerPO AS reference1, hn.thirdPartyPO AS reference2,
       hn.net AS poNetTotal, hn.qty AS poQty, w.warehouseId, hn.poName, 1079 AS poStatus FROM hn LEFT JOIN w ON w.companyId = hn.companyId""")
register("convert_to_purchase_orders_lines", _part(convert, "lines"), _PO + " SELECT * FROM nl")
register("convert_to_purchase_orders_refreshed", _part(convert, "refreshed_lines", "podetailsId", "qty", "itemStatus"), _PO + " SELECT podetailsId, qty, 1079 AS itemStatus FROM rl")
register("convert_to_purchase_orders_order_lines", _part(convert, "so_lines", "soLineItemId", "poQty", "soLineItemStatus"), _PO + """
SELECT soLineItemId, poQty, CASE WHEN odrQty = poQty AND odrQty = 0 THEN 1107 WHEN odrQty = poQty THEN 2125 ELSE soLineItemStatus END AS soLineItemStatus FROM sl""")
register("convert_to_purchase_orders_orders", _part(convert, "so_headers", "soHeaderId", "soStatus"), _PO + """
SELECT s.soHeaderId, 2125 AS soStatus FROM soLineItem s LEFT JOIN sl ON sl.soLineItemId = s.soLineItemId WHERE s.soHeaderId IN (SELECT soHeaderId FROM g)
GROUP BY s.soHeaderId HAVING sum(s.odrQty - coalesce(sl.poQty, s.poQty)) = 0""")

register("convert_to_purchase_orders_added_lines", _part(convert, "added_lines"), _PO + " SELECT * FROM al")
register("convert_to_purchase_orders_relinked", _part(convert, "relinked"), _PO + " SELECT l.lrDetailsId, l.soLineItemId, nl.poName FROM lrLineItem l JOIN nl ON nl.soLineItemId = l.soLineItemId")

# --- purchase order -> internal supplier's order
internal = lambda t: C.raise_internal_orders(t, _each(t.poHeader, "poId"), AS_OF)
_IN_RULES = [("poStatus <> 1085", "poName"), ("coalesce(branch, 0) = 0", "poName"), ("podetailsId IS NULL", "poName"), ("qty > odr", "poName"),
             ("coalesce(branch, 0) <> 0 AND podetailsId IS NOT NULL AND customerskuId IS NULL", "supplierSku"), ("shipTo IS NULL", "poName")]
_IN = f"""WITH b AS (SELECT companyId, internal_branchId, min(customerId) AS buyer FROM md_Customer WHERE internal_branchId <> 0 GROUP BY ALL),
w AS (SELECT companyId, min(warehouseId) AS wh FROM md_Warehouse GROUP BY 1),
r AS (SELECT h.* EXCLUDE (shipToId), s.internal_branchId AS branch, b.buyer, (SELECT min(d.shipToId) FROM md_ShipToDestination d WHERE d.warehouseId = w.wh) AS shipTo, l.podetailsId, l.supplierSku,
             l.currencyCode, l.unitPrice, l.qty, l.itemReference1, l.merchantSku, l.poItemDesc, o.odrQty AS odr, k.customerskuId, k.invID, k.tagDivision, k.itemDesc AS kd
      FROM poHeader h LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId LEFT JOIN b ON b.companyId = s.internal_branchId AND b.internal_branchId = h.companyId LEFT JOIN w ON w.companyId = h.companyId
      LEFT JOIN poLineItem l ON l.poId = h.poId AND l.qty > l.rcvQty AND l.itemStatus = 1085 LEFT JOIN soLineItem o ON o.soLineItemId = l.soLineItemId
      LEFT JOIN md_CustomerSku k ON k.statusflag = 1 AND k.customerSku = l.supplierSku AND k.companyId = s.internal_branchId AND k.customerId = b.buyer),
g AS (SELECT r.*, (SELECT min(soHeaderId) FROM soHeader x WHERE x.companyId = r.branch AND x.customerPO = r.poName) AS so FROM r WHERE poId NOT IN (SELECT poId FROM r WHERE {_bad(_IN_RULES)})),
hd AS (SELECT poId, branch, buyer, poName, customerCode, reference1, poReferenceId, shipTo, locNo, vesselBooking, portOfLanding, portOfDestination, poEarlyShipDate, poLateShipDate, bool_or(tagDivision = 3234) AS untagged,
              row_number() OVER (PARTITION BY branch ORDER BY poId) AS n FROM g WHERE so IS NULL
       GROUP BY poId, branch, buyer, poName, customerCode, reference1, poReferenceId, shipTo, locNo, vesselBooking, portOfLanding, portOfDestination, poEarlyShipDate, poLateShipDate),
hn AS (SELECT hd.*, CASE WHEN untagged THEN 'tempSO_' ELSE '' END || {_no('SO')} AS soName FROM hd JOIN md_SequenceNumber z ON z.csID = hd.branch AND z.condition = 'SO')"""
register("raise_internal_orders_errors", _errors(internal), _IN + " " + _err(_IN_RULES, "CAST(poId AS VARCHAR)", "poId"))
register("raise_internal_orders_headers", _part(internal, "headers"), _IN + """
SELECT poId, branch AS companyId, buyer AS customerId, poName AS customerPO, customerCode AS thirdParty, reference1 AS thirdPartyPO, poReferenceId AS reference1, shipTo AS shipToId, locNo, vesselBooking,
       portOfLanding, portOfDestination, CAST(poEarlyShipDate AS VARCHAR) AS earlyShipDate, CAST(poLateShipDate AS VARCHAR) AS lateShipDate, soName,
       CASE WHEN untagged THEN 1105 ELSE 1106 END AS soStatus, CASE WHEN NOT untagged THEN '_NEW_' END AS apiStatus FROM hn""")
register("raise_internal_orders_lines", _part(internal, "lines"), _IN + """
SELECT g.podetailsId AS ref_poLineItemId, g.invID, g.customerskuId, g.supplierSku AS customerSku, g.unitPrice AS csCost, g.currencyCode, g.qty AS odrQty, g.itemReference1, g.merchantSku,
       CASE WHEN g.poItemDesc = '' THEN g.kd ELSE g.poItemDesc END AS soItemDesc, g.tagDivision, CASE WHEN g.tagDivision = 3234 THEN 1105 ELSE 1106 END AS soLineItemStatus, hn.soName
FROM g JOIN hn ON hn.poId = g.poId""")
register("raise_internal_orders_po_lines", _part(internal, "po_lines", "podetailsId", "itemStatus"), _IN + """
SELECT podetailsId, 1077 AS itemStatus FROM poLineItem WHERE poId IN (SELECT poId FROM g)""")

# --- purchase order -> loading request
to_lr = lambda t: C.convert_to_loading_requests(t, _each(t.poHeader, "poId"), AS_OF)
_TL_RULES = [("false", "''"), ("poStatus <> 1077", "poName"), ("false", "''"), ("false", "''"), ("false", "''"), ("lr > 0", "poName")]
_TL = f"""WITH r AS (SELECT h.*, (SELECT min(customerId) FROM soHeader s WHERE s.soName = h.poReferenceId) AS customerId, coalesce((SELECT max(lrQty) FROM poLineItem l WHERE l.poId = h.poId), 0) AS lr FROM poHeader h),
g AS (SELECT *, row_number() OVER (PARTITION BY companyId ORDER BY poId) AS n FROM r WHERE NOT ({_bad(_TL_RULES)})),
hn AS (SELECT g.*, 'tempLR_' || {_no('LR')} AS lrName FROM g JOIN md_SequenceNumber z ON z.csID = g.companyId AND z.condition = 'LR')"""
register("convert_to_loading_requests_errors", _errors(to_lr), _TL + " " + _err(_TL_RULES, "CAST(poId AS VARCHAR)", "poId"))
register("convert_to_loading_requests_headers", _part(to_lr, "headers"), _TL + f"""
SELECT poId, companyId, supplierId, customerId, lrName, '{AS_OF}' AS lrDate, CAST(poEarlyShipDate AS VARCHAR) AS lrShipDate, shipToId AS lrShipToId, reference1, 2132 AS lrStatus FROM hn""")
register("convert_to_loading_requests_lines", _part(to_lr, "lines"), _TL + """
SELECT hn.lrName, l.poId, l.podetailsId AS poDetailsId, l.soLineItemId, l.supplierSku, l.invID, l.merchantSku, l.itemReference1, l.qty - l.lrQty AS qty, l.qty - l.lrQty AS confirmQty, 2132 AS itemStatus
FROM poLineItem l JOIN hn ON hn.poId = l.poId WHERE l.qty > l.lrQty""")
register("convert_to_loading_requests_po_lines", _part(to_lr, "po_lines", "podetailsId", "lrQty"), _TL + """
SELECT l.podetailsId, l.qty AS lrQty FROM poLineItem l JOIN hn ON hn.poId = l.poId WHERE l.qty > l.lrQty""")

# --- request -> internal supplier's request
mirror = lambda t: C.raise_internal_requests(t, _each(t.lrHeader, "lrHeaderId"), AS_OF)
_MI_RULES = [("lrStatus = 2135", "lrName"), ("lrStatus <> 2129", "lrName"), ("coalesce(branch, 0) = 0", "lrName"), ("unreleased", "lrName"), ("unmatched", "lrName")]
_MI = f"""WITH b AS (SELECT companyId, internal_branchId, min(customerId) AS buyer FROM md_Customer WHERE internal_branchId <> 0 GROUP BY ALL),
m AS (SELECT ref_poLineItemId AS ref, arg_min(soLineItemId, soLineItemId) AS msl FROM soLineItem WHERE ref_poLineItemId IS NOT NULL GROUP BY 1),
l AS (SELECT x.*, coalesce(p.poStatus, 0) AS ps, m.msl FROM lrLineItem x LEFT JOIN poHeader p ON p.poId = x.poId LEFT JOIN m ON m.ref = x.poDetailsId WHERE x.itemStatus <> 2130 AND x.qty > x.confirmQty),
r AS (SELECT h.*, s.internal_branchId AS branch, EXISTS (SELECT 1 FROM l WHERE l.lrHeaderId = h.lrHeaderId AND ps <> 1077) AS unreleased,
             EXISTS (SELECT 1 FROM l WHERE l.lrHeaderId = h.lrHeaderId AND msl IS NULL) AS unmatched FROM lrHeader h LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId),
g AS (SELECT r.*, b.buyer, row_number() OVER (PARTITION BY branch ORDER BY lrHeaderId) AS n FROM r LEFT JOIN b ON b.companyId = r.branch AND b.internal_branchId = r.companyId WHERE NOT ({_bad(_MI_RULES)})),
hn AS (SELECT g.*, {_no('LR')} AS newName FROM g JOIN md_SequenceNumber z ON z.csID = g.branch AND z.condition = 'LR')"""
register("raise_internal_requests_errors", _errors(mirror), _MI + " " + _err(_MI_RULES, "CAST(lrHeaderId AS VARCHAR)", "lrHeaderId"))
register("raise_internal_requests_headers", _part(mirror, "headers"), _MI + f"""
SELECT branch AS companyId, 0 AS supplierId, buyer AS customerId, lrHeaderId AS ref_customerLrHeaderId, lrName AS customerLrName, '{AS_OF}' AS lrDate, CAST(lrShipDate AS VARCHAR) AS lrShipDate,
       2135 AS lrStatus, newName AS lrName FROM hn""")
register("raise_internal_requests_containers", _part(mirror, "containers", "lrName", "containerSeq", "containerNo", "ref_lrContainerId", "containerStatus"), _MI + """
SELECT hn.newName AS lrName, c.containerSeq, c.containerNo, c.lrContainerId AS ref_lrContainerId, 2135 AS containerStatus FROM lrContainer c JOIN hn ON hn.lrHeaderId = c.lrHeaderId""")
register("raise_internal_requests_lines", _part(mirror, "lines"), _MI + """
SELECT hn.newName AS lrName, l.lrContainerId AS ref_lrContainerId, l.lrDetailsId AS ref_lrLineItemId, s.soHeaderId, s.soLineItemId, s.customerSku AS supplierSku, s.invID, l.qty, l.itemNote, 2135 AS itemStatus
FROM l JOIN hn ON hn.lrHeaderId = l.lrHeaderId JOIN soLineItem s ON s.soLineItemId = l.msl""")
register("raise_internal_requests_source_lines", _part(mirror, "source_lines", "lrDetailsId", "confirmQty", "itemStatus"), _MI + """
SELECT l.lrDetailsId, CAST(l.confirmQty + l.qty AS INT) AS confirmQty, 2135 AS itemStatus FROM l JOIN hn ON hn.lrHeaderId = l.lrHeaderId""")

def _admitted(rows, request, order, key, need, limit, barred="false"):
    """CTEs: ``short`` (request, k) of what is short at its request's turn, one request after the other."""
    k = " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in key)
    return f"""qn AS MATERIALIZED (SELECT {request} AS request, {k} AS k, CAST(sum({need}) AS BIGINT) AS need, CAST(max(coalesce({limit}, 0)) AS BIGINT) AS lim FROM {rows} GROUP BY 1, 2),
qf AS MATERIALIZED (SELECT {request} AS request, min({order}) AS ord, bool_or(coalesce({barred}, false)) AS barred FROM {rows} GROUP BY 1),
qc AS MATERIALIZED (SELECT * FROM qn WHERE k IN (SELECT k FROM qn GROUP BY k HAVING sum(greatest(need, 0)) > max(lim))),
qo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord, request) AS n, request, barred, needs FROM qf JOIN (SELECT request, list({{'k': k, 'need': need, 'lim': lim}}) AS needs FROM qc GROUP BY 1) USING (request)),
qs AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS used, CAST([] AS VARCHAR[]) AS lacks
  UNION ALL
  SELECT n, CASE WHEN barred OR len(lacks) > 0 THEN used ELSE map_concat(used, map_from_entries(list_transform(needs, lambda x: {{'k': x.k, 'v': x.need + coalesce(used[x.k], 0)}}))) END, lacks
  FROM (SELECT qo.n, qo.barred, qo.needs, qs.used, list_transform(list_filter(qo.needs, lambda x: x.need + coalesce(qs.used[x.k], 0) > x.lim), lambda x: x.k) AS lacks FROM qs JOIN qo ON qo.n = qs.n + 1)),
short AS (SELECT request, unnest(lacks) AS k FROM qs JOIN qo USING (n))"""


# --- shipments
ship = lambda t: C.ship_loading_requests(t, _each(t.lrHeader, "lrHeaderId"), AS_OF)
_SH = f"""WITH RECURSIVE w AS (SELECT companyId, min(warehouseId) AS wh FROM md_Warehouse GROUP BY 1),
r0 AS (SELECT l.lrDetailsId, l.lrContainerId, l.soHeaderId, l.soLineItemId, l.invID AS invId, l.supplierSku, l.qty - l.processQty AS shipQty, l.itemNote, c.* EXCLUDE (lrContainerId, lrHeaderId, lrName),
              h.lrHeaderId, h.companyId, h.lrName, w.wh
       FROM lrLineItem l JOIN lrContainer c ON c.lrContainerId = l.lrContainerId AND c.containerStatus = 2135 JOIN lrHeader h ON h.lrHeaderId = c.lrHeaderId LEFT JOIN w ON w.companyId = h.companyId
       WHERE l.qty > l.processQty AND l.itemStatus = 2135),
r1 AS (SELECT r0.*, b.balanceQty FROM r0 LEFT JOIN inventoryBalanceWH b ON b.warehouseId = r0.wh AND b.companyId = r0.companyId AND b.invId = r0.invId),
{_admitted("r1", "lrHeaderId", "lrHeaderId", ["companyId", "wh", "invId"], "shipQty", "balanceQty")},
r AS (SELECT r1.*, short.request IS NOT NULL AS short FROM r1 LEFT JOIN short ON short.request = r1.lrHeaderId
      AND short.k = coalesce(CAST(r1.companyId AS VARCHAR), '') || '/' || coalesce(CAST(r1.wh AS VARCHAR), '') || '/' || coalesce(CAST(r1.invId AS VARCHAR), '')),
g0 AS (SELECT * FROM r WHERE lrHeaderId NOT IN (SELECT lrHeaderId FROM r WHERE short)),
bo AS (SELECT x.lrContainerId, {_no('BOL')} AS bol FROM (SELECT companyId, lrContainerId, row_number() OVER (PARTITION BY companyId ORDER BY lrContainerId) AS n FROM (SELECT DISTINCT companyId, lrContainerId FROM g0)) x
       JOIN md_SequenceNumber z ON z.csID = x.companyId AND z.condition = 'BOL'),
so AS (SELECT x.lrContainerId, x.soHeaderId, {_no('SHIP')} AS shipId FROM (SELECT companyId, lrContainerId, soHeaderId, row_number() OVER (PARTITION BY companyId ORDER BY lrContainerId, soHeaderId) AS n
       FROM (SELECT DISTINCT companyId, lrContainerId, soHeaderId FROM g0)) x JOIN md_SequenceNumber z ON z.csID = x.companyId AND z.condition = 'SHIP'),
g AS (SELECT g0.*, bo.bol, so.shipId FROM g0 JOIN bo ON bo.lrContainerId = g0.lrContainerId JOIN so ON so.lrContainerId = g0.lrContainerId AND so.soHeaderId = g0.soHeaderId)"""
register("ship_loading_requests_errors", _errors(ship), _SH + """ SELECT CAST(lrHeaderId AS VARCHAR) AS requestId, lrDetailsId, 1 AS ruleNo, supplierSku AS "key" FROM r WHERE short""")
register("ship_loading_requests_headers", _part(ship, "headers", "shipId", "bol", "companyId", "pickupAddrId", "lrHeaderId", "soHeaderId", "customerId", "soName", "customerPO", "shipToId", "pol", "pod",
                                                "paymentTermId", "countryOfOrigin", "shipmentWeight", "bolTotalShipmentWeight", "shipmentDate", "shipmentStatus"), _SH + f"""
, hw AS (SELECT g.shipId, g.bol, g.companyId, g.wh, g.lrHeaderId, g.soHeaderId, g.portId, CAST(sum(g.shipQty * i.grossWeight) AS BIGINT) AS sw FROM g JOIN md_Inventory i ON i.invID = g.invId GROUP BY ALL)
SELECT hw.shipId, hw.bol, hw.companyId, hw.wh AS pickupAddrId, hw.lrHeaderId, hw.soHeaderId, s.customerId, s.soName, s.customerPO, s.shipToId, s.portOfLanding AS pol, p.portName AS pod, c.paymentTerm AS paymentTermId,
       m.categoryName AS countryOfOrigin, hw.sw AS shipmentWeight, CAST(sum(hw.sw) OVER (PARTITION BY hw.bol) AS BIGINT) AS bolTotalShipmentWeight, '{AS_OF}' AS shipmentDate, 2149 AS shipmentStatus
FROM hw JOIN soHeader s ON s.soHeaderId = hw.soHeaderId LEFT JOIN md_Customer c ON c.customerId = s.customerId LEFT JOIN md_Port p ON p.portId = hw.portId
LEFT JOIN md_Company x ON x.companyId = hw.companyId LEFT JOIN md_MasterCategory m ON m.categoryId = x.country""")
register("ship_loading_requests_lines", _part(ship, "lines"), _SH + """
SELECT g.shipId, g.soLineItemId, g.lrDetailsId, g.invId, s.customerSku, s.merchantSku, g.shipQty AS shipmentQty, g.shipQty, g.itemNote AS lineItemNotes, 2149 AS lineItemStatus FROM g JOIN soLineItem s ON s.soLineItemId = g.soLineItemId""")
register("ship_loading_requests_addresses", _part(ship, "addresses"), _SH + """
SELECT DISTINCT g.shipId, d.locNo, d.shipToName, d.shipToLabel, d.shipToAddressLine1, d.shipToCity, d.shipToPostCode, d.country FROM g JOIN soHeader s ON s.soHeaderId = g.soHeaderId JOIN md_ShipToDestination d ON d.shipToId = s.shipToId""")
register("ship_loading_requests_balances", _part(ship, "balances"), _SH + """
, d AS (SELECT wh AS warehouseId, companyId, invId, CAST(-sum(shipQty) AS BIGINT) AS q, CAST(-sum(shipQty) AS BIGINT) AS lk FROM g GROUP BY ALL) """ + _BALANCES)
register("ship_loading_requests_locks", _part(ship, "locks", "warehouseBalanceLockId", "lockQty", "releaseQty"), _SH + """
SELECT k.warehouseBalanceLockId, k.lockQty, CAST(least(k.lockQty, k.releaseQty + q.q) AS BIGINT) AS releaseQty FROM inventoryBalanceWh_Lock k JOIN (SELECT soLineItemId, sum(shipQty) AS q FROM g GROUP BY 1) q ON q.soLineItemId = k.soLineItemId""")
_SHL = _SH + """, ll0 AS (SELECT l.lrDetailsId, l.lrHeaderId, l.itemStatus AS was, g.shipQty, CAST(l.processQty + coalesce(g.shipQty, 0) AS INT) AS processQty,
    CASE WHEN CASE WHEN l.confirmQty = 0 THEN l.qty ELSE l.confirmQty END = l.processQty + coalesce(g.shipQty, 0) THEN 2131 ELSE l.itemStatus END AS itemStatus
  FROM lrLineItem l LEFT JOIN g ON g.lrDetailsId = l.lrDetailsId WHERE l.lrHeaderId IN (SELECT lrHeaderId FROM g)),
ll AS (SELECT * FROM ll0 WHERE shipQty IS NOT NULL OR was <> itemStatus),
sl0 AS (SELECT s.soLineItemId, s.soHeaderId, s.soLineItemStatus AS was, q.q, CAST(s.shpQty + coalesce(q.q, 0) AS INT) AS shpQty, CASE WHEN s.odrQty = s.shpQty + coalesce(q.q, 0) THEN 1108 ELSE s.soLineItemStatus END AS soLineItemStatus
       FROM soLineItem s LEFT JOIN (SELECT soLineItemId, sum(shipQty) AS q FROM g GROUP BY 1) q ON q.soLineItemId = s.soLineItemId WHERE s.soHeaderId IN (SELECT soHeaderId FROM g)),
sl AS (SELECT * FROM sl0 WHERE q IS NOT NULL OR was <> soLineItemStatus)"""
register("ship_loading_requests_request_lines", _part(ship, "lr_lines", "lrDetailsId", "processQty", "itemStatus"), _SHL + " SELECT lrDetailsId, processQty, itemStatus FROM ll")
register("ship_loading_requests_requests", _part(ship, "lr_headers", "lrHeaderId", "lrStatus"), _SHL + """
SELECT l.lrHeaderId, 2131 AS lrStatus FROM lrLineItem l LEFT JOIN ll ON ll.lrDetailsId = l.lrDetailsId WHERE l.lrHeaderId IN (SELECT lrHeaderId FROM ll)
GROUP BY l.lrHeaderId HAVING bool_and(coalesce(ll.itemStatus, l.itemStatus) IN (2131, 2130))""")
register("ship_loading_requests_order_lines", _part(ship, "so_lines", "soLineItemId", "shpQty", "soLineItemStatus"), _SHL + " SELECT soLineItemId, shpQty, soLineItemStatus FROM sl")
register("ship_loading_requests_orders", _part(ship, "so_headers", "soHeaderId", "soStatus"), _SHL + """
SELECT s.soHeaderId, 1108 AS soStatus FROM soLineItem s LEFT JOIN sl ON sl.soLineItemId = s.soLineItemId WHERE s.soHeaderId IN (SELECT soHeaderId FROM sl)
GROUP BY s.soHeaderId HAVING bool_and(coalesce(sl.soLineItemStatus, s.soLineItemStatus) IN (1107, 1108))""")

process = lambda t: C.ship_order_processes(t, _each(t.orderProcess, "opId"), AS_OF)
_OP_RULES = [("opStatus = 1090", "opName"), ("opStatus <> 1091", "opName"), ("short", "customerSku")]
_OP = f"""WITH RECURSIVE w AS (SELECT companyId, min(warehouseId) AS wh FROM md_Warehouse GROUP BY 1),
r0 AS (SELECT h.*, l.opLineItemId, l.soLineItemId, l.invId, l.confirmQty, w.wh FROM orderProcess h JOIN orderProcessLineItem l ON l.opId = h.opId LEFT JOIN w ON w.companyId = h.companyId),
f AS (SELECT companyId, invId, sum(balanceQty - lockQty) AS free FROM inventoryBalanceWH GROUP BY ALL),
r1 AS (SELECT r0.*, f.free FROM r0 LEFT JOIN f ON f.companyId = r0.companyId AND f.invId = r0.invId),
{_admitted("r1", "opId", "opId", ["companyId", "invId"], "confirmQty", "free", "opStatus IS DISTINCT FROM 1091")},
r AS (SELECT r1.*, short.request IS NOT NULL AS short, s.customerSku, s.merchantSku FROM r1
      LEFT JOIN short ON short.request = r1.opId AND short.k = coalesce(CAST(r1.companyId AS VARCHAR), '') || '/' || coalesce(CAST(r1.invId AS VARCHAR), '')
      LEFT JOIN soLineItem s ON s.soLineItemId = r1.soLineItemId),
g AS (SELECT * FROM r WHERE opId NOT IN (SELECT opId FROM r WHERE {_bad(_OP_RULES)})),
hs AS (SELECT g.opId, g.opName, g.companyId, g.customerId, g.shipToId, g.wh, CAST(sum(g.confirmQty * i.grossWeight) AS BIGINT) AS shipmentWeight, row_number() OVER (PARTITION BY g.companyId ORDER BY g.opId) AS n
       FROM g JOIN md_Inventory i ON i.invID = g.invId GROUP BY g.opId, g.opName, g.companyId, g.customerId, g.shipToId, g.wh),
hn AS (SELECT hs.*, {_no('SHIP')} AS shipId FROM hs JOIN md_SequenceNumber z ON z.csID = hs.companyId AND z.condition = 'SHIP')"""
register("ship_order_processes_errors", _errors(process), _OP + " " + _err(_OP_RULES, "CAST(opId AS VARCHAR)", "opLineItemId"))
register("ship_order_processes_headers", _part(process, "headers"), _OP + f"""
SELECT opId, opName, companyId, customerId, shipToId, wh AS pickupAddrId, shipmentWeight, shipId, '{AS_OF}' AS shipmentDate, '1999-09-30' AS paymentDueDate, 2149 AS shipmentStatus FROM hn""")
register("ship_order_processes_lines", _part(process, "lines"), _OP + """
SELECT hn.shipId, g.soLineItemId, g.invId, g.customerSku, g.merchantSku, g.confirmQty AS shipmentQty, g.confirmQty AS shipQty, 2149 AS lineItemStatus FROM g JOIN hn ON hn.opId = g.opId""")
register("ship_order_processes_balances", _part(process, "balances"), _OP + """
, d AS (SELECT wh AS warehouseId, companyId, invId, CAST(-sum(confirmQty) AS BIGINT) AS q, 0 AS lk FROM g GROUP BY ALL) """ + _BALANCES)

# --- work orders
to_wo = lambda t: C.convert_to_work_orders(t, AS_OF)
_WO = f"""WITH r AS (SELECT l.soLineItemId, l.soHeaderId, l.invID AS invId, l.odrQty - l.processQty AS woQty, h.soName, h.companyId, h.customerId, h.earlyShipDate, h.portOfDestination, h.thirdParty, w.warehouseId
    FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId JOIN md_Warehouse w ON w.locNo = CASE WHEN h.locNo = '' THEN 'L1' ELSE h.locNo END
    WHERE l.odrQty > l.processQty AND l.soLineItemStatus NOT IN (1107, 1108, 1105) AND h.soStatus NOT IN (1107, 1108, 1105)),
hd AS (SELECT companyId, customerId, earlyShipDate, portOfDestination, thirdParty, min(warehouseId) AS warehouseId,
              row_number() OVER (PARTITION BY companyId ORDER BY customerId, earlyShipDate, portOfDestination, thirdParty) AS n FROM r GROUP BY companyId, customerId, earlyShipDate, portOfDestination, thirdParty),
hn AS (SELECT hd.*, {_no('WO')} AS workOrderName FROM hd JOIN md_SequenceNumber z ON z.csID = hd.companyId AND z.condition = 'WO')"""
register("convert_to_work_orders_headers", _part(to_wo, "headers"), _WO + f"""
SELECT companyId, customerId, CAST(earlyShipDate AS VARCHAR) AS shipDate, portOfDestination, thirdParty, warehouseId, workOrderName, '{AS_OF}' AS workOrderDate,
       CAST(CAST(earlyShipDate - INTERVAL 7 DAY AS DATE) AS VARCHAR) AS targetCompleteDate, 5230 AS workOrderStatus FROM hn""")
register("convert_to_work_orders_lines", _part(to_wo, "lines"), _WO + """
SELECT hn.workOrderName, r.soHeaderId, r.soName, r.soLineItemId, r.invId, r.woQty AS qty, r.woQty AS confirmQty, 5230 AS workOrderItemStatus FROM r JOIN hn ON hn.companyId = r.companyId AND hn.customerId = r.customerId
AND hn.earlyShipDate = r.earlyShipDate AND hn.portOfDestination = r.portOfDestination AND hn.thirdParty = r.thirdParty""")
register("convert_to_work_orders_order_lines", _part(to_wo, "so_lines", "soLineItemId", "processQty"), _WO + " SELECT l.soLineItemId, l.odrQty AS processQty FROM soLineItem l JOIN r ON r.soLineItemId = l.soLineItemId")

# every open line of an order without location goes to the one warehouse; no place at all is an error
forced_wo = lambda t: C.convert_to_work_orders(t, AS_OF, lines=t.soLineItem.select("soLineItemId"), forced_warehouse=2)
_WO_FORCED = _WO.replace("'L1'", "(SELECT min(f.locNo) FROM md_Warehouse f WHERE f.warehouseId = 2)")
register("convert_to_work_orders_forced_headers", _part(forced_wo, "headers", "companyId", "customerId", "portOfDestination", "thirdParty", "warehouseId", "workOrderName"), _WO_FORCED + """
SELECT companyId, customerId, portOfDestination, thirdParty, warehouseId, workOrderName FROM hn""")
register("convert_to_work_orders_errors", _errors(lambda t: C.convert_to_work_orders(t, AS_OF, default_location="NOWHERE")), """
SELECT l.soHeaderId, l.soLineItemId, 1 AS ruleNo, 'NOWHERE' AS "key" FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId
WHERE l.odrQty > l.processQty AND l.soLineItemStatus NOT IN (1107, 1108, 1105) AND h.soStatus NOT IN (1107, 1108, 1105) AND h.locNo = ''""")

# --- procurement
procure = lambda t: C.procure_materials(t, _each(t.soHeader, "soHeaderId"))
_PR = """WITH r AS (SELECT h.soHeaderId, h.companyId, h.soName, l.soLineItemId, l.invID AS invId, l.odrQty - l.poQty AS processQty, i.inventorySKU AS sku,
    EXISTS (SELECT 1 FROM rawBom b WHERE b.status = 1 AND b.companyId = h.companyId AND b.invId = l.invID) AS has FROM soHeader h JOIN soLineItem l ON l.soHeaderId = h.soHeaderId LEFT JOIN md_Inventory i ON i.invID = l.invID),
g AS (SELECT * FROM r WHERE soHeaderId NOT IN (SELECT soHeaderId FROM r WHERE NOT has)) """
register("procure_materials_errors", _errors(procure), _PR + """SELECT CAST(soHeaderId AS VARCHAR) AS requestId, soLineItemId, 1 AS ruleNo, sku AS "key" FROM r WHERE NOT has""")
register("procure_materials_demand", _part(procure, "demand", "soHeaderId", "companyId", "soName", "soLineItemId", "invId", "processQty", "rawBomInvId", "rawBomQty", "rawBomTotalQty", "status"), _PR + """
SELECT g.soHeaderId, g.companyId, g.soName, g.soLineItemId, g.invId, g.processQty, b.rawBomInvId, b.rawBomQty, g.processQty * b.rawBomQty AS rawBomTotalQty, 0 AS status
FROM g JOIN rawBom b ON b.status = 1 AND b.companyId = g.companyId AND b.invId = g.invId""")
register("procure_materials_order_lines", _part(procure, "so_lines", "soLineItemId", "poQty"), _PR + "SELECT soLineItemId, processQty AS poQty FROM g")

_order_requests = lambda t: t.procurementProcess.where(F.col("status") == 0).select(
    F.col("procurementProcessId").alias("requestId"), "procurementProcessId", (F.col("soHeaderId") % 9).alias("supplierId"), (F.col("rawBomTotalQty") - F.col("poQty")).alias("orderQty"))
order = lambda t: C.order_materials(t, _order_requests(t), AS_OF)
_OM_RULES = [("coalesce(orderQty, 0) = 0", "procurementProcessId"), ("supplierSku IS NULL", "sku"), ("supplierSku IS NOT NULL AND rate IS NULL", "fc")]
_OM = f"""WITH r0 AS (SELECT p.*, p.soHeaderId % 9 AS supplierId, p.rawBomTotalQty - p.poQty AS orderQty, k.supplierSku, k.supCost, m.categoryName AS fc, i.itemCode, i.inventorySKU AS sku, {_HOME.format(c='p.companyId')} AS home
    FROM procurementProcess p LEFT JOIN md_SupplierSku k ON k.statusflag = 1 AND k.companyId = p.companyId AND k.supplierId = p.soHeaderId % 9 AND k.invId = p.rawBomInvId
    LEFT JOIN md_MasterCategory m ON m.categoryId = k.currencyCode LEFT JOIN md_Inventory i ON i.invID = p.rawBomInvId WHERE p.status = 0),
r AS (SELECT r0.*, CASE WHEN home = fc THEN 1000000 ELSE (SELECT arg_max(foreignRate, rateId) FROM md_CurrencyRate c WHERE c.status = 1 AND c.companyId = r0.companyId AND c.homeCurrency = home
    AND c.foreignCurrency = fc AND DATE '{AS_OF}' BETWEEN c.startDate AND c.endDate) END AS rate FROM r0),
g AS (SELECT * FROM r WHERE NOT ({_bad(_OM_RULES)})),
hd AS (SELECT companyId, supplierId, fc, home, rate, CAST(sum(orderQty * supCost) AS BIGINT) AS net, CAST(sum(orderQty) AS BIGINT) AS qty, row_number() OVER (PARTITION BY companyId ORDER BY supplierId, fc) AS n
       FROM g GROUP BY companyId, supplierId, fc, home, rate),
hn AS (SELECT hd.*, {_no('PO')} AS poName FROM hd JOIN md_SequenceNumber z ON z.csID = hd.companyId AND z.condition = 'PO')"""
register("order_materials_errors", _errors(order), _OM + " " + _err(_OM_RULES, "procurementProcessId", "procurementProcessId"))
register("order_materials_headers", _part(order, "headers"), _OM + """
SELECT companyId, supplierId, fc AS foreignCurrency, home AS homeCurrency, rate AS foreignCurrencyRate, net AS poNetTotal, qty AS poQty, poName, 1079 AS poStatus FROM hn""")
register("order_materials_lines", _part(order, "lines"), _OM + """
SELECT hn.poName, g.soLineItemId, g.rawBomInvId AS invID, g.itemCode, g.supplierSku, CAST(sum(g.orderQty) AS BIGINT) AS qty, g.fc AS currencyCode, g.supCost AS unitPrice, g.supCost * g.rate AS homeCurrencyCost, 1079 AS itemStatus
FROM g JOIN hn ON hn.companyId = g.companyId AND hn.supplierId = g.supplierId AND hn.fc = g.fc GROUP BY ALL""")
register("order_materials_demand", _part(order, "demand", "procurementProcessId", "poQty", "status"), _OM + """
SELECT procurementProcessId, CAST(poQty + orderQty AS BIGINT) AS poQty, CASE WHEN poQty + orderQty = rawBomTotalQty THEN 1 ELSE status END AS status FROM g""")

# --- nested receipt payloads
def _receipts(t):
    lines = t.poLineItem.where(F.col("qty") > F.col("rcvQty")).select("poId", F.col("podetailsId").alias("poDetailsId"), F.ceil((F.col("qty") - F.col("rcvQty")) / 2).cast("int").alias("rcvQty"))
    heads = t.poHeader.select("poId", F.concat(F.lit("DO-"), F.col("poId").cast("string")).alias("DO"), "warehouseId")
    lists = lines.groupBy("poId").agg(F.array_sort(F.collect_list(F.struct("poDetailsId", F.col("rcvQty").cast("string").alias("rcvQty")))).alias("poList"))
    return heads.join(lists, "poId").select(F.to_json(F.array(F.struct(F.col("poId").cast("string").alias("poId"), "DO", "warehouseId", "poList"))).alias("payload"))


receive = lambda t: C.receive_payload(t, _receipts(t), "payload", AS_OF)[0]
_RX = """WITH a AS (SELECT l.poId, 'DO-' || l.poId AS "DO", h.warehouseId, h.companyId, h.supplierId, l.podetailsId, l.invID AS invId, CAST(ceil((l.qty - l.rcvQty) / 2) AS INT) AS q
    FROM poLineItem l JOIN poHeader h ON h.poId = l.poId WHERE l.qty > l.rcvQty),
pl AS (SELECT l.podetailsId, l.poId, CAST(l.rcvQty + coalesce(a.q, 0) AS INT) AS rcvQty, CASE WHEN a.q IS NOT NULL AND l.rcvQty + a.q = l.qty THEN 1087 ELSE l.itemStatus END AS itemStatus
       FROM poLineItem l LEFT JOIN a ON a.podetailsId = l.podetailsId)"""
register("receive_payload_headers", lambda t: receive(t).headers, _RX + f"""
SELECT companyId, "DO", min(supplierId) AS supplierId, min(warehouseId) AS warehouseId, '{AS_OF}' AS poRcvDate, 3159 AS poRcvStatus FROM a GROUP BY companyId, "DO" """)
register("receive_payload_balances", lambda t: receive(t).balances, _RX + ", d AS (SELECT warehouseId, companyId, invId, CAST(sum(q) AS BIGINT) AS q, 0 AS lk FROM a GROUP BY ALL) " + _BALANCES)
register("receive_payload_po_lines", lambda t: receive(t).po_lines.select("podetailsId", "rcvQty", "itemStatus"), _RX + " SELECT podetailsId, rcvQty, itemStatus FROM pl")
register("receive_payload_po_headers", lambda t: receive(t).po_headers.select("poId", "poStatus"), _RX + """
SELECT h.poId, CASE WHEN h.poId IN (SELECT poId FROM a) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.poId = h.poId AND pl.itemStatus NOT IN (1086, 1087)) THEN 1087 ELSE h.poStatus END AS poStatus FROM poHeader h""")

# --- locks
_lock_requests = lambda t: t.procurementProcess.where(F.col("status") == 0).select(
    F.col("soHeaderId").cast("string").alias("requestId"), "procurementProcessId", F.col("companyId").alias("warehouseId"), (F.col("lockQty") + F.col("processQty")).alias("newLockQty"))
lock = lambda t: C.lock_stock(t, _lock_requests(t))
_LK = f"""WITH RECURSIVE r0 AS (SELECT procurementProcessId, soHeaderId, companyId, companyId AS warehouseId, rawBomInvId AS invId, soLineItemId, lockQty, rawBomTotalQty, CAST(processQty AS BIGINT) AS delta FROM procurementProcess WHERE status = 0),
r1 AS (SELECT r0.*, b.balanceQty - b.lockQty AS free FROM r0 LEFT JOIN inventoryBalanceWH b ON b.warehouseId = r0.warehouseId AND b.companyId = r0.companyId AND b.invId = r0.invId),
r2 AS (SELECT *, soHeaderId IN (SELECT soHeaderId FROM r1 WHERE free IS NULL) AS barred FROM r1 WHERE free IS NOT NULL),
{_admitted("r2", "CAST(soHeaderId AS VARCHAR)", "procurementProcessId", ["warehouseId", "companyId", "invId"], "delta", "free", "barred")},
r AS (SELECT r1.*, short.request IS NOT NULL AS lacks FROM r1
      LEFT JOIN short ON short.request = CAST(r1.soHeaderId AS VARCHAR) AND short.k = CAST(r1.warehouseId AS VARCHAR) || '/' || CAST(r1.companyId AS VARCHAR) || '/' || CAST(r1.invId AS VARCHAR)),
g AS (SELECT * FROM r WHERE soHeaderId NOT IN (SELECT soHeaderId FROM r WHERE free IS NULL OR lacks))"""
register("lock_stock_errors", _errors(lock), _LK + """ SELECT CAST(soHeaderId AS VARCHAR) AS requestId, procurementProcessId, 1 AS ruleNo, CAST(warehouseId AS VARCHAR) AS "key" FROM r WHERE free IS NULL OR lacks""")
register("lock_stock_balances", _part(lock, "balances"), _LK + ", d AS (SELECT warehouseId, companyId, invId, 0 AS q, CAST(sum(delta) AS BIGINT) AS lk FROM g GROUP BY ALL) " + _BALANCES)
register("lock_stock_demand", _part(lock, "demand", "procurementProcessId", "lockQty", "status"), _LK + """
SELECT procurementProcessId, lockQty + delta AS lockQty, CASE WHEN lockQty + delta = rawBomTotalQty THEN 1 ELSE 0 END AS status FROM g""")

# --- corrections
_changes = lambda t: t.shipmentLineItem.select(
    "shipmentLineItemId", F.when(F.col("shipmentQty") == 7, F.col("shipQty") + 1).otherwise(F.floor(F.col("shipQty") / 2).cast("int")).alias("newShipQty"), F.lit("recount").alias("newNotes"))
correct = lambda t: C.correct_checkout(t, _changes(t))
_CC = """WITH x AS (SELECT l.*, h.shipId, h.bol, h.companyId, h.pickupAddrId AS warehouseId, CAST(CASE WHEN l.shipmentQty = 7 THEN l.shipQty + 1 ELSE floor(l.shipQty / 2) END AS INT) AS nq
    FROM shipmentLineItem l JOIN shipmentHeader h ON h.shipmentId = l.shipmentId)"""
register("correct_checkout_lines", _part(correct, "shipment_lines", "shipmentLineItemId", "shipQty", "lineItemNotes"), _CC + " SELECT shipmentLineItemId, nq AS shipQty, 'recount' AS lineItemNotes FROM x")
register("correct_checkout_shipments", _part(correct, "shipments", "shipmentId", "shipmentWeight", "bolTotalShipmentWeight"), _CC + """
, nw AS (SELECT l.shipmentId, CAST(sum(coalesce(x.nq, l.shipQty) * i.grossWeight) AS BIGINT) AS w FROM shipmentLineItem l LEFT JOIN x ON x.shipmentLineItemId = l.shipmentLineItemId
         JOIN md_Inventory i ON i.invID = l.invId WHERE l.shipmentId IN (SELECT shipmentId FROM x) GROUP BY 1)
SELECT h.shipmentId, coalesce(nw.w, h.shipmentWeight) AS shipmentWeight, CAST(sum(coalesce(nw.w, h.shipmentWeight)) OVER (PARTITION BY h.bol) AS BIGINT) AS bolTotalShipmentWeight
FROM shipmentHeader h LEFT JOIN nw ON nw.shipmentId = h.shipmentId WHERE h.bol IN (SELECT bol FROM x)""")
register("correct_checkout_balances", _part(correct, "balances"), _CC + ", d AS (SELECT warehouseId, companyId, invId, CAST(sum(shipQty - nq) AS BIGINT) AS q, 0 AS lk FROM x GROUP BY ALL) " + _BALANCES)
register("correct_checkout_order_lines", _part(correct, "so_lines", "soLineItemId", "shpQty", "soLineItemStatus"), _CC + """
SELECT s.soLineItemId, CAST(s.shpQty - sum(x.shipQty - x.nq) AS INT) AS shpQty, 2125 AS soLineItemStatus FROM soLineItem s JOIN x ON x.soLineItemId = s.soLineItemId GROUP BY s.soLineItemId, s.shpQty""")
register("correct_checkout_orders", _part(correct, "so_headers", "soHeaderId", "soStatus"), _CC + """
SELECT DISTINCT s.soHeaderId, 2125 AS soStatus FROM x JOIN soLineItem s ON s.soLineItemId = x.soLineItemId""")

reverse = lambda t: C.reverse_shipment_lines(t, _changes(t))
_RV = _CC + """, r AS (SELECT x.*, l.lrHeaderId, l.lrContainerId FROM x LEFT JOIN lrLineItem l ON l.lrDetailsId = x.lrDetailsId),
g AS (SELECT * FROM r WHERE shipmentId NOT IN (SELECT shipmentId FROM r WHERE nq > shipQty OR lineItemStatus <> 2149))"""
register("reverse_shipment_lines_errors", _errors(reverse), _RV + """
SELECT shipmentId, shipmentLineItemId, 1 AS ruleNo, shipmentLineItemId AS "key" FROM r WHERE nq > shipQty UNION ALL SELECT shipmentId, shipmentLineItemId, 2, shipmentLineItemId FROM r WHERE lineItemStatus <> 2149""")
register("reverse_shipment_lines_movements", _part(reverse, "movements"), _RV + """
SELECT warehouseId, companyId, 'REVSHIP' AS action, shipId AS actionKey, invId, shipQty - nq AS qty, 'recount|Reverse shipQty From ' || shipQty || ' to ' || nq AS reason FROM g""")
register("reverse_shipment_lines_balances", _part(reverse, "balances"), _RV + ", d AS (SELECT warehouseId, companyId, invId, CAST(sum(shipQty - nq) AS BIGINT) AS q, 0 AS lk FROM g GROUP BY ALL) " + _BALANCES)
register("reverse_shipment_lines_order_lines", _part(reverse, "so_lines", "soLineItemId", "shpQty"), _RV + """
SELECT s.soLineItemId, CAST(s.shpQty - sum(g.shipQty - g.nq) AS INT) AS shpQty FROM soLineItem s JOIN g ON g.soLineItemId = s.soLineItemId GROUP BY s.soLineItemId, s.shpQty""")
register("reverse_shipment_lines_request_lines", _part(reverse, "lr_lines", "lrDetailsId", "processQty", "itemStatus"), _RV + """
SELECT s.lrDetailsId, CAST(s.processQty - sum(g.shipQty - g.nq) AS INT) AS processQty, 2135 AS itemStatus FROM lrLineItem s JOIN g ON g.lrDetailsId = s.lrDetailsId GROUP BY s.lrDetailsId, s.processQty""")

pickup = lambda t: C.confirm_pickup(t, t.shipmentHeader.where(F.col("containerPullOutDate").isNull()).select("bol").distinct(), AS_OF)
_PU = "WITH s AS (SELECT * FROM shipmentHeader WHERE bol IN (SELECT bol FROM shipmentHeader WHERE containerPullOutDate IS NULL))"
register("confirm_pickup_shipments", _part(pickup, "shipments", "shipmentId", "containerPullOutDate"), _PU + f" SELECT shipmentId, '{AS_OF}' AS containerPullOutDate FROM s")
register("confirm_pickup_receipts", _part(pickup, "receipts"), _PU + """
, l AS (SELECT p.poId, s.shipId || '.csv' AS "DO", d.warehouseId, p.podetailsId AS pd, x.shipQty AS rq FROM shipmentLineItem x JOIN s ON s.shipmentId = x.shipmentId LEFT JOIN md_ShipToDestination d ON d.shipToId = s.shipToId
        JOIN soLineItem o ON o.soLineItemId = x.soLineItemId JOIN poLineItem p ON p.podetailsId = o.ref_poLineItemId)
SELECT poId, "DO", '[{"poId":' || poId || ',"DO":"' || "DO" || '","warehouseId":' || warehouseId || ',"poList":[' || string_agg('{"poDetailsId":"' || pd || '","rcvQty":' || rq || '}', ',' ORDER BY pd, rq) || ']}]' AS payload
FROM l GROUP BY poId, "DO", warehouseId""")

# --- prices, rates, dates
rerate = lambda t: C.rerate_purchase_orders(t, t.poHeader.where(F.col("poStatus") == 1079).select("poId", (F.lit(1400000) + F.col("poId") % 100).alias("currencyRate")))
_RR = """WITH q AS (SELECT poId, 1400000 + poId % 100 AS rate FROM poHeader WHERE poStatus = 1079),
n AS (SELECT poId, CAST(sum(unitPrice * qty) AS BIGINT) AS net FROM poLineItem WHERE itemStatus <> 1086 GROUP BY 1)"""
register("rerate_purchase_orders_lines", _part(rerate, "lines", "podetailsId", "homeCurrencyCost"), _RR + " SELECT l.podetailsId, l.unitPrice * q.rate AS homeCurrencyCost FROM poLineItem l JOIN q ON q.poId = l.poId")
register("rerate_purchase_orders_headers", _part(rerate, "headers", "poId", "foreignCurrencyRate", "poNetTotal", "poGrossTotal"), _RR + """
SELECT q.poId, q.rate AS foreignCurrencyRate, coalesce(n.net, 0) AS poNetTotal, coalesce(n.net, 0) AS poGrossTotal FROM q LEFT JOIN n ON n.poId = q.poId""")
reprice = lambda t: C.reprice_lines(t, t.poLineItem.select("podetailsId", (F.col("unitPrice") + 100).alias("unitCost")))
_RP = """WITH x AS (SELECT podetailsId, poId, unitPrice + 100 AS np FROM poLineItem)"""
register("reprice_lines_lines", _part(reprice, "lines", "podetailsId", "unitPrice", "homeCurrencyCost"), _RP + """
SELECT x.podetailsId, x.np AS unitPrice, x.np * h.foreignCurrencyRate AS homeCurrencyCost FROM x JOIN poHeader h ON h.poId = x.poId""")
register("reprice_lines_headers", _part(reprice, "headers", "poId", "poNetTotal", "poGrossTotal"), _RP + """
SELECT h.poId, coalesce(CAST(sum(CASE WHEN l.itemStatus <> 1086 THEN coalesce(x.np, l.unitPrice) * l.qty END) AS BIGINT), 0) AS poNetTotal,
       coalesce(CAST(sum(CASE WHEN l.itemStatus <> 1086 THEN coalesce(x.np, l.unitPrice) * l.qty END) AS BIGINT), 0) AS poGrossTotal
FROM poHeader h JOIN poLineItem l ON l.poId = h.poId LEFT JOIN x ON x.podetailsId = l.podetailsId WHERE h.poId IN (SELECT poId FROM x) GROUP BY h.poId""")
dates = lambda t: C.move_ship_dates(t, t.soHeader.select("soHeaderId", F.date_add("earlyShipDate", 10).alias("newShipDate")), "1998-01-01")
register("move_ship_dates_orders", _part(dates, "so_headers", "soHeaderId", "earlyShipDate", "lateShipDate", "lastUpdatedDate"), """
SELECT soHeaderId, CAST(CAST(earlyShipDate + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS earlyShipDate, CAST(CAST(earlyShipDate + INTERVAL 17 DAY AS DATE) AS VARCHAR) AS lateShipDate,
       CASE WHEN soStatus <> 1105 THEN '1998-01-01' END AS lastUpdatedDate FROM soHeader WHERE earlyShipDate + INTERVAL 10 DAY >= DATE '1998-01-01'""")
register("move_ship_dates_pos", _part(dates, "po_headers", "poId", "poEarlyShipDate", "poLateShipDate"), """
SELECT p.poId, CAST(CAST(s.earlyShipDate + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS poEarlyShipDate, CAST(CAST(s.earlyShipDate + INTERVAL 17 DAY AS DATE) AS VARCHAR) AS poLateShipDate
FROM poHeader p JOIN soHeader s ON s.soName = p.poReferenceId WHERE s.earlyShipDate + INTERVAL 10 DAY >= DATE '1998-01-01'""")

# --- exports
export = lambda t: C.export_loading_template(t, _each(t.soHeader, "soHeaderId"))
_EX = """WITH r AS (SELECT s.soHeaderId, s.soName, s.soStatus, p.poId, p.poName, p.poStatus, p.reference1, p.poEarlyShipDate, x.portName AS pod FROM soHeader s LEFT JOIN poHeader p ON p.poReferenceId = s.soName
    LEFT JOIN md_ShipToDestination d ON d.shipToId = p.shipToId LEFT JOIN md_Port x ON x.portId = d.pod),
g AS (SELECT * FROM r WHERE soStatus = 2125 AND (poId IS NULL OR poStatus IN (1077, 1085)))"""
register("export_loading_template", lambda t: export(t).rows, _EX + """
SELECT g.poName, g.reference1 AS customerPo, g.pod, i.productName, l.supplierSku, l.merchantSku, CAST(l.qty - l.lrQty AS VARCHAR) AS lrQty, strftime(g.poEarlyShipDate, '%Y%m%d') AS shipDate, '' AS containerType,
       '' AS containerSeq, '' AS notes, '' AS qtyPerCarton, l.podetailsId AS poDetailsId FROM g JOIN poLineItem l ON l.poId = g.poId AND l.itemStatus IN (1077, 1085) AND l.qty > l.lrQty JOIN md_Inventory i ON i.invID = l.invID""")
register("export_loading_template_errors", lambda t: export(t).errors.drop("rule"), _EX + """
SELECT CAST(soHeaderId AS VARCHAR) AS requestId, soHeaderId, 1 AS ruleNo, soName AS "key" FROM r WHERE soStatus <> 2125
UNION ALL SELECT CAST(soHeaderId AS VARCHAR), soHeaderId, 2, poName FROM r WHERE poId IS NOT NULL AND poStatus NOT IN (1077, 1085)""")
register("export_receipt_template", lambda t: C.export_receipt_template(t, AS_OF), f"""
WITH l AS (SELECT l.poId, l.supplierSku, l.qty, h.poName FROM poLineItem l JOIN poHeader h ON h.poId = l.poId WHERE h.poStatus = 1077 AND l.itemStatus = 1077)
SELECT DISTINCT poId, 'DO' AS recordType, '' AS doNo, '{AS_OF}' AS column2, '' AS column3, '' AS column4, '' AS column5, '' AS column6 FROM l
UNION ALL SELECT poId, 'DL', '', poName, '', supplierSku, CAST(qty AS VARCHAR), '' FROM l""")

# --- work-order corrections
_wo_requests = lambda t: t.workOrderLineItem.select(
    F.col("workOrderLineItemId").alias("requestId"), "workOrderLineItemId", (F.col("qty") - 2).alias("newQty"), F.when(F.col("qty") == 50, F.col("qty")).otherwise(F.col("confirmQty") - 5).alias("newConfirmQty"),
    F.when(F.col("qty") == 47, "").otherwise("fewer").alias("notes"))
confirm = lambda t: C.correct_confirm_qty(t, _wo_requests(t))
_WC = """WITH g AS (SELECT *, qty - 2 AS nq, confirmQty - 5 AS nc FROM workOrderLineItem WHERE qty NOT IN (47, 50) AND confirmQty - 5 <= qty - 2)"""
register("correct_confirm_qty_errors", _errors(confirm), """
SELECT workOrderLineItemId AS requestId, workOrderLineItemId, 1 AS ruleNo, '' AS "key" FROM workOrderLineItem WHERE qty = 47
UNION ALL SELECT workOrderLineItemId, workOrderLineItemId, 2, CAST(workOrderLineItemId AS VARCHAR) FROM workOrderLineItem WHERE CASE WHEN qty = 50 THEN qty ELSE confirmQty - 5 END > qty - 2""")
register("correct_confirm_qty_lines", _part(confirm, "lines", "workOrderLineItemId", "qty", "confirmQty", "workOrderItemNote"), _WC + " SELECT workOrderLineItemId, nq AS qty, nc AS confirmQty, 'fewer' AS workOrderItemNote FROM g")
register("correct_confirm_qty_order_lines", _part(confirm, "so_lines", "soLineItemId", "processQty"), _WC + " SELECT s.soLineItemId, CAST(s.processQty - 5 AS INT) AS processQty FROM soLineItem s JOIN g ON g.soLineItemId = s.soLineItemId")
register("correct_confirm_qty_audit", _part(confirm, "audit", "workOrderLineItemId", "revisionNo", "payload"), _WC + """
SELECT g.workOrderLineItemId, h.revision + row_number() OVER (PARTITION BY g.workOrderHeaderId ORDER BY g.workOrderLineItemId) AS revisionNo,
       '{"column":"UpdateConfirmQty","oldValue":"' || confirmQty || '","newValue":"' || nc || '"}' AS payload FROM g JOIN workOrderHeader h ON h.workOrderHeaderId = g.workOrderHeaderId""")
target = lambda t: C.move_target_dates(t, t.workOrderHeader.where(F.col("workOrderStatus") == 5230).select("workOrderHeaderId", F.date_add("targetCompleteDate", 3).alias("newTargetDate")))
register("move_target_dates_headers", _part(target, "headers", "workOrderHeaderId", "targetCompleteDate", "revision"), """
SELECT workOrderHeaderId, CAST(CAST(targetCompleteDate + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS targetCompleteDate, CAST(revision + 1 AS INT) AS revision FROM workOrderHeader WHERE workOrderStatus = 5230""")
register("move_target_dates_audit", _part(target, "audit", "workOrderHeaderId", "revisionNo", "payload"), """
SELECT workOrderHeaderId, CAST(revision + 1 AS BIGINT) AS revisionNo, '{"column":"TargetCompleteDate","oldValue":"' || targetCompleteDate || '","newValue":"' || CAST(targetCompleteDate + INTERVAL 3 DAY AS DATE) || '"}' AS payload
FROM workOrderHeader WHERE workOrderStatus = 5230""")
