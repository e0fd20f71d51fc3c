"""Bulk loads over all staged files: accepted rows, errors, messages, resulting documents."""

from pyspark.sql import functions as F

from ..operators import validate as val
from ..plans import loads as B
from . import register

AS_OF = "1996-01-01"


def _blank(x):
    return f"coalesce(trim(CAST({x} AS VARCHAR)), '') = ''"


def _eq(a, b):
    return f"lower(rtrim({a})) = lower(rtrim({b}))"


def _load(name, check, rows, rules, scope, row_id, accepted, strict=True):
    """Register ``<name>_errors`` and ``<name>_accepted``; ``rules`` are (condition, key) over the CTE ``r``."""
    any_rule = " OR ".join(f"coalesce({c}, false)" for c, _ in rules)
    errors = " UNION ALL ".join(f"SELECT {scope}, {row_id}, {i} AS ruleNo, CAST({k} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(rules, 1))
    register(f"{name}_errors", lambda t: check(t).errors.drop("rule"), f"{rows} {errors}")
    register(f"{name}_accepted", lambda t: check(t).accepted,
             f"{rows} SELECT {accepted} FROM r WHERE {scope} NOT IN (SELECT {scope} FROM r WHERE {any_rule})")
    return any_rule


# --- sales orders
_SO_ROWS = f"""WITH r0 AS (
  SELECT s.*, try_cast(s.shipDate AS DATE) AS ship, try_cast(s.orderQty AS INT) AS q, c.customerId
  FROM temp_SoFilelog s LEFT JOIN md_Customer c ON {_eq('s.customerName', 'c.customerName')} AND c.companyId = s.companyId
  WHERE NOT ({_blank('s.customerName')} AND {_blank('s.customerPO')})),
h AS (SELECT DISTINCT r0.companyId, r0.customerId, lower(trim(r0.customerPO)) AS po FROM r0 JOIN soHeader o ON o.companyId = r0.companyId AND o.customerId = r0.customerId
      WHERE NOT {_blank('r0.customerPO')} AND contains(lower(trim(o.customerPO)), lower(trim(r0.customerPO)))),
r AS (SELECT r0.*, h.po IS NOT NULL AS held, coalesce(d1.shipToId, d2.shipToId) AS shipToId, coalesce(d1.pod, d2.pod) AS pod, k.customerskuId, k.invID, k.csCost, k.currencyCode,
             k.tagDivision, k.EAN, k.itemDesc AS skuDesc, i.itemDesc AS invDesc, i.modelNo,
             CASE WHEN {_blank('r0.destinationlabel')} THEN r0.destination ELSE r0.destinationlabel END AS place
      FROM r0 LEFT JOIN h ON h.companyId = r0.companyId AND h.customerId = r0.customerId AND h.po = lower(trim(r0.customerPO))
      LEFT JOIN md_ShipToDestination d1 ON {_eq('r0.destinationlabel', 'd1.locNo')} AND d1.companyId = r0.companyId AND d1.customerId = r0.customerId
      LEFT JOIN md_ShipToDestination d2 ON {_eq('r0.destination', 'd2.shipToLabel')} AND d2.companyId = r0.companyId AND d2.customerId = r0.customerId
      LEFT JOIN md_CustomerSku k ON k.statusflag = 1 AND {_eq('r0.customerSku', 'k.customerSku')} AND k.companyId = r0.companyId AND k.customerId = r0.customerId
           AND {_eq('r0.csitemCode', 'k.merchantSKU')}
      LEFT JOIN md_Inventory i ON i.invID = k.invID AND i.status = 1)"""
_SO_RULES = [(_blank("customerName"), "''"), (_blank("customerPO"), "''"), (_blank("customerSku"), "''"), ("ship IS NULL", "''"), (f"ship <= DATE '{AS_OF}'", "customerPO"),
             ("q IS NULL OR q <= 0", "orderQty"), (f"customerId IS NULL AND NOT {_blank('customerName')}", "customerName"), ("held", "customerPO"),
             ("shipToId IS NULL AND customerId IS NOT NULL", "place"), ("shipToId IS NOT NULL AND coalesce(pod, 0) = 0", "place"),
             (f"customerskuId IS NULL AND customerId IS NOT NULL AND NOT {_blank('customerSku')}", "customerSku")]
_SO_COLS = f"""sofilelog_Id, fileLoaded, companyId, customerId, customerPO, thirdPartyCustomer, thirdPartyPO, shipToId, pod, CAST(ship AS VARCHAR) AS shipDate,
    CAST(CAST(ship + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS cancelDate, customerskuId, customerSku, csitemCode AS merchantSku, EAN, invID, modelNo,
    CASE WHEN NOT {_blank('skuDesc')} THEN skuDesc ELSE invDesc END AS soItemDesc, csCost, currencyCode, tagDivision, q AS orderQty"""


def _check_so(t, strict=True):
    return B.check_sales_order_file(t, AS_OF, strict=strict)


_SO_ANY = _load("sales_order_load", _check_so, _SO_ROWS, _SO_RULES, "fileLoaded", "sofilelog_Id", _SO_COLS)
register("sales_order_load_row_mode", lambda t: _check_so(t, strict=False).accepted, f"{_SO_ROWS} SELECT {_SO_COLS} FROM r WHERE NOT ({_SO_ANY})")

_PLAIN_MESSAGES = ["Customer name is required", "Customer PO is required", "Customer SKU is required", "Ship date is not a date", "Customer PO {} has a ship date in the past",
                   "Quantity {} is not a positive whole number", "Customer {} is not set up", "Customer PO {} is already on an order", "Destination {} is not set up",
                   "Destination {} has no port", "Customer SKU {} is not set up"]
_SO_ERRORS = " UNION ALL ".join(f"SELECT fileLoaded, {i} AS ruleNo, coalesce(CAST({k} AS VARCHAR), '') AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(_SO_RULES, 1))
_TEXTS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(_PLAIN_MESSAGES, 1))
_SUMMARY = f"""{_SO_ROWS}, e AS (SELECT DISTINCT * FROM ({_SO_ERRORS})), x(ruleNo, txt) AS (VALUES {_TEXTS})
SELECT e.fileLoaded, e.ruleNo, 1 AS part, count(*) AS keyCount, replace(x.txt, '{{}}', string_agg("key", ',' ORDER BY "key")) AS message
FROM e JOIN x ON x.ruleNo = e.ruleNo {{where}} GROUP BY e.fileLoaded, e.ruleNo, x.txt"""
register("sales_order_load_messages", lambda t: val.error_summary(_check_so(t).errors, ["fileLoaded"]), _SUMMARY.replace("{where}", ""))
_so_documents = lambda t: _check_so(t).errors.join(t.temp_SoFilelog.select("sofilelog_Id", F.coalesce("customerPO", F.lit("")).alias("customerPO")), "sofilelog_Id")
_NESTED_ERRORS = _SO_ERRORS.replace("SELECT fileLoaded,", "SELECT fileLoaded, coalesce(customerPO, '') AS customerPO,")
register("sales_order_load_nested_messages", lambda t: val.nested_error_summary(_so_documents(t), ["fileLoaded"], "customerPO"), f"""{_SO_ROWS},
e AS (SELECT *, (row_number() OVER (PARTITION BY fileLoaded, customerPO, ruleNo ORDER BY "key") - 1) // 100 + 1 AS part FROM (SELECT DISTINCT * FROM ({_NESTED_ERRORS}))), x(ruleNo, txt) AS (VALUES {_TEXTS})
SELECT e.fileLoaded, e.ruleNo, e.customerPO, CAST(e.part AS INT) AS part, count(*) AS keyCount, replace(x.txt, '{{}}', concat(string_agg("key", ',' ORDER BY "key"), ' (', e.customerPO, ')')) AS message
FROM e JOIN x ON x.ruleNo = e.ruleNo GROUP BY e.fileLoaded, e.ruleNo, e.customerPO, e.part, x.txt""")
register("sales_order_load_first_message", lambda t: val.first_errors(_check_so(t).errors, ["fileLoaded"]),
         _SUMMARY.replace("{where}", "WHERE e.ruleNo = (SELECT min(y.ruleNo) FROM e y WHERE y.fileLoaded = e.fileLoaded)"))

_SO_ACC = f"{_SO_ROWS}, a AS (SELECT {_SO_COLS} FROM r WHERE NOT ({_SO_ANY})), "
_NUMBER = """replace(replace(s.ItemFormat, 'yy', '96'), 'xxxxx', CASE WHEN length(CAST(s.NextNum + n - 1 AS VARCHAR)) >= 5 THEN CAST(s.NextNum + n - 1 AS VARCHAR)
             ELSE lpad(CAST(s.NextNum + n - 1 AS VARCHAR), 5, '0') END)"""
_SO_HEADS = _SO_ACC + f"""g AS (SELECT companyId, customerId, customerPO, min(shipToId) AS shipToId, min(pod) AS portOfDestination, min(shipDate) AS earlyShipDate, min(cancelDate) AS lateShipDate,
    min(thirdPartyCustomer) AS thirdParty, min(thirdPartyPO) AS thirdPartyPO, row_number() OVER (PARTITION BY companyId ORDER BY customerId, customerPO) AS n
    FROM a GROUP BY companyId, customerId, customerPO),
d AS (SELECT g.* EXCLUDE (n), 'tempSO_' || {_NUMBER} AS soName, '{AS_OF}' AS soDate, 1105 AS soStatus FROM g LEFT JOIN md_SequenceNumber s ON s.csID = g.companyId AND s.condition = 'SO')"""


def _so_docs(t):
    return B.sales_order_documents(t, _check_so(t, strict=False).accepted, AS_OF)


register("sales_order_load_headers", lambda t: _so_docs(t).headers, _SO_HEADS + " SELECT * FROM d")
register("sales_order_load_lines", lambda t: _so_docs(t).lines, _SO_HEADS + f"""
SELECT d.soName, a.invID, a.customerskuId, a.customerSku, a.soItemDesc, a.merchantSku, a.EAN, a.csCost, a.currencyCode, a.tagDivision, CAST(sum(orderQty) AS BIGINT) AS odrQty,
       CASE WHEN {_blank('a.merchantSku')} THEN a.modelNo ELSE a.merchantSku END AS itemReference1, 1105 AS soLineItemStatus
FROM a JOIN d ON d.companyId = a.companyId AND d.customerId = a.customerId AND d.customerPO = a.customerPO
GROUP BY d.soName, a.invID, a.customerskuId, a.customerSku, a.soItemDesc, a.merchantSku, a.EAN, a.csCost, a.currencyCode, a.tagDivision, a.modelNo""")
register("sales_order_load_merged", lambda t: B.merged_sales_order_documents(t, _check_so(t, strict=False).accepted, AS_OF).headers, _SO_ACC + f"""
g AS (SELECT companyId, customerId, shipDate, thirdPartyCustomer, shipToId, string_agg(DISTINCT customerPO, ', ' ORDER BY customerPO) AS customerPO, min(pod) AS portOfDestination,
             min(cancelDate) AS lateShipDate, row_number() OVER (PARTITION BY companyId ORDER BY customerId, shipDate, thirdPartyCustomer, shipToId) AS n
      FROM a GROUP BY companyId, customerId, shipDate, thirdPartyCustomer, shipToId)
SELECT g.* EXCLUDE (n), 'tempSO_' || {_NUMBER} AS soName, 1105 AS soStatus FROM g LEFT JOIN md_SequenceNumber s ON s.csID = g.companyId AND s.condition = 'SO'""")

# --- loading requests
_LR_BASE = f"""WITH r0 AS (
  SELECT s.*, try_cast(s.lrQty AS INT) AS q, try_cast(s.containerSeq AS INT) AS seq, try_cast(s.shipDate AS DATE) AS ship, p.portId, h.poId, h.supplierId,
         l.invID, l.soLineItemId, l.qty - l.lrQty AS openQty, m.categoryId AS containerTypeId
  FROM temp_lrLog s LEFT JOIN md_Port p ON {_eq('s.pod', 'p.portName')} LEFT JOIN poHeader h ON {_eq('s.poName', 'h.poName')} AND h.companyId = s.companyId
  LEFT JOIN poLineItem l ON l.poId = h.poId AND l.podetailsId = s.poDetailsId
  LEFT JOIN md_MasterCategory m ON m.categoryParentID = 3153 AND {_eq('s.containerType', 'm.categoryName')} WHERE NOT {_blank('s.poName')})"""
_LR_ROWS = _LR_BASE + """, r AS (SELECT r0.*,
  (SELECT count(DISTINCT portId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS ports, (SELECT count(DISTINCT shipDate) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS dates,
  (SELECT count(DISTINCT supplierId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS suppliers,
  (SELECT count(DISTINCT containerTypeId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded AND x.containerSeq = r0.containerSeq) > 1 AS types,
  (SELECT count(DISTINCT notes) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded AND x.containerSeq = r0.containerSeq) > 1 AS noteses,
  (SELECT sum(q) > max(openQty) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded AND x.poDetailsId = r0.poDetailsId) AS over FROM r0)"""
_LR_BLANKS = " OR ".join(f"({_blank(c)})" for c in ("customerPo", "pod", "supplierSku", "merchantSku", "lrQty", "shipDate", "containerType", "containerSeq", "poDetailsId"))
_LR_RULES = [(f"({_LR_BLANKS})", "''"), ("(q IS NULL OR q <= 0 OR seq IS NULL OR seq <= 0)", "''"), ("ports", "''"), (f"ship <= DATE '{AS_OF}'", "poName"), ("dates", "poName"),
             (f"poId IS NULL AND NOT {_blank('poName')}", "poName"), ("suppliers", "''"), ("poId IS NOT NULL AND invID IS NULL", "poDetailsId"), ("over", "supplierSku"),
             ("containerTypeId IS NULL", "containerType"), ("types", "containerSeq"), ("noteses", "containerSeq")]
_LR_COLS = """lrLogId, fileLoaded, companyId, supplierId, portId, poId, poDetailsId, invID, (SELECT soHeaderId FROM soLineItem z WHERE z.soLineItemId = r.soLineItemId) AS soHeaderId,
    soLineItemId, supplierSku, containerTypeId, seq AS containerSeq, q AS qty, CAST(ship AS VARCHAR) AS earlyShipDate, CAST(CAST(ship + INTERVAL 9 DAY AS DATE) AS VARCHAR) AS lateShipDate,
    CAST(CAST(ship - INTERVAL 2 DAY AS DATE) AS VARCHAR) AS cargoReadyDate, notes, CAST(qtyPerCarton AS INT) AS qtyPerCarton"""


def _check_lr(t):
    return B.check_loading_request_file(t, AS_OF)


_LR_ANY = _load("loading_request_load", _check_lr, _LR_ROWS, _LR_RULES, "fileLoaded", "lrLogId", _LR_COLS)
_LR_ACC = f"{_LR_ROWS}, a AS (SELECT {_LR_COLS} FROM r WHERE fileLoaded NOT IN (SELECT fileLoaded FROM r WHERE {_LR_ANY}))"
register("loading_request_load_headers", lambda t: B.loading_request_documents(t, _check_lr(t).accepted, AS_OF).headers, _LR_ACC + f""",
g AS (SELECT fileLoaded, companyId, min(supplierId) AS supplierId, min(earlyShipDate) AS lrShipDate, row_number() OVER (PARTITION BY companyId ORDER BY fileLoaded) AS n FROM a GROUP BY fileLoaded, companyId)
SELECT g.* EXCLUDE (n), 'tempLR_' || {_NUMBER} AS lrName, 2132 AS lrStatus FROM g LEFT JOIN md_SequenceNumber s ON s.csID = g.companyId AND s.condition = 'LR'""")
register("loading_request_load_containers", lambda t: B.loading_request_documents(t, _check_lr(t).accepted, AS_OF).containers.drop("lrName"), _LR_ACC + """
SELECT containerSeq, min(containerTypeId) AS containerTypeId, min(portId) AS portId, min(earlyShipDate) AS earlyShipDate, min(lateShipDate) AS lateShipDate,
       min(cargoReadyDate) AS cargoReadyDate, min(notes) AS notes, 2132 AS containerStatus FROM a GROUP BY fileLoaded, containerSeq""")
register("loading_request_load_po_lines", lambda t: B.loading_request_documents(t, _check_lr(t).accepted, AS_OF).po_lines.select("podetailsId", "lrQty"), _LR_ACC + """
SELECT l.podetailsId, CAST(l.lrQty + coalesce((SELECT sum(qty) FROM a WHERE a.poDetailsId = l.podetailsId), 0) AS INT) AS lrQty FROM poLineItem l""")
register("loading_request_partial_alerts", lambda t: B.partial_request_alerts(t), _LR_BASE + """
SELECT fileLoaded, poId, poDetailsId, poName, supplierSku, CAST(sum(q) AS BIGINT) AS newLrQty, max(openQty) AS openLrQty FROM r0 WHERE q IS NOT NULL GROUP BY ALL HAVING sum(q) < max(openQty)""")

# --- loading plans
_LP_ROWS = f"""WITH r0 AS (
  SELECT s.*, try_cast(s.lrQty AS INT) AS q, try_cast(s.containerSeq AS INT) AS seq, try_cast(s.shipDate AS DATE) AS ship, c.customerId, d.shipToId, m.categoryId AS containerTypeId,
         (SELECT arg_min(k.invID, k.customerskuId) FROM md_CustomerSku k WHERE k.statusflag = 1 AND {_eq('k.merchantSKU', 's.merchantSku')} AND k.customerId = c.customerId AND k.companyId = s.companyId) AS invID
  FROM temp_loadingPlanningLog s LEFT JOIN md_Customer c ON {_eq('s.customerName', 'c.customerName')} AND c.companyId = s.companyId AND c.status = 1
  LEFT JOIN md_ShipToDestination d ON {_eq('s.shipToLabel', 'd.shipToLabel')} AND d.customerId = c.customerId AND d.companyId = s.companyId
  LEFT JOIN md_MasterCategory m ON m.categoryParentID = 3153 AND {_eq('s.containerType', 'm.categoryName')}
  WHERE NOT {_blank('s.containerType')} AND NOT {_blank('s.containerSeq')}),
r AS (SELECT r0.*, (SELECT count(DISTINCT containerTypeId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded AND x.containerSeq = r0.containerSeq) > 1 AS types,
  (SELECT count(DISTINCT customerId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS customers, (SELECT count(DISTINCT shipDate) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS dates,
  (SELECT count(DISTINCT shipToId) FROM r0 x WHERE x.fileLoaded = r0.fileLoaded) > 1 AS places FROM r0)"""
_LP_BLANKS = " OR ".join(f"({_blank(c)})" for c in ("customerName", "merchantSku", "lrQty", "shipDate", "shipToLabel"))
_load("loading_plan_load", lambda t: B.check_loading_plan_file(t), _LP_ROWS,
      [(f"({_LP_BLANKS})", "''"), ("(q IS NULL OR q <= 0 OR seq IS NULL OR seq <= 0)", "''"), ("containerTypeId IS NULL", "containerType"), ("types", "containerSeq"),
       (f"customerId IS NULL AND NOT {_blank('customerName')}", "customerName"), ("customers", "''"), ("dates", "''"), ("places", "''"), ("invID IS NULL AND customerId IS NOT NULL", "merchantSku")],
      "fileLoaded", "lrLogId", """lrLogId, fileLoaded, companyId, containerTypeId, seq AS containerSeq, customerId, shipToId, invID, q AS lrQty, CAST(ship AS VARCHAR) AS shipDate,
      CAST(CAST(ship + INTERVAL 8 DAY AS DATE) AS VARCHAR) AS lateShipDate, notes""")

# --- receipts
_RC_ROWS = f"""WITH s0 AS (SELECT *, upper(trim(recordType)) AS kind, column1 AS doNo, lower(rtrim(column1)) AS no FROM temp_poReceivedLog WHERE NOT {_blank('recordType')}),
s1 AS (SELECT *, kind = 'DL' AS dl, kind = 'DO' AS "do", CASE WHEN kind = 'DO' THEN try_cast(column2 AS DATE) END AS dt, CASE WHEN kind = 'DL' THEN column2 END AS poName,
              CASE WHEN kind = 'DL' THEN column3 END AS wl, CASE WHEN kind = 'DL' THEN column4 END AS supplierSku, CASE WHEN kind = 'DL' THEN column5 END AS qt FROM s0),
sd AS (SELECT fileName, no, bool_or("do") AS hasDo, bool_or(dl) AS hasDl, max(dt) AS doDate, max(CASE WHEN "do" THEN column3 END) AS doNotes, count(DISTINCT lower(rtrim(wl))) AS labels
       FROM s1 WHERE NOT {_blank('doNo')} GROUP BY ALL),
s2 AS (SELECT s1.*, try_cast(qt AS INT) AS rcvQty, sd.hasDo, sd.hasDl, sd.doDate, sd.doNotes, sd.labels, w.warehouseId, h.poId, h.supplierId,
              (SELECT min(l.podetailsId) FROM poLineItem l WHERE l.poId = h.poId AND {_eq('l.supplierSku', 's1.supplierSku')}) AS poDetailsId
       FROM s1 LEFT JOIN sd ON sd.fileName = s1.fileName AND sd.no = s1.no LEFT JOIN md_Warehouse w ON {_eq('s1.wl', 'w.label')} AND w.companyId = s1.companyId
       LEFT JOIN poHeader h ON {_eq('s1.poName', 'h.poName')} AND h.companyId = s1.companyId),
s3 AS (SELECT s2.*, l.invID AS invId, l.qty - l.rcvQty AS openQty,
              EXISTS (SELECT 1 FROM poReceivedHeader p WHERE lower(rtrim(p.supplierDO)) = s2.no AND p.supplierId = s2.supplierId AND p.companyId = s2.companyId) AS used
       FROM s2 LEFT JOIN poLineItem l ON l.podetailsId = s2.poDetailsId),
r AS (SELECT s3.*, (SELECT sum(x.rcvQty) > max(x.openQty) FROM s3 x WHERE x.fileName = s3.fileName AND x.poDetailsId = s3.poDetailsId) AS over FROM s3)"""
_RC_RULES = [("kind NOT IN ('DO', 'DL')", "recordType"), (_blank("doNo"), "''"), (f'"do" AND {_blank("column2")}', "''"),
             (f"dl AND (({_blank('wl')}) OR ({_blank('poName')}) OR ({_blank('supplierSku')}) OR ({_blank('qt')}))", "''"), (f'"do" AND NOT {_blank("column2")} AND dt IS NULL', "''"),
             (f"dl AND NOT {_blank('qt')} AND rcvQty IS NULL", "qt"), ("NOT (hasDo AND hasDl)", "doNo"), (f"warehouseId IS NULL AND NOT {_blank('wl')}", "wl"), ("dl AND labels > 1", "doNo"),
             (f"poId IS NULL AND NOT {_blank('poName')}", "poName"), (f"poId IS NOT NULL AND poDetailsId IS NULL AND NOT {_blank('supplierSku')}", "supplierSku"), ("over", "supplierSku"), ("used", "doNo")]
_RC_COLS = "poReceivedLogId, fileName, companyId, doNo, CAST(doDate AS VARCHAR) AS doDate, doNotes, poId, poDetailsId, supplierId, warehouseId, invId, supplierSku, rcvQty, column6 AS notes"


def _check_rc(t):
    return B.check_receipt_file(t)


_RC_ANY = " OR ".join(f"coalesce({c}, false)" for c, _ in _RC_RULES)
register("receipt_load_errors", lambda t: _check_rc(t).errors.drop("rule"),
         _RC_ROWS + " " + " UNION ALL ".join(f"SELECT fileName, poReceivedLogId, {i} AS ruleNo, CAST({k} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(_RC_RULES, 1)))
_RC_ACC = f"{_RC_ROWS}, a AS (SELECT {_RC_COLS} FROM r WHERE dl AND fileName NOT IN (SELECT fileName FROM r WHERE {_RC_ANY}))"
register("receipt_load_accepted", lambda t: _check_rc(t).accepted, _RC_ACC + " SELECT * FROM a")


def _rc_docs(t):
    return B.receive(t, _check_rc(t).accepted, ["doNo"])


register("receipt_load_headers", lambda t: _rc_docs(t).headers, _RC_ACC + """
SELECT companyId, doNo, min(supplierId) AS supplierId, min(warehouseId) AS warehouseId, min(doDate) AS poRcvDate, 3159 AS poRcvStatus FROM a GROUP BY companyId, doNo""")
register("receipt_load_balances", lambda t: _rc_docs(t).balances, _RC_ACC + """
SELECT coalesce(b.warehouseId, m.warehouseId) AS warehouseId, coalesce(b.companyId, m.companyId) AS companyId, coalesce(b.invId, m.invId) AS invId,
       coalesce(b.balanceQty, 0) + coalesce(m.q, 0) AS balanceQty, coalesce(b.lockQty, 0) AS lockQty
FROM inventoryBalanceWH b FULL JOIN (SELECT warehouseId, companyId, invId, CAST(sum(rcvQty) AS BIGINT) AS q FROM a GROUP BY ALL) m
     ON m.warehouseId = b.warehouseId AND m.companyId = b.companyId AND m.invId = b.invId""")
_RC_PL = _RC_ACC + """, m AS (SELECT poDetailsId, sum(rcvQty) AS q, string_agg(DISTINCT notes, ', ' ORDER BY notes) AS notes FROM a GROUP BY 1),
pl AS (SELECT l.podetailsId, l.poId, CAST(l.rcvQty + coalesce(m.q, 0) AS INT) AS rcvQty, CASE WHEN m.q IS NOT NULL AND l.rcvQty + m.q = l.qty THEN 1087 ELSE l.itemStatus END AS itemStatus,
              CASE WHEN m.q IS NULL OR coalesce(m.notes, '') = '' THEN l.itemNote WHEN l.itemNote = '' THEN m.notes ELSE l.itemNote || ', ' || m.notes END AS itemNote
       FROM poLineItem l LEFT JOIN m ON m.poDetailsId = l.podetailsId)"""
register("receipt_load_po_lines", lambda t: _rc_docs(t).po_lines.select("podetailsId", "poId", "rcvQty", "itemStatus", "itemNote"), _RC_PL + " SELECT * FROM pl")
register("receipt_load_po_headers", lambda t: _rc_docs(t).po_headers.select("poId", "poStatus"), _RC_PL + """
SELECT h.poId, CASE WHEN h.poId IN (SELECT poId FROM a) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.poId = h.poId AND pl.itemStatus NOT IN (1086, 1087)) THEN 1087 ELSE h.poStatus END AS poStatus
FROM poHeader h""")

# --- movements
_MV_ROWS = f"""WITH r AS (SELECT s.*, w.warehouseId, m.categoryId AS actionId, i.invID AS invId FROM temp_inventoryMovementLog s
  LEFT JOIN md_Warehouse w ON {_eq('s.warehouseLabel', 'w.label')} AND w.companyId = s.companyId AND w.status = 1
  LEFT JOIN md_MasterCategory m ON m.categoryParentID = 2151 AND {_eq('s.action', 'm.categoryName')}
  LEFT JOIN md_Inventory i ON {_eq('s.inventorySku', 'i.inventorySKU')} AND i.companyId = s.companyId)"""
_MV_RULES = [(_blank("warehouseLabel"), "''"), (_blank("action"), "''"), (_blank("inventorySku"), "''"), ("qty IS NULL", "''"),
             (f"warehouseId IS NULL AND NOT {_blank('warehouseLabel')}", "warehouseLabel"), (f"actionId IS NULL AND NOT {_blank('action')}", "action"),
             (f"actionId IN (2152, 2153, 2155) AND (({_blank('shipId')}) OR ({_blank('orderNo')}))", "action"), (f"actionId = 2154 AND {_blank('reason')}", "action"),
             (f"invId IS NULL AND NOT {_blank('inventorySku')}", "inventorySku")]
_MV_COLS = """invMovementLog_Id, fileLoaded, warehouseId, companyId, upper(action) AS action, shipId, orderNo, invId, qty, reason, enterBy, CAST(enterDate AS VARCHAR) AS enterDate"""


def _check_mv(t):
    return B.check_movement_file(t)


_MV_ANY = _load("movement_load", _check_mv, _MV_ROWS, _MV_RULES, "fileLoaded", "invMovementLog_Id", _MV_COLS)
_MV_ACC = f"{_MV_ROWS}, a AS (SELECT {_MV_COLS} FROM r WHERE fileLoaded NOT IN (SELECT fileLoaded FROM r WHERE {_MV_ANY}))"
register("movement_load_balances", lambda t: B.movement_documents(t, _check_mv(t).accepted).balances, _MV_ACC + """,
m AS (SELECT warehouseId, companyId, invId, CAST(sum(CASE WHEN action = 'SHIP' THEN -qty ELSE qty END) AS BIGINT) AS q FROM a GROUP BY ALL)
SELECT coalesce(b.warehouseId, m.warehouseId) AS warehouseId, coalesce(b.companyId, m.companyId) AS companyId, coalesce(b.invId, m.invId) AS invId,
       coalesce(b.balanceQty, 0) + coalesce(m.q, 0) AS balanceQty, coalesce(b.lockQty, 0) AS lockQty
FROM inventoryBalanceWH b FULL JOIN m ON m.warehouseId = b.warehouseId AND m.companyId = b.companyId AND m.invId = b.invId""")
register("movement_load_shipped", lambda t: B.movement_documents(t, _check_mv(t).accepted).shipment_lines.select("shipmentLineItemId", "shipQty"), _MV_ACC + """,
m AS (SELECT h.shipmentId, a.invId, sum(CASE WHEN action = 'SHIP' THEN -qty ELSE qty END) AS q FROM a JOIN shipmentHeader h ON h.shipId = a.shipId AND h.soName = a.orderNo AND h.companyId = a.companyId
      WHERE a.shipId <> '' GROUP BY ALL)
SELECT l.shipmentLineItemId, CAST(l.shipQty + coalesce(m.q, 0) AS INT) AS shipQty FROM shipmentLineItem l LEFT JOIN m ON m.shipmentId = l.shipmentId AND m.invId = l.invId""")

# --- items
_IT_ROWS = f"""WITH r0 AS (
  SELECT s.*, c.prodCategoryId AS productCategoryId, d.prodCategoryId AS productSubCategoryId, d.prodCategoryCode AS subCode, d.isBuffer, y.inventoryTypeId AS productTypeId,
         y.namingConvention AS tmpl, u.categoryId AS measurementId, (SELECT min(invID) FROM md_Inventory i WHERE {_eq('i.itemCode', 's.itemCode')}) AS existing
  FROM temp_inventoryLog s LEFT JOIN md_InventoryCategory c ON {_eq('s.productCategory', 'c.prodCategoryName')} AND c.prodCategoryParentID = 1
  LEFT JOIN md_InventoryCategory d ON {_eq('s.productSubCategory', 'd.prodCategoryName')} AND d.prodCategoryParentID = c.prodCategoryId
  LEFT JOIN md_inventoryType y ON {_eq('s.productType', 'y.inventoryType')} AND y.prodCategoryId = d.prodCategoryId
  LEFT JOIN md_MasterCategory u ON u.categoryParentID = 1069 AND {_eq('s.measurement', 'u.categoryName')}),
r1 AS (SELECT r0.*, itemCode <> '' AND (SELECT count(*) FROM r0 x WHERE x.fileName = r0.fileName AND {_eq('x.itemCode', 'r0.itemCode')}) > 1 AS twice FROM r0)"""
_NUMS = lambda *cs: " OR ".join(f"(NOT {_blank(c)} AND try_cast({c} AS DECIMAL(18,4)) IS NULL)" for c in cs)
_BLANKS = lambda *cs: " OR ".join(f"({_blank(c)})" for c in cs)
_IT_RULES = [("twice", "itemCode"), (f"existing IS NOT NULL AND NOT {_blank('itemCode')}", "itemCode"), (_blank("productCategory"), "''"), (_blank("productSubCategory"), "''"),
             (_blank("modelNo"), "''"), (_blank("inventorySKU"), "''"), (f"({_BLANKS(*B.GROSS)})", "''"), (f"({_NUMS(*B.GROSS)})", "''"), (f"({_BLANKS(*B.NET)})", "''"),
             (f"({_NUMS(*B.NET)})", "''"), (_blank("cbm"), "''"), (f"({_NUMS('cbm')})", "''"), (_blank("measurement"), "''"),
             (f"productCategoryId IS NULL AND NOT {_blank('productCategory')}", "productCategory"), ("productCategoryId IS NOT NULL AND productSubCategoryId IS NULL", "productSubCategory"),
             ("productSubCategoryId IS NOT NULL AND productTypeId IS NULL", "productType"), (f"measurementId IS NULL AND NOT {_blank('measurement')}", "measurement")]
_IT_COLS = """logId, fileName, companyId, {code} AS itemCode, productCategoryId, productSubCategoryId, productTypeId, modelNo, inventorySKU, productName,
    CASE WHEN description = '' THEN productName ELSE {desc} END AS itemDesc, CAST(grossWeight AS INT) AS grossWeight, CAST(netWeight AS INT) AS netWeight, CAST(cbm AS INT) AS cbm,
    measurementId, CASE WHEN virtualProduct = 'Y' THEN 1 ELSE 0 END AS isVirtual, isBuffer, 1 AS status"""


def _check_item(t):
    return B.check_item_file(t)


_IT_ANY = _load("item_load", _check_item, _IT_ROWS + ", r AS (SELECT * FROM r1)", [(_blank("itemCode"), "''"), (_blank("productName"), "''"), *_IT_RULES], "fileName", "logId",
                _IT_COLS.format(code="itemCode", desc="description"))
register("item_load_attributes", lambda t: B.item_file_attributes(t, _check_item(t).accepted), f"""{_IT_ROWS}, r AS (SELECT * FROM r1),
a AS (SELECT * FROM r WHERE fileName NOT IN (SELECT fileName FROM r WHERE {_IT_ANY}))
SELECT itemCode, 3194 AS categoryId, color AS value FROM a WHERE color <> '' UNION ALL SELECT itemCode, 1123, packaging FROM a WHERE packaging <> ''
UNION ALL SELECT itemCode, 3187, size FROM a WHERE size <> ''""")

_PR_ROWS = f"""{_IT_ROWS},
r2 AS (SELECT r1.* EXCLUDE (productName), CASE WHEN upper(attributeName_2) NOT IN ('COLOR', 'PACKING', 'CUSTOMER') THEN upper(attributeName_2) END AS badAttribute,
              replace(replace(replace(regexp_replace(regexp_replace(tmpl, '\\[modelno\\]', upper(modelNo), 'gi'), '\\[color\\]', upper(attributeValue_1), 'gi'), '[space]', ' '), '[,]', ','), '+', '') AS pn0
       FROM r1),
r AS (SELECT r2.* EXCLUDE (pn0), regexp_replace(pn0, '\\[packing\\]', '[packing]', 'gi') AS productName,
             (SELECT min(invID) FROM md_Inventory i WHERE i.status = 1 AND i.companyId = r2.companyId AND {_eq('i.productName', 'pn0')}) AS same FROM r2)"""
_PR_RULES = [*_IT_RULES, (_blank("productType"), "''"), ("badAttribute IS NOT NULL", "badAttribute"), (f"productTypeId IS NOT NULL AND {_blank('tmpl')}", "productType"),
             (f"same IS NOT NULL AND NOT {_blank('productName')}", "productName")]
_PR_ANY = " OR ".join(f"coalesce({c}, false)" for c, _ in _PR_RULES)
register("product_load_errors", lambda t: B.check_product_file(t).errors.drop("rule"), _PR_ROWS + " " + " UNION ALL ".join(
    f"SELECT fileName, logId, {i} AS ruleNo, CAST({k} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(_PR_RULES, 1)))
register("product_load_accepted", lambda t: B.check_product_file(t).accepted, f"""{_PR_ROWS}, a AS (SELECT * FROM r WHERE fileName NOT IN (SELECT fileName FROM r WHERE {_PR_ANY})),
nums AS (SELECT subCode, num, row_number() OVER (PARTITION BY subCode ORDER BY num) AS freeNo FROM (SELECT DISTINCT subCode FROM a) p, range(1, 5000) g(num)
         WHERE subCode || '.' || lpad(CAST(num AS VARCHAR), 4, '0') NOT IN (SELECT itemCode FROM md_Inventory)),
b AS (SELECT a.*, row_number() OVER (PARTITION BY subCode ORDER BY logId) AS k FROM a WHERE itemCode = '')
SELECT {_IT_COLS.format(code="itemCode", desc="upper(description)")} FROM a WHERE itemCode <> ''
UNION ALL
SELECT {_IT_COLS.format(code="b.subCode || '.' || lpad(CAST(num AS VARCHAR), 4, '0')", desc="upper(description)")} FROM b JOIN nums ON nums.subCode = b.subCode AND freeNo = k""")

_BOM_ROWS = f"""WITH r AS (SELECT s.*, i.invID AS invId, i.companyId, j.invID AS rawBomInvId, try_cast(s.rawBomQty AS DECIMAL(18,4)) AS q, i.invID IN (SELECT invId FROM rawBom) AS has
  FROM temp_rawBomLog s LEFT JOIN md_Inventory i ON i.status = 1 AND {_eq('i.itemCode', 's.upc')} LEFT JOIN md_Inventory j ON j.status = 1 AND {_eq('j.itemCode', 's.rawBomUpc')})"""
_load("bom_load", lambda t: B.check_bom_file(t), _BOM_ROWS, [("q IS NULL", "rawBomQty"), ("has", "upc"), (f"invId IS NULL AND NOT {_blank('upc')}", "upc"),
      (f"rawBomInvId IS NULL AND NOT {_blank('rawBomUpc')}", "rawBomUpc")], "fileName", "rawBomLogId",
      "rawBomLogId, fileName, companyId, invId, rawBomInvId, CAST(q AS INT) AS rawBomQty, 1 AS status")

# --- SKUs
_DESC = f"CASE WHEN NOT {_blank('itemDesc')} THEN itemDesc WHEN {_blank('invDesc')} THEN invName ELSE invDesc END AS itemDesc"
_CS_ROWS = f"""WITH r0 AS (SELECT s.*, c.customerId, i.invID, i.itemDesc AS invDesc, i.productName AS invName, m.categoryId AS currency, k.customerskuId AS existing
  FROM temp_customerSkuLog s LEFT JOIN md_Customer c ON {_eq('s.customerName', 'c.customerName')} AND c.companyId = s.companyId
  LEFT JOIN md_Inventory i ON i.status = 1 AND {_eq('s.inventorySku', 'i.inventorySKU')} LEFT JOIN md_MasterCategory m ON m.categoryParentID = 1119 AND {_eq('s.currencyCode', 'm.categoryName')}
  LEFT JOIN md_CustomerSku k ON k.statusflag = 1 AND {_eq('s.customerSku', 'k.customerSku')} AND {_eq('s.merchantSku', 'k.merchantSKU')} AND k.customerId = c.customerId AND k.companyId = s.companyId),
n AS (SELECT fileLoaded, lower(customerSku) AS a, lower(merchantSku) AS b, count(*) AS n FROM r0 GROUP BY ALL),
r AS (SELECT r0.*, n.n > 1 AS twice FROM r0 JOIN n ON n.fileLoaded = r0.fileLoaded AND n.a = lower(customerSku) AND n.b = lower(merchantSku))"""
_load("customer_sku_load", lambda t: B.check_customer_sku_file(t), _CS_ROWS,
      [(f"({_BLANKS('customerName', 'inventorySku', 'customerSku', 'merchantSku', 'currencyCode')})", "''"), ("customerId IS NULL", "customerName"), ("invID IS NULL", "inventorySku"),
       ("twice", "customerSku || ' / ' || merchantSku"), ("existing IS NOT NULL", "customerSku || ' / ' || merchantSku"), ("currency IS NULL", "currencyCode")],
      "fileLoaded", "customerSkuLog", f"""customerSkuLog, fileLoaded, invID, customerId, companyId, customerSku, merchantSku, {_DESC}, currency AS currencyCode,
      CAST(customerCost AS INT) AS csCost, 1 AS statusflag""")
_SS_ROWS = f"""WITH r AS (SELECT s.*, v.supplierId, v.own, i.invID AS invId, i.itemDesc AS invDesc, i.productName AS invName, m.categoryId AS currency,
  EXISTS (SELECT 1 FROM md_SupplierSku k WHERE k.statusflag = 1 AND k.companyId = s.companyId AND k.supplierId = v.supplierId AND k.invId = i.invID) AS assigned,
  EXISTS (SELECT 1 FROM md_SupplierSku k WHERE k.statusflag = 1 AND k.companyId = s.companyId AND k.supplierId = v.supplierId AND {_eq('k.supplierSku', 's.supplierSku')}) AS existing
  FROM temp_supplierSkuLog s LEFT JOIN (SELECT x.*, c.categoryName AS own FROM md_Supplier x JOIN md_MasterCategory c ON c.categoryId = x.currencyCode AND c.categoryParentID = 1119 WHERE x.status = 1) v
       ON {_eq('s.supplierName', 'v.supplierCompanyName')} AND v.companyId = s.companyId
  LEFT JOIN md_Inventory i ON i.status = 1 AND {_eq('s.inventorySku', 'i.inventorySKU')} LEFT JOIN md_MasterCategory m ON m.categoryParentID = 1119 AND {_eq('s.currencyCode', 'm.categoryName')})"""
_load("supplier_sku_load", lambda t: B.check_supplier_sku_file(t), _SS_ROWS,
      [(f"({_BLANKS('supplierName', 'inventorySku', 'supplierSku', 'currencyCode', 'moq', 'isDefault')})", "''"), ("upper(isDefault) NOT IN ('YES', 'NO')", "isDefault"),
       ("supplierId IS NULL", "supplierName"), ("invId IS NULL", "inventorySku"), ("assigned", "inventorySku"), ("existing", "supplierSku"), ("currency IS NULL", "currencyCode"),
       ("currency IS NOT NULL AND lower(own) <> lower(currencyCode)", "currencyCode")],
      "fileLoaded", "supplierSkuLog", f"""supplierSkuLog, fileLoaded, invId, supplierId, companyId, supplierSku, {_DESC}, currency AS currencyCode, CAST(supplierCost AS INT) AS supCost,
      CAST(moq AS INT) AS moq, CASE WHEN upper(isDefault) = 'YES' THEN 1 ELSE 0 END AS isDefault, 1 AS statusflag""")

register("missing_balances", lambda t: B.missing_balances(t), """
SELECT i.companyId, w.warehouseId, i.invID AS invId, 0 AS balanceQty, 0 AS lockQty FROM md_Inventory i JOIN md_Warehouse w ON w.companyId = i.companyId
WHERE NOT EXISTS (SELECT 1 FROM inventoryBalanceWH b WHERE b.invId = i.invID AND b.warehouseId = w.warehouseId)""")
