"""Printed-report data sets over all documents."""

from ..plans import reports as R
from . import register

register("sales_order_report", lambda t: R.sales_order_report(t), """
SELECT l.soLineItemId, c.customerName AS customer, h.soName, h.customerPO, CAST(h.soDate AS VARCHAR) AS soDate, CAST(h.earlyShipDate AS VARCHAR) AS earlyShipDate,
       CAST(h.lateShipDate AS VARCHAR) AS lateShipDate, i.inventorySKU AS inventorySku, l.customerSku, l.odrQty, CAST(s.pod AS VARCHAR) AS pod,
       CASE WHEN x.isMarketing = 0 AND l.tagDivision > 0 THEN upper(d.categoryName) END AS division
FROM soHeader h JOIN soLineItem l ON l.soHeaderId = h.soHeaderId LEFT JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN md_Customer c ON c.customerId = h.customerId
LEFT JOIN md_ShipToDestination s ON s.shipToId = h.shipToId LEFT JOIN md_Inventory i ON i.invID = l.invID LEFT JOIN md_MasterCategory d ON d.categoryId = l.tagDivision
WHERE h.soStatus <> 1107 AND l.soLineItemStatus <> 1107""")


def _address(a1, a2, city, state, post, country, template):
    """DuckDB text of an address: explicit cases per country."""
    part = lambda sep, x: f"(CASE WHEN trim({x}) = '' THEN '' ELSE '{sep}' || trim(upper({x})) END)"
    ctry = f"(SELECT ', ' || upper(categoryName) FROM md_MasterCategory k WHERE k.categoryId = {country})"
    tails = {
        "3": part(", ", a2) + " || " + ctry + " || " + part(" ", post),
        "22": part(", ", a2) + " || " + part(", ", city) + " || " + part(", ", state) + " || " + part(" ", post) + " || " + ctry,
        "else": part(", ", a2) + " || " + part(", ", post) + " || " + part(" ", city) + " || " + part(", ", state) + " || " + ctry,
    }
    tail = f"CASE {country} WHEN 3 THEN {tails['3']} WHEN 22 THEN {tails['22']} ELSE {tails['else']} END || '.'"
    return f"upper({a1}) || ({tail})" if template == 1 else f"CASE WHEN ({tail}) LIKE ', %' THEN ({tail})[3:] ELSE ltrim({tail}) END"


_COMPANY_LINE = _address("x.address", "x.addressLine2", "x.city", "x.state", "x.postcode", "x.country", 1)
_COMPANY_PHONE = """(CASE WHEN x.telephoneNumber = '' THEN '' ELSE 'TEL : ' || x.telephoneNumber || ' ' END || CASE WHEN x.faxNumber = '' THEN '' ELSE 'FAX : ' || x.faxNumber END)"""
_CUSTOMER_LINE2 = _address("c.customerAddress", "c.customerAddressLine2", "c.customerCity", "c.customerStates", "c.customerPostcode", "c.customerCountry", 2)
_SUPPLIER_LINE2 = _address("s.supplierAddress", "s.supplierAddressLine2", "s.supplierCity", "s.supplierStates", "s.supplierPostcode", "s.supplierCountry", 2)


def _config(company, name):
    return f"""coalesce((SELECT min(configValue) FROM md_DefaultConfig k WHERE k.companyId = {company} AND k.companyId <> 0 AND k.configName = '{name}'),
                        (SELECT min(configValue) FROM md_DefaultConfig k WHERE k.companyId = 0 AND k.configName = '{name}'))"""


def _range(c):
    parts = f"list_transform(string_split({c}, ','), lambda v: trim(v))"
    return f"CASE WHEN len(list_distinct({parts})) = 1 THEN list_min({parts}) ELSE list_min({parts}) || ' - ' || list_max({parts}) END"


register("sales_order_print_header", lambda t: R.sales_order_print_header(t), f"""
SELECT h.soHeaderId, upper(x.companyName) AS companyName, {_COMPANY_LINE} AS companyAddr1, {_COMPANY_PHONE} AS companyPhone, h.soName, CAST(h.soDate AS VARCHAR) AS soDate,
       {_range('h.customerPO')} AS customerPO, upper(w.categoryName) AS shipWay, h.portOfLanding AS shipFrom, upper(d.shipToLabel) AS shipTo,
       CAST(CAST(h.earlyShipDate + to_days(CAST({_config('h.companyId', 'CargoReadyDate')} AS INT)) AS DATE) AS VARCHAR) AS cargoReadyDate,
       CAST(h.earlyShipDate AS VARCHAR) AS deliveryDate, CAST(h.lastUpdatedDate AS VARCHAR) AS lastUpdatedDate, upper(c.customerName) AS customerName,
       upper(c.customerAddress) AS customerAddr1, {_CUSTOMER_LINE2} AS customerAddr2, c.customerContactNumber AS contactNumber, p.categoryName AS paymentTerm,
       CASE WHEN h.soStatus IN (1105, 2144) THEN 1 ELSE 0 END AS isDraft, CASE WHEN h.lastUpdatedDate IS NULL THEN 0 ELSE 1 END AS isUpdate
FROM soHeader h JOIN md_Company x ON x.companyId = h.companyId JOIN md_Customer b ON b.customerId = h.customerId
JOIN md_Customer c ON c.customerId = CASE WHEN b.parent_customerId > 0 THEN b.parent_customerId ELSE b.customerId END
LEFT JOIN md_ShipToDestination d ON d.shipToId = h.shipToId LEFT JOIN md_MasterCategory w ON w.categoryId = h.shipWay
LEFT JOIN md_MasterCategory p ON p.categoryId = c.paymentTerm""")

register("sales_order_print_lines", lambda t: R.sales_order_print_lines(t, 0, 1, 1018), """
SELECT l.soLineItemId, l.soHeaderId, l.invID, l.customerSku, l.itemReference2 AS EAN, l.merchantSku, l.currencyCode, l.csCost, l.odrQty, l.soItemDesc,
       l.csCost * l.odrQty AS amount, a.value AS color, b.value AS packagingType, i.inventorySKU AS modelNo, i.itemCode, t.HTSCode, h.soNote AS soNotes,
       c.prodCategoryName AS prodSubCategory, row_number() OVER (PARTITION BY l.soHeaderId ORDER BY l.soLineItemId) AS rowNo
FROM soLineItem l JOIN soHeader h ON h.soHeaderId = l.soHeaderId LEFT JOIN md_Inventory i ON i.invID = l.invID
LEFT JOIN md_InventoryHTSCode t ON t.HTSCode_prodCategoryId = i.productCategory LEFT JOIN md_InventoryCategory c ON c.prodCategoryId = i.productCategory
LEFT JOIN inventory_attributes a ON a.invID = l.invID AND a.categoryId = 3194 LEFT JOIN inventory_attributes b ON b.invID = l.invID AND b.categoryId = 1123""")

register("sales_order_terms", lambda t: R.sales_order_terms(t, "SO"), """
SELECT h.soHeaderId, r.termRow, r.termText FROM soHeader h JOIN md_termNCondition r ON r.companyId = h.companyId AND r.module = 'SO' AND r.statusFlag = 1
 AND r.customerId = CASE WHEN EXISTS (SELECT 1 FROM md_termNCondition o WHERE o.companyId = h.companyId AND o.customerId = h.customerId AND o.customerId <> 0
                                      AND o.module = 'SO' AND o.statusFlag = 1) THEN h.customerId ELSE 0 END""")

register("sales_order_remarks", lambda t: R.sales_order_remarks(t, "SO"), """
SELECT soHeaderId, 1 AS displaySeq, 1 AS lineNum, '[A] ' || HTSCode AS remarksName, prodCategoryName AS remarks FROM (
    SELECT l.soHeaderId, t.HTSCode, c.prodCategoryName, row_number() OVER (PARTITION BY l.soHeaderId ORDER BY t.HTSCode, c.prodCategoryName) AS rn
    FROM soLineItem l JOIN md_Inventory i ON i.invID = l.invID JOIN md_InventoryHTSCode t ON t.HTSCode_prodCategoryId = i.productCategory
    LEFT JOIN md_InventoryCategory c ON c.prodCategoryId = i.productCategory) WHERE rn = 1
UNION ALL
SELECT h.soHeaderId, 2, r.lineNum, r.remarksName, r.remarks FROM soHeader h JOIN md_reportAdditionalRemarks r ON r.companyId = h.companyId AND r.module = 'SO' AND r.statusFlag = 1
 AND r.customerId = CASE WHEN EXISTS (SELECT 1 FROM md_reportAdditionalRemarks o WHERE o.companyId = h.companyId AND o.customerId = h.customerId AND o.customerId <> 0
                                      AND o.module = 'SO' AND o.statusFlag = 1) THEN h.customerId ELSE 0 END""")

register("customer_di_checklist", lambda t: R.customer_di_checklist(t, ship_dates=("1995-01-01", "2002-12-31")), """
WITH o AS (SELECT h.*, c.customerShortCode AS customer, upper(p.portName) AS destination,
                  CASE WHEN c.internal_branchId <> 0 AND k.soHeaderId IS NOT NULL THEN k.soHeaderId ELSE h.soHeaderId END AS ord
           FROM soHeader h JOIN md_Customer c ON c.customerId = h.customerId LEFT JOIN md_Port p ON p.portId = h.portOfDestination
           LEFT JOIN soHeader k ON k.soName = h.reference1
           WHERE h.earlyShipDate BETWEEN DATE '1995-01-01' AND DATE '2002-12-31'),
v AS (SELECT l.soHeaderId, b.forwarderBookingDate, b.forwarderBookingNo, b.ETD, b.ETA, count(DISTINCT b.containerSeq) AS volume
      FROM lrContainer b JOIN lrLineItem l ON l.lrHeaderId = b.lrHeaderId GROUP BY ALL)
SELECT o.soHeaderId, customer, customerPO, thirdPartyPO, CAST(earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(lateShipDate AS VARCHAR) AS lateShipDate,
       CAST(CAST(earlyShipDate - INTERVAL 2 DAY AS DATE) AS VARCHAR) AS bookingETD, destination, CAST(volume AS INT) AS volume, soName,
       CAST(forwarderBookingDate AS VARCHAR) AS forwarderBookingDate, forwarderBookingNo, CAST(ETD AS VARCHAR) AS ETD, CAST(ETA AS VARCHAR) AS ETA,
       reference1 AS customerSoName
FROM o LEFT JOIN v ON v.soHeaderId = o.ord""")

register("purchase_order_print_header", lambda t: R.purchase_order_print_header(t), f"""
SELECT h.poId, upper(x.companyName) AS companyName, {_COMPANY_LINE} AS companyAddress, x.telephoneNumber, x.faxNumber, upper(s.supplierCompanyName) AS supplierCompanyName,
       upper(s.supplierAddress) AS supplierAddress1, {_SUPPLIER_LINE2} AS supplierAddress2, p.categoryName AS paymentTerm, h.poName, CAST(h.poDate AS VARCHAR) AS poDate,
       h.poReferenceId AS soName, {_range('h.reference1')} AS customerPo, w.categoryName AS shipWay, h.portOfLanding AS shipFrom, coalesce(d.shipToLabel, '') AS shipTo,
       CAST(CAST(h.poEarlyShipDate + to_days(CAST({_config('h.companyId', 'CargoReadyDate')} AS INT)) AS DATE) AS VARCHAR) AS cargoReadyDate,
       CAST(h.poEarlyShipDate AS VARCHAR) AS delivery
FROM poHeader h LEFT JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId
LEFT JOIN md_ShipToDestination d ON d.shipToId = h.shipToId LEFT JOIN md_MasterCategory w ON w.categoryId = h.shipVia LEFT JOIN md_MasterCategory p ON p.categoryId = s.paymentTerm""")

register("purchase_order_print_lines", lambda t: R.purchase_order_print_lines(t), """
SELECT l.podetailsId, l.poId, l.supplierSku, l.poItemDesc, l.qty, l.unitPrice, h.poNote, m.categoryName AS currency, a.value AS color, b.value AS packaging,
       l.itemReference1 AS merchantSku, l.itemReference1 AS customerSku, row_number() OVER (PARTITION BY l.poId ORDER BY l.soLineItemId, l.podetailsId) AS itemNo
FROM poLineItem l JOIN poHeader h ON h.poId = l.poId LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId LEFT JOIN md_MasterCategory m ON m.categoryId = s.currencyCode
LEFT JOIN inventory_attributes a ON a.invID = l.invID AND a.categoryId = 3194 LEFT JOIN inventory_attributes b ON b.invID = l.invID AND b.categoryId = 1123""")

register("purchase_order_details", lambda t: R.purchase_order_details(t), """
SELECT h.poId, l.podetailsId, l.supplierSku, l.merchantSku, l.poItemDesc, l.qty, ms.categoryName AS itemStatus, k.EAN,
       row_number() OVER (PARTITION BY l.poId ORDER BY l.podetailsId) AS lineNum, coalesce(x.companyShortCode, s.supplierCompanyName) AS supplierName, h.poName,
       CAST(h.poDate AS VARCHAR) AS poDate, CAST(h.poEarlyShipDate AS VARCHAR) || ' - ' || CAST(h.poLateShipDate AS VARCHAR) AS shipWindow, h.customerCode,
       h.poReferenceId AS soName, h.reference1 AS customerPo, d.shipToName, h.portOfLanding AS POL, p.portName AS POD, hs.categoryName AS poStatus, h.poNote, c.companyName
FROM poHeader h JOIN poLineItem l ON l.poId = h.poId LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId LEFT JOIN md_Company x ON x.companyId = s.internal_branchId
LEFT JOIN md_Company c ON c.companyId = h.companyId LEFT JOIN md_ShipToDestination d ON d.shipToId = h.shipToId LEFT JOIN md_Port p ON p.portId = h.portOfDestination
LEFT JOIN md_MasterCategory hs ON hs.categoryId = h.poStatus LEFT JOIN md_MasterCategory ms ON ms.categoryId = l.itemStatus
LEFT JOIN soLineItem sl ON sl.soLineItemId = l.soLineItemId LEFT JOIN soHeader so ON so.soHeaderId = sl.soHeaderId
LEFT JOIN md_CustomerSku k ON k.customerId = so.customerId AND k.invID = sl.invID""")

register("supplier_terms", lambda t: R.supplier_terms(t, "PO"), """
SELECT h.poId, r.termRow, r.termCondition FROM poHeader h JOIN md_SupplierTerm r ON r.companyId = h.companyId AND r.supplierId = h.supplierId AND r.module = 'PO' AND r.statusFlag = 1""")

register("container_summary", lambda t: R.container_summary(t), """
WITH li AS (SELECT l.soHeaderId, CASE WHEN h.customerId = 0 THEN s.customerId ELSE h.customerId END AS customerId, b.lrContainerId, b.lateShipDate, m.categoryName AS containerType,
                   y.inventoryType, s.soDate, coalesce(p.poName, s.customerPO) AS customerPo, CASE WHEN x.isMarketing = 1 THEN s.customerPO ELSE s.thirdPartyPO END AS thirdPartyPo,
                   d.shipToLabel AS shipTo, date_trunc('month', b.lateShipDate)::DATE AS rptMonth, x.isMarketing
            FROM lrLineItem l JOIN lrHeader h ON h.lrHeaderId = l.lrHeaderId JOIN lrContainer b ON b.lrContainerId = l.lrContainerId
            LEFT JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN md_MasterCategory m ON m.categoryId = b.containerTypeId
            LEFT JOIN md_Inventory i ON i.invID = l.invID LEFT JOIN md_inventoryType y ON y.inventoryTypeId = i.productType
            LEFT JOIN soHeader s ON s.soHeaderId = l.soHeaderId LEFT JOIN poHeader p ON p.poReferenceId = s.soName
            LEFT JOIN md_ShipToDestination d ON d.shipToId = s.shipToId),
q AS (SELECT soHeaderId, count(DISTINCT lrContainerId) AS containerQty, string_agg(DISTINCT inventoryType, ', ' ORDER BY inventoryType) AS inventoryTypeList FROM li GROUP BY 1),
r AS (SELECT DISTINCT li.soHeaderId, customerId, soDate, lateShipDate, customerPo, thirdPartyPo, containerType, shipTo, rptMonth, isMarketing, containerQty, inventoryTypeList
      FROM li JOIN q ON q.soHeaderId = li.soHeaderId),
m1 AS (SELECT rptMonth, customerId, containerType, sum(containerQty) AS n FROM (SELECT DISTINCT rptMonth, customerId, soHeaderId, containerType, containerQty FROM r) GROUP BY ALL),
m2 AS (SELECT rptMonth, customerId, string_agg(CAST(n AS VARCHAR) || ' x ' || containerType, ' & ' ORDER BY containerType) AS totalContainer FROM m1 GROUP BY ALL)
SELECT CAST(r.rptMonth AS VARCHAR) AS rptMonth, r.soHeaderId, c.customerName AS customer, CAST(soDate AS VARCHAR) AS soDate, CAST(lateShipDate AS VARCHAR) AS lateShipDate, customerPo,
       thirdPartyPo, containerType, shipTo, isMarketing, containerQty, inventoryTypeList, totalContainer, upper(strftime(r.rptMonth, '%b %Y')) AS rptMonthName
FROM r JOIN m2 ON m2.rptMonth = r.rptMonth AND m2.customerId = r.customerId LEFT JOIN md_Customer c ON c.customerId = r.customerId""")

register("request_print_header", lambda t: R.request_print_header(t), f"""
SELECT h.lrHeaderId, h.lrName, CAST(h.lrDate AS VARCHAR) AS lrDate, upper(x.companyName) AS companyName, {_COMPANY_LINE} AS companyAddress, {_COMPANY_PHONE} AS companyPhone
FROM lrHeader h JOIN md_Company x ON x.companyId = h.companyId""")

register("request_print_lines", lambda t: R.request_print_lines(t, carton_customers=(12, 13, 14, 22)), """
WITH b AS (SELECT c.*, m.categoryName AS containerType, CASE WHEN containerNo = '' AND containerSealNo = '' THEN '' ELSE containerNo || ' | ' || containerSealNo END AS boxNo
           FROM lrContainer c JOIN md_MasterCategory m ON m.categoryId = c.containerTypeId WHERE containerStatus <> 2130),
li AS (SELECT b.lrHeaderId, b.lrContainerId, b.lrName, b.containerSeq, b.boxNo, b.containerType, b.containerTypeId, b.notes, b.earlyShipDate, b.lateShipDate, p.portName AS POD,
              s.portOfLanding AS POL, s.soName, s.customerPO, s.thirdPartyPO AS thirdPartyPo, d.shipToLabel, po.poName, sl.customerSku, sl.merchantSku, upper(sl.soItemDesc) AS soItemDesc,
              i.cbm, i.grossWeight, i.netWeight, l.supplierSku, l.qty, l.qtyPerCarton, x.isMarketing, h.customerId AS lrCustomer, s.customerId AS soCustomer
       FROM b JOIN lrLineItem l ON l.lrContainerId = b.lrContainerId AND l.itemStatus <> 2130 JOIN lrHeader h ON h.lrHeaderId = b.lrHeaderId
       LEFT JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN md_Port p ON p.portId = b.portId LEFT JOIN soHeader s ON s.soHeaderId = l.soHeaderId
       LEFT JOIN md_ShipToDestination d ON d.shipToId = s.shipToId LEFT JOIN poHeader po ON po.poId = l.poId LEFT JOIN soLineItem sl ON sl.soLineItemId = l.soLineItemId
       LEFT JOIN md_Inventory i ON i.invID = l.invID),
hb AS (SELECT lrContainerId, string_agg(DISTINCT soName, ', ' ORDER BY soName) AS headerSoName, string_agg(DISTINCT poName, ', ' ORDER BY poName) AS headerPoName,
              string_agg(DISTINCT customerPO, ', ' ORDER BY customerPO) AS headerCustomerPO, string_agg(DISTINCT thirdPartyPo, ', ' ORDER BY thirdPartyPo) AS headerThirdPartyPo
       FROM li GROUP BY 1),
hr AS (SELECT lrHeaderId, string_agg(DISTINCT soName, ', ' ORDER BY soName) AS summarySoName, string_agg(DISTINCT poName, ', ' ORDER BY poName) AS summaryPoName,
              string_agg(DISTINCT customerPO, ', ' ORDER BY customerPO) AS summaryCustomerPO, string_agg(DISTINCT thirdPartyPo, ', ' ORDER BY thirdPartyPo) AS summaryThirdPartyPo,
              min(soCustomer) AS anyCustomer FROM li GROUP BY 1),
tt AS (SELECT lrHeaderId, string_agg(CAST(n AS VARCHAR) || 'X' || containerType, ' & ' ORDER BY containerType) AS totalContainer
       FROM (SELECT lrHeaderId, containerType, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1),
bl AS (SELECT lrHeaderId, string_agg(DISTINCT boxNo, ', ' ORDER BY boxNo) FILTER (boxNo <> '') AS summaryContainerNo,
              string_agg(DISTINCT CAST(containerSeq AS VARCHAR), ', ' ORDER BY CAST(containerSeq AS VARCHAR)) AS summaryContainerSeq FROM b GROUP BY 1)
SELECT DISTINCT li.lrHeaderId, lrName, containerSeq, boxNo AS containerNo, headerCustomerPO, headerThirdPartyPo, headerSoName, headerPoName, totalContainer, notes,
       CAST(earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(lateShipDate AS VARCHAR) AS lateShipDate, POL, POD, shipToLabel, poName, customerPO, thirdPartyPo, supplierSku, soItemDesc,
       customerSku, merchantSku, qty, cbm, grossWeight, netWeight, containerType,
       CASE containerTypeId WHEN 3154 THEN 28 WHEN 3155 THEN 58 WHEN 3156 THEN 67 ELSE 0 END AS containerCbm,
       CASE containerTypeId WHEN 3154 THEN 21000 WHEN 3155 THEN 26000 WHEN 3156 THEN 26500 ELSE 0 END AS containerWeight, soName,
       CASE WHEN CASE WHEN isMarketing = 0 THEN lrCustomer ELSE anyCustomer END IN (12, 13, 14, 22) THEN qtyPerCarton END AS qtyPerCarton,
       CASE WHEN CASE WHEN isMarketing = 0 THEN lrCustomer ELSE anyCustomer END IN (12, 13, 14, 22) THEN 1 ELSE 0 END AS needCartonMaterial,
       summarySoName, summaryPoName, summaryCustomerPO, summaryThirdPartyPo, summaryContainerNo, summaryContainerSeq, isMarketing
FROM li JOIN hb ON hb.lrContainerId = li.lrContainerId JOIN hr ON hr.lrHeaderId = li.lrHeaderId LEFT JOIN tt ON tt.lrHeaderId = li.lrHeaderId LEFT JOIN bl ON bl.lrHeaderId = li.lrHeaderId""")


def _ship_header(key, do_expr, date_expr):
    return f"""
WITH d AS (SELECT *, CAST({key} AS VARCHAR) AS documentKey FROM shipmentHeader WHERE {key} IS NOT NULL AND CAST({key} AS VARCHAR) <> ''),
a AS (SELECT documentKey, CAST(sum(shipmentWeight) AS BIGINT) AS totalShipmentWeight, min(containerTypeId) AS typeId, min(bol) AS minBol, min(shipmentDate) AS minDate FROM d GROUP BY 1),
n AS (SELECT documentKey, m.categoryName AS ty, count(*) AS n FROM d JOIN md_MasterCategory m ON m.categoryId = d.containerTypeId GROUP BY ALL),
y AS (SELECT documentKey, string_agg(CAST(n AS VARCHAR) || ' x ' || ty, ' & ' ORDER BY ty) AS containerType FROM n GROUP BY 1)
SELECT DISTINCT d.documentKey, upper(x.companyName) AS companyName, k.accountNumber, {_COMPANY_LINE} AS companyAddress, upper(c.customerName) AS customerName,
       upper(c.customerAddress) AS customerAddress1, {_CUSTOMER_LINE2} AS customerAddress2, c.customerContactNumber, d.invoiceId, {do_expr} AS "DO", d.lrName AS "PL",
       CAST({date_expr} AS VARCHAR) AS shipmentDate, CAST(d.invoiceDate AS VARCHAR) AS invoiceDate, CAST(d.ETD AS VARCHAR) AS ETD, CAST(d.ETA AS VARCHAR) AS ETA,
       upper(d.pol) AS pol, upper(d.pod) AS pod, v.categoryName AS vessel, hl.haulier, p.categoryName AS paymentTerm, upper(d.countryOfOrigin) AS countryOfOrigin,
       {_config('d.companyId', 'DefaultCurrency')} AS defaultCurrency, y.containerType, a.totalShipmentWeight,
       CASE a.typeId WHEN 3154 THEN '28 m3' WHEN 3155 THEN '58 m3' WHEN 3156 THEN '67 m3' END AS containerCbm,
       CASE a.typeId WHEN 3154 THEN '21000 kg' WHEN 3155 THEN '26000 kg' WHEN 3156 THEN '26500 kg' END AS containerWeight,
       CASE a.typeId WHEN 3154 THEN '20 ft' WHEN 3155 THEN '40 ft' WHEN 3156 THEN '40 ft high' END AS dimension
FROM d JOIN a ON a.documentKey = d.documentKey LEFT JOIN y ON y.documentKey = d.documentKey JOIN md_Company x ON x.companyId = d.companyId
LEFT JOIN md_CompanyBank k ON k.companyId = x.companyId JOIN md_Customer c ON c.customerId = d.customerId LEFT JOIN md_MasterCategory p ON p.categoryId = d.paymentTermId
LEFT JOIN md_MasterCategory v ON v.categoryId = d.vesselId LEFT JOIN md_haulier hl ON hl.haulierId = d.haulierId"""


def _ship_lines(key, tail):
    return f"""
WITH d AS (SELECT shipmentId, CAST({key} AS VARCHAR) AS documentKey FROM shipmentHeader WHERE {key} IS NOT NULL AND CAST({key} AS VARCHAR) <> ''),
i AS (SELECT d.documentKey, l.invId, l.customerSku, upper(s.soItemDesc) AS soItemDesc, s.csCost, CAST(sum(l.shipQty) AS BIGINT) AS shipQty
      FROM d JOIN shipmentLineItem l ON l.shipmentId = d.shipmentId AND l.lineItemStatus <> 2150 JOIN soLineItem s ON s.soLineItemId = l.soLineItemId GROUP BY ALL),
f AS (SELECT i.*, m.categoryName AS measurement, v.cbm, y.inventoryType FROM i LEFT JOIN md_Inventory v ON v.invID = i.invId LEFT JOIN md_MasterCategory m ON m.categoryId = v.measurement
      LEFT JOIN md_inventoryType y ON y.inventoryTypeId = v.productType),
t AS (SELECT documentKey, CAST(sum(shipQty) AS BIGINT) AS ttlShipQty, min(measurement) AS measurement, CAST(sum(shipQty * cbm) AS BIGINT) AS totalShipmentCbm,
             CAST(sum(shipQty * csCost) AS BIGINT) AS invCost, CAST(0 AS BIGINT) AS invDiscount, CAST(0 AS BIGINT) AS invTax, CAST(sum(shipQty * csCost) AS BIGINT) AS invAmount
      FROM f GROUP BY 1)
{tail}"""


_ITEM_TAIL = """SELECT f.documentKey, f.invId, f.customerSku, f.soItemDesc, f.shipQty, f.csCost, 0 AS discount, 0 AS tax, f.shipQty * f.csCost AS ttlAmount,
       row_number() OVER (PARTITION BY f.documentKey ORDER BY f.customerSku, f.invId, f.soItemDesc, f.csCost) AS rowNo, t.* EXCLUDE (documentKey) FROM f JOIN t ON t.documentKey = f.documentKey"""
_TYPE_TAIL = """SELECT g.documentKey, g.inventoryType, row_number() OVER (PARTITION BY g.documentKey ORDER BY g.inventoryType) AS rowNo, t.* EXCLUDE (documentKey)
FROM (SELECT DISTINCT documentKey, inventoryType FROM f) g JOIN t ON t.documentKey = g.documentKey"""
register("delivery_order_header", lambda t: R.shipping_print_header(t, "DO"), _ship_header("bol", "d.bol", "d.shipmentDate"))
register("packing_list_header", lambda t: R.shipping_print_header(t, "CIPL"), _ship_header("lrHeaderId", "a.minBol", "a.minDate"))
register("commercial_invoice_header", lambda t: R.shipping_print_header(t, "CI"), _ship_header("invoiceId", "d.bol", "d.shipmentDate"))
register("delivery_order_lines", lambda t: R.shipping_print_lines(t, "DO"), _ship_lines("bol", _ITEM_TAIL))
register("packing_list_lines", lambda t: R.shipping_print_lines(t, "CIPL"), _ship_lines("lrHeaderId", _TYPE_TAIL))
register("commercial_invoice_lines", lambda t: R.shipping_print_lines(t, "CI"), _ship_lines("invoiceId", _ITEM_TAIL))

register("invoice_summary", lambda t: R.invoice_summary(t), """
SELECT h.shipmentId, c.customerName, h.shipId, h.invoiceId, h.customerPO || coalesce(h.customerInvoiceNo, '') AS csInvNPoNo, coalesce(h.customerInvoiceNo, '') AS customerInvoiceNo,
       CAST(h.invoiceDate AS VARCHAR) AS invoiceDate, h.customerPO, p.poName, h.pol, h.pod, CAST(h.ETA AS VARCHAR) AS ETA, CAST(h.ETD AS VARCHAR) AS ETD, 'FOB' AS tradeTerm,
       h.containerSeqNo, m.categoryName AS containerType, q.totalShipQty, 'PCS' AS "UOM", p.homeCurrencyCode AS currency, h.InvoiceAmount AS invoiceAmount, y.companyShortCode AS supplierName,
       CASE WHEN z.lrHeaderId IS NOT NULL THEN 'SUP-' || h.invoiceId END AS supplierInvoiceId, CASE WHEN z.lrHeaderId IS NOT NULL THEN CAST(h.invoiceDate AS VARCHAR) END AS supplierInvoiceDate,
       CASE WHEN z.lrHeaderId IS NOT NULL THEN q.totalShipQty END AS supplierTotalShipQty, CASE WHEN z.lrHeaderId IS NOT NULL THEN 'PCS' END AS supplierUOM,
       CASE WHEN z.lrHeaderId IS NOT NULL THEN p.foreignCurrencyCode END AS supplierCurrency, CASE WHEN z.lrHeaderId IS NOT NULL THEN h.InvoiceAmount END AS supplierInvoiceAmount
FROM shipmentHeader h LEFT JOIN md_Customer c ON c.customerId = h.customerId LEFT JOIN md_MasterCategory m ON m.categoryId = h.containerTypeId AND m.categoryParentID = 3153
LEFT JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN poHeader p ON p.poReferenceId = h.soName LEFT JOIN md_Supplier s ON s.supplierId = p.supplierId
LEFT JOIN md_Company y ON y.companyId = s.internal_branchId
JOIN (SELECT shipmentId, CAST(sum(shipQty) AS BIGINT) AS totalShipQty FROM shipmentLineItem GROUP BY 1) q ON q.shipmentId = h.shipmentId
LEFT JOIN lrHeader z ON z.ref_customerLrHeaderId = h.lrHeaderId AND x.isMarketing = 1""")

register("logistic_containers", lambda t: R.logistic_containers(t), """
WITH r AS (SELECT DISTINCT h.lrHeaderId, o.soName, h.forwarderBookingNo, h.containerSeqNo, h.pod AS destination, h.containerNo, h.containerSealNo, h.shipmentDate,
                  strftime(b.earlyShipDate, '%m/%d') || ' - ' || strftime(b.lateShipDate, '%m/%d') AS shippingWindow, h.containerPullOutDate, upper(hl.haulier) AS haulier,
                  m.categoryName AS containerType
           FROM shipmentHeader h JOIN lrContainer b ON b.lrHeaderId = h.lrHeaderId AND b.containerSeq = h.containerSeqNo JOIN lrLineItem l ON l.lrContainerId = b.lrContainerId
           JOIN soHeader o ON o.soHeaderId = l.soHeaderId LEFT JOIN md_haulier hl ON hl.haulierId = h.haulierId
           LEFT JOIN md_MasterCategory m ON m.categoryId = h.containerTypeId AND m.categoryParentID = 3153)
SELECT * REPLACE (CAST(shipmentDate AS VARCHAR) AS shipmentDate, CAST(containerPullOutDate AS VARCHAR) AS containerPullOutDate),
       row_number() OVER (PARTITION BY date_trunc('month', r.shipmentDate) ORDER BY r.shipmentDate, lrHeaderId, containerSeqNo, soName, forwarderBookingNo, destination, containerNo,
                          containerSealNo, r.containerPullOutDate NULLS FIRST, haulier NULLS FIRST, containerType) AS rowNo, strftime(r.shipmentDate, '%b-%y') AS monthName
FROM r""")

register("work_order_print", lambda t: R.work_order_print(t), f"""
WITH li AS (SELECT l.workOrderHeaderId, l.invId, l.confirmQty, l.soLineItemId, o.soName, o.customerPO AS customerPo, p.portName AS POD, o.thirdPartyPO AS thirdPartyPo, c.customerName
            FROM workOrderLineItem l JOIN soHeader o ON o.soHeaderId = l.soHeaderId LEFT JOIN md_Port p ON p.portId = o.portOfDestination
            LEFT JOIN md_Customer c ON c.customerId = o.customerId),
it AS (SELECT li.workOrderHeaderId, li.soName, li.customerPo, li.POD, li.thirdPartyPo, li.invId, s.customerSku, s.merchantSku, s.itemReference1 AS customerModelNo,
              s.itemReference2 AS EAN, s.soItemDesc AS itemDesc, CAST(sum(li.confirmQty) AS BIGINT) AS totalQty
       FROM li JOIN soLineItem s ON s.soLineItemId = li.soLineItemId GROUP BY ALL),
ip AS (SELECT it.*, v.inventorySKU AS modelNo, a.value AS color, dense_rank() OVER (PARTITION BY workOrderHeaderId ORDER BY v.inventorySKU) AS rowNo,
              CAST(sum(totalQty) OVER (PARTITION BY workOrderHeaderId, it.invId) AS BIGINT) AS sumQty
       FROM it LEFT JOIN md_Inventory v ON v.invID = it.invId LEFT JOIN inventory_attributes a ON a.invID = it.invId AND a.categoryId = 3194),
nt AS (SELECT poName, unnest(regexp_extract_all(poNote, '([0-9]+)\\s*x\\s*([0-9A-Za-z]+)', 1)) AS q, unnest(regexp_extract_all(poNote, '([0-9]+)\\s*x\\s*([0-9A-Za-z]+)', 2)) AS ty
       FROM poHeader WHERE poNote <> ''),
tq AS (SELECT workOrderHeaderId, ty, sum(CAST(q AS BIGINT)) AS q FROM (SELECT DISTINCT workOrderHeaderId, customerPo FROM it) z JOIN nt ON nt.poName = z.customerPo
       WHERE ty IN (SELECT replace(categoryName, ' ', '') FROM md_MasterCategory WHERE categoryParentID = 3153) GROUP BY ALL),
tc AS (SELECT workOrderHeaderId, string_agg(CAST(q AS VARCHAR) || ' x ' || ty[1:2] || '''' || ty[3:], ' & ' ORDER BY ty) AS totalContainer FROM tq GROUP BY 1),
sq AS (SELECT workOrderHeaderId, CAST(sum(totalQty) AS BIGINT) AS sumQty FROM it GROUP BY 1)
SELECT DISTINCT 'OH' AS recordType, h.workOrderHeaderId, upper(x.companyName) AS companyName, {_COMPANY_LINE} AS companyAddress, {_COMPANY_PHONE} AS companyPhone, h.workOrderName,
       CASE WHEN w.locNo = '' THEN w.label ELSE w.locNo END AS warehouse, li.customerName AS headerCustomerName, h.thirdParty AS headerThirdParty,
       CAST(h.workOrderDate AS VARCHAR) AS workOrderDate, CAST(CAST(h.shipDate - INTERVAL 8 DAY AS DATE) AS VARCHAR) AS earlyShipDate,
       CAST(h.targetCompleteDate AS VARCHAR) AS targetCompleteDate, CAST(h.shipDate AS VARCHAR) AS shipDate, sq.sumQty, tc.totalContainer, h.revision, NULL AS rowNo, NULL AS modelNo,
       NULL AS EAN, NULL AS merchantSku, NULL AS customerModelNo, NULL AS itemDesc, NULL AS color, NULL AS soName, NULL AS customerPo, NULL AS POD, NULL AS thirdPartyPo, NULL AS totalQty
FROM workOrderHeader h JOIN md_Company x ON x.companyId = h.companyId LEFT JOIN md_Warehouse w ON w.warehouseId = h.warehouseId JOIN li ON li.workOrderHeaderId = h.workOrderHeaderId
LEFT JOIN sq ON sq.workOrderHeaderId = h.workOrderHeaderId LEFT JOIN tc ON tc.workOrderHeaderId = h.workOrderHeaderId
UNION ALL
SELECT 'OL', ip.workOrderHeaderId, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sumQty, coalesce(tc.totalContainer, ''), NULL, rowNo, modelNo, EAN, merchantSku,
       customerModelNo, itemDesc, color, soName, customerPo, POD, thirdPartyPo, totalQty
FROM ip LEFT JOIN tc ON tc.workOrderHeaderId = ip.workOrderHeaderId""")

register("work_order_report", lambda t: R.work_order_report(t, statuses=[5230, 5231]), """
SELECT l.workOrderLineItemId, h.workOrderName, CAST(h.workOrderDate AS VARCHAR) AS workOrderDate, CAST(CAST(h.shipDate - INTERVAL 8 DAY AS DATE) AS VARCHAR) AS cargoReadyDate,
       CAST(h.shipDate AS VARCHAR) AS deliveryDate, CAST(h.targetCompleteDate AS VARCHAR) AS targetCompleteDate, c.customerName, CASE WHEN w.locNo = '' THEN w.label ELSE w.locNo END AS warehouse,
       m.categoryName AS workOrderStatus, l.soName, o.customerPO AS customerPo, p.portName AS POD, o.thirdPartyPO AS thirdPartyPo, i.inventorySKU AS modelNo, s.customerSku,
       s.itemReference2 AS EAN, s.itemReference1 AS customerModelNo, s.merchantSku, s.soItemDesc AS itemDesc, a.value AS color, b.value AS packaging, l.confirmQty,
       ms.categoryName AS workOrderItemStatus
FROM workOrderHeader h JOIN workOrderLineItem l ON l.workOrderHeaderId = h.workOrderHeaderId JOIN soLineItem s ON s.soLineItemId = l.soLineItemId
LEFT JOIN md_Customer c ON c.customerId = h.customerId LEFT JOIN md_MasterCategory m ON m.categoryId = h.workOrderStatus LEFT JOIN md_Warehouse w ON w.warehouseId = h.warehouseId
LEFT JOIN md_Inventory i ON i.invID = l.invId LEFT JOIN soHeader o ON o.soHeaderId = l.soHeaderId LEFT JOIN md_Port p ON p.portId = o.portOfDestination
LEFT JOIN inventory_attributes a ON a.invID = l.invId AND a.categoryId = 3194 LEFT JOIN poLineItem q ON q.podetailsId = s.ref_poLineItemId
LEFT JOIN inventory_attributes b ON b.invID = q.invID AND b.categoryId = 1123 LEFT JOIN md_MasterCategory ms ON ms.categoryId = l.workOrderItemStatus
WHERE h.workOrderStatus IN (5230, 5231)""")
