"""Listings over all companies; a page is the feature, the candidates are the whole tables."""

from ..plans import listings as L
from . import register

_BELL = """EXISTS (SELECT 1 FROM actionNotification a JOIN notificationRecipient n ON a.actionNotificationID = n.notificationID
    WHERE a.sourceModule = '{module}' AND n.userID = 1 AND n.isRead = 0 AND a.corporateId = p.companyId AND a.sourceRecordId = p.{key})"""

_SO = """WITH r AS (
    SELECT h.soHeaderId, h.companyId, c.customerName, h.soName, h.customerPO, h.soDate, h.earlyShipDate AS shipDate, s.shipToLabel,
           h.soStatus AS soStatusId, m.categoryName AS soStatus
    FROM soHeader h JOIN md_ShipToDestination s ON h.shipToId = s.shipToId JOIN md_Customer c ON h.customerId = c.customerId
    JOIN md_MasterCategory m ON h.soStatus = m.categoryId {where}),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, soHeaderId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT soHeaderId, customerName, soName, customerPO, CAST(soDate AS VARCHAR) AS soDate, CAST(shipDate AS VARCHAR) AS shipDate, shipToLabel,
       soStatusId, soStatus, rowNo, totalRecord, CASE WHEN """ + _BELL.format(module="SalesOrder", key="soHeaderId") + """ THEN 1 ELSE 0 END AS isBellAlert
FROM p WHERE rowNo BETWEEN {low} AND {high}"""

register("sales_order_listing", lambda t: L.sales_order_listing(t, user_id=1, sort_by=3, direction="DESC", page_rows=500),
         _SO.format(where="", order="soDate DESC", low=1, high=500))
register("sales_order_listing_search",
         lambda t: L.sales_order_listing(t, search=" po12 ", user_id=1, sort_by=4, direction="ASC", row_start=101, page_rows=100),
         _SO.format(where="WHERE contains(lower(h.customerPO), 'po12') OR contains(lower(h.soName), 'po12')", order="lower(customerName)",
                    low=101, high=200))
register("sales_order_listing_filtered",
         lambda t: L.sales_order_listing(t, status=1106, order_dates=("1996-01-01", "1998-12-31"), port=3, user_id=1, sort_by=7, page_rows=200),
         _SO.format(where="WHERE h.soStatus = 1106 AND h.soDate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND s.pod = 3",
                    order="lower(soStatus) DESC", low=1, high=200))

register("work_order_queue_listing", lambda t: L.work_order_queue_listing(t, sort_by=5, direction="ASC", page_rows=500), """
WITH r AS (
    SELECT l.soLineItemId, h.locNo, h.soName, h.thirdParty, h.customerPO, h.earlyShipDate AS shipDate, p.portName, i.inventorySKU AS inventorySku,
           l.odrQty, l.processQty, l.odrQty - l.processQty AS pendingProcessQty, m.categoryName AS soStatus
    FROM soLineItem l JOIN soHeader h ON l.soHeaderId = h.soHeaderId JOIN md_Port p ON h.portOfDestination = p.portId
    JOIN md_MasterCategory m ON h.soStatus = m.categoryId JOIN md_Inventory i ON l.invID = i.invID
    WHERE l.odrQty > l.processQty AND l.soLineItemStatus NOT IN (1107, 1108) AND h.locNo <> '' AND h.soStatus <> 1105),
p AS (SELECT *, row_number() OVER (ORDER BY shipDate, soLineItemId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(shipDate AS VARCHAR) AS shipDate) FROM p WHERE rowNo <= 500""")

register("packing_list", lambda t: L.packing_list(t, sort_by=5, direction="ASC", page_rows=500), """
WITH r AS (
    SELECT l.soLineItemId, h.companyId, l.invID, c.customerName, h.soName, q.lrName, h.customerPO, h.soDate, h.earlyShipDate, h.lateShipDate, s.shipToLabel,
           i.inventorySKU AS inventorySku, l.odrQty - l.shpQty AS openQty, q.loadingQty, q.lrDetailsId
    FROM soLineItem l JOIN soHeader h ON l.soHeaderId = h.soHeaderId AND h.soStatus NOT IN (1107, 1108)
    JOIN md_ShipToDestination s ON h.shipToId = s.shipToId JOIN md_Customer c ON h.customerId = c.customerId
    LEFT JOIN md_Inventory i ON l.invID = i.invID
    LEFT JOIN (SELECT x.lrDetailsId, x.soLineItemId, y.lrName, x.qty - x.processQty AS loadingQty
               FROM lrLineItem x JOIN lrHeader y ON x.lrHeaderId = y.lrHeaderId) q ON q.soLineItemId = l.soLineItemId
    WHERE l.soLineItemStatus NOT IN (1107, 1108) AND l.odrQty - l.shpQty > 0),
p AS (SELECT *, row_number() OVER (ORDER BY earlyShipDate, soLineItemId, lrDetailsId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT soLineItemId, customerName, soName, lrName, customerPO, CAST(soDate AS VARCHAR) AS soDate, CAST(earlyShipDate AS VARCHAR) AS earlyShipDate,
       CAST(lateShipDate AS VARCHAR) AS lateShipDate, shipToLabel, inventorySku, openQty, loadingQty,
       CAST(coalesce((SELECT sum(balanceQty) FROM inventoryBalanceWH b WHERE b.companyId = p.companyId AND b.invId = p.invID), 0) AS BIGINT) AS warehouseQty,
       rowNo, totalRecord
FROM p WHERE rowNo <= 500""")

register("open_sales_orders", lambda t: L.open_sales_orders(t), """
SELECT h.soHeaderId, h.customerId, h.soName, CAST(h.soDate AS VARCHAR) AS soDate, h.customerPO, CAST(h.earlyShipDate AS VARCHAR) AS earlyShipDate,
       CAST(h.lateShipDate AS VARCHAR) AS lateShipDate, m.categoryName AS soStatus
FROM soHeader h JOIN md_MasterCategory m ON h.soStatus = m.categoryId WHERE h.soStatus NOT IN (1107, 1108)""")

_PO = """WITH q AS (SELECT poId, CAST(sum(qty) AS BIGINT) AS totalQty, CAST(sum(rcvQty) AS BIGINT) AS totalReceived
                    FROM poLineItem WHERE itemStatus <> 1086 GROUP BY poId),
r AS (SELECT h.poId, h.poReferenceId, h.poName, s.internal_branchId, coalesce(c.companyShortCode, s.supplierCompanyName) AS supplierCompanyName,
             h.customerCode, h.poDate, h.poEarlyShipDate AS shipDate, h.poGrossTotal, h.poStatus, m.categoryName AS poStatusName, q.totalQty, q.totalReceived
      FROM poHeader h LEFT JOIN md_Supplier s ON h.supplierId = s.supplierId LEFT JOIN md_Company c ON s.internal_branchId = c.companyId
      LEFT JOIN md_MasterCategory m ON h.poStatus = m.categoryId LEFT JOIN q ON q.poId = h.poId {where}),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, poId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(poDate AS VARCHAR) AS poDate, CAST(shipDate AS VARCHAR) AS shipDate) FROM p WHERE rowNo <= 500"""
register("purchase_order_listing", lambda t: L.purchase_order_listing(t, sort_by=8, page_rows=500), _PO.format(where="", order="poGrossTotal DESC"))
register("purchase_order_listing_by_quantity", lambda t: L.purchase_order_listing(t, sort_by=6, direction="DESC", page_rows=500),
         _PO.format(where="", order="totalQty DESC NULLS LAST"))
register("purchase_order_listing_search", lambda t: L.purchase_order_listing(t, search="PO77", sort_by=4, direction="ASC", page_rows=500),
         _PO.format(order="lower(supplierCompanyName)", where="""WHERE contains(lower(h.poName), 'po77') OR contains(lower(h.poReferenceId), 'po77')
         OR h.poReferenceId IN (SELECT soName FROM soHeader WHERE contains(lower(customerPO), 'po77'))"""))

_LR = """WITH b AS (SELECT companyId, invId, sum(balanceQty) AS qty FROM inventoryBalanceWH GROUP BY companyId, invId),
li AS (SELECT h.lrHeaderId, c.lrName, c.forwarderBookingNo AS bookingNo, c.earlyShipDate, c.lateShipDate, ct.categoryName AS containerType, c.containerSeq,
              h.lrStatus, m.categoryName AS status, l.itemStatus, s.soName, s.customerPO, l.supplierSku, l.qty, coalesce(b.qty, 0) AS stock,
              cu.customerShortCode || CASE WHEN s.thirdParty = '' THEN '' ELSE ' /' || s.thirdParty END AS customerName
       FROM lrHeader h JOIN md_MasterCategory m ON h.lrStatus = m.categoryId
       JOIN lrContainer c ON c.lrHeaderId = h.lrHeaderId AND c.containerStatus <> 2130
       JOIN md_MasterCategory ct ON c.containerTypeId = ct.categoryId
       JOIN lrLineItem l ON l.lrContainerId = c.lrContainerId LEFT JOIN soHeader s ON l.soHeaderId = s.soHeaderId
       LEFT JOIN md_Customer cu ON s.customerId = cu.customerId LEFT JOIN b ON b.companyId = h.companyId AND b.invId = l.invID {where}),
names AS (SELECT lrHeaderId, string_agg(DISTINCT soName, ',' ORDER BY soName) AS soName, string_agg(DISTINCT customerPO, ',' ORDER BY customerPO) AS customerPO
          FROM li GROUP BY lrHeaderId),
r AS (SELECT lrHeaderId, lrName, bookingNo, customerName, earlyShipDate, lateShipDate, containerType, containerSeq, lrStatus, status, itemStatus,
             count(DISTINCT supplierSku) AS uniqueSku, CAST(sum(qty) AS BIGINT) AS totalLrQty, CAST(sum(stock) AS BIGINT) AS invBalance
      FROM li GROUP BY ALL),
p AS (SELECT r.*, names.soName, names.customerPO, row_number() OVER (ORDER BY {order}, r.lrHeaderId, containerSeq, customerName, itemStatus) AS rowNo,
             count(*) OVER () AS totalRecord FROM r JOIN names ON r.lrHeaderId = names.lrHeaderId)
SELECT * REPLACE (CAST(earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(lateShipDate AS VARCHAR) AS lateShipDate) FROM p WHERE rowNo <= 300"""
register("loading_request_listing", lambda t: L.loading_request_listing(t, sort_by=10, page_rows=300), _LR.format(where="", order="totalLrQty DESC"))
register("loading_request_listing_search",
         lambda t: L.loading_request_listing(t, search="fb12", ship_dates=("1997-01-01", "1997-12-31"), sort_by=4, direction="ASC", page_rows=300),
         _LR.format(order="lower(soName)", where="""
         WHERE c.earlyShipDate >= DATE '1996-01-01' AND c.lateShipDate <= DATE '1998-12-31' AND h.lrHeaderId IN (
             SELECT lrHeaderId FROM lrContainer WHERE contains(lower(forwarderBookingNo), 'fb12')
             UNION SELECT lrHeaderId FROM lrHeader WHERE contains(lower(lrName), 'fb12')
             UNION SELECT x.lrHeaderId FROM lrLineItem x JOIN soHeader y ON x.soHeaderId = y.soHeaderId
                   WHERE contains(lower(y.soName), 'fb12') OR contains(lower(y.thirdPartyPO), 'fb12')
             UNION SELECT x.lrHeaderId FROM lrLineItem x JOIN poHeader y ON x.poId = y.poId WHERE contains(lower(y.poName), 'fb12'))"""))

register("loading_pending_listing", lambda t: L.loading_pending_listing(t, ship_dates=("1995-01-01", "2001-12-31"), page_rows=500), """
WITH r AS (SELECT l.podetailsId, h.poName, h.poLateShipDate AS lateShipDate, p.portName AS destination, s.customerPO, l.supplierSku, l.qty - l.lrQty AS openLrQty, l.invID
    FROM poLineItem l JOIN poHeader h ON l.poId = h.poId JOIN soHeader s ON h.poReferenceId = s.soName
    JOIN md_ShipToDestination d ON h.shipToId = d.shipToId JOIN md_Port p ON d.pod = p.portId
    WHERE h.poStatus = 1077 AND l.itemStatus = 1077 AND l.qty > l.lrQty AND h.poEarlyShipDate >= DATE '1995-01-01' AND s.lateShipDate <= DATE '2001-12-31'),
p AS (SELECT *, row_number() OVER (ORDER BY podetailsId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(lateShipDate AS VARCHAR) AS lateShipDate) FROM p WHERE rowNo <= 500""")

register("booking_pending_listing", lambda t: L.booking_pending_listing(t, page_rows=500), """
WITH f AS (SELECT lrContainerId, min(poId) AS poId FROM lrLineItem GROUP BY lrContainerId),
r AS (SELECT c.lrHeaderId, c.lrName, p.customerCode AS customerName, c.earlyShipDate, ct.categoryName AS containerType, c.forwarderId, c.forwarderBookingNo,
             c.forwarderBookingDate, c.ETD, c.ETA, m.categoryName AS status, count(c.containerSeq) AS containerCount
      FROM lrContainer c JOIN lrHeader h ON c.lrHeaderId = h.lrHeaderId LEFT JOIN md_MasterCategory m ON h.lrStatus = m.categoryId
      LEFT JOIN md_MasterCategory ct ON c.containerTypeId = ct.categoryId LEFT JOIN f ON f.lrContainerId = c.lrContainerId LEFT JOIN poHeader p ON p.poId = f.poId
      WHERE h.lrStatus NOT IN (2130, 2131) AND c.containerStatus NOT IN (2130, 2131) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY earlyShipDate NULLS FIRST, lrHeaderId, lrName NULLS FIRST, customerName NULLS FIRST, containerType NULLS FIRST, forwarderId NULLS FIRST, forwarderBookingNo NULLS FIRST,
       forwarderBookingDate NULLS FIRST, ETD NULLS FIRST, ETA NULLS FIRST, status NULLS FIRST) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(forwarderBookingDate AS VARCHAR) AS forwarderBookingDate, CAST(ETD AS VARCHAR) AS ETD,
                  CAST(ETA AS VARCHAR) AS ETA) FROM p WHERE rowNo <= 500""")

_SHIP = """WITH r AS (SELECT h.shipmentId, h.lrHeaderId, h.invoiceId, c.customerShortCode AS customerName, h.lrName, h.bol AS PL, h.shipId, h.shipmentDate, h.soName,
        h.customerPO, m.categoryName AS shipStatus, h.pol, h.pod, ct.categoryName AS containerType, h.containerNo, h.ETD, h.shipmentWeight,
        h.bolTotalShipmentWeight, h.apiStatus
    FROM shipmentHeader h JOIN md_Customer c ON h.customerId = c.customerId LEFT JOIN md_MasterCategory m ON h.shipmentStatus = m.categoryId
    LEFT JOIN md_MasterCategory ct ON h.containerTypeId = ct.categoryId {where}),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, shipmentId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(shipmentDate AS VARCHAR) AS shipmentDate, CAST(ETD AS VARCHAR) AS ETD) FROM p WHERE rowNo <= 500"""
register("shipment_listing", lambda t: L.shipment_listing(t, sort_by=11, page_rows=500), _SHIP.format(where="", order="ETD DESC"))
register("shipment_listing_search", lambda t: L.shipment_listing(t, search="inv-12", sort_by=10, direction="ASC", page_rows=500),
         _SHIP.format(where="WHERE contains(lower(h.lrName), 'inv-12') OR contains(lower(h.invoiceId), 'inv-12') OR contains(lower(h.soName), 'inv-12')",
                      order="lower(containerNo)"))
register("shipment_document_listing", lambda t: L.shipment_document_listing(t, sort_by=7, direction="ASC", page_rows=500),
         _SHIP.format(where="WHERE h.apiStatus <> '_INV_'", order="lower(customerPO)"))

_WO = """WITH q AS (SELECT workOrderHeaderId, count(DISTINCT invId) AS uniqueSkuCount, CAST(sum(confirmQty) AS BIGINT) AS totalQty,
                           string_agg(DISTINCT soName, ';' || chr(13) || chr(10) ORDER BY soName) AS soName FROM workOrderLineItem GROUP BY 1),
r AS (SELECT h.workOrderHeaderId, h.companyId, h.workOrderName, h.revision, c.customerShortCode || CASE WHEN h.thirdParty = '' THEN '' ELSE ' /' || h.thirdParty END AS customerName,
             h.workOrderDate, w.label AS warehouse, h.targetCompleteDate, h.shipDate, m.categoryName AS workOrderStatus
      FROM workOrderHeader h LEFT JOIN md_Warehouse w ON h.warehouseId = w.warehouseId LEFT JOIN md_MasterCategory m ON h.workOrderStatus = m.categoryId
      LEFT JOIN md_Customer c ON h.customerId = c.customerId {where}),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, workOrderHeaderId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT p.workOrderHeaderId, workOrderName, revision, customerName, CAST(workOrderDate AS VARCHAR) AS workOrderDate, warehouse,
       CAST(targetCompleteDate AS VARCHAR) AS targetCompleteDate, CAST(shipDate AS VARCHAR) AS shipDate, workOrderStatus, rowNo, totalRecord,
       coalesce(uniqueSkuCount, 0) AS uniqueSkuCount, coalesce(totalQty, 0) AS totalQty, coalesce(soName, '') AS soName,
       CASE WHEN """ + _BELL.format(module="WorkOrder", key="workOrderHeaderId") + """ THEN 1 ELSE 0 END AS isBellAlert
FROM p LEFT JOIN q ON q.workOrderHeaderId = p.workOrderHeaderId WHERE rowNo <= 300"""
register("work_order_listing", lambda t: L.work_order_listing(t, user_id=1, sort_by=6, page_rows=300), _WO.format(where="", order="targetCompleteDate DESC"))
register("work_order_listing_search", lambda t: L.work_order_listing(t, search="M27", user_id=1, sort_by=5, direction="ASC", page_rows=300),
         _WO.format(order="lower(warehouse)", where="""WHERE contains(lower(h.workOrderName), 'm27') OR h.workOrderHeaderId IN (
             SELECT l.workOrderHeaderId FROM workOrderLineItem l JOIN md_Inventory i ON l.invId = i.invID WHERE contains(lower(i.modelNo), 'm27')
             UNION SELECT workOrderHeaderId FROM workOrderLineItem WHERE contains(lower(soName), 'm27'))"""))

register("movement_listing", lambda t: L.movement_listing(t, dates=("2024-01-05", "2024-01-25"), sort_by=1, page_rows=500), """
WITH r AS (SELECT x.inventoryMovementId, x.enterDate, u.userName, x.action, x.actionKey, x.reason, w.label AS warehouseLabel, i.inventorySKU AS inventorySku, x.qty
    FROM inventoryMovement x LEFT JOIN md_User u ON x.enterBy = u.userId LEFT JOIN md_Warehouse w ON x.warehouseId = w.warehouseId
    LEFT JOIN md_Inventory i ON x.invId = i.invID WHERE CAST(x.enterDate AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
p AS (SELECT *, row_number() OVER (ORDER BY enterDate DESC, inventoryMovementId) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT * REPLACE (CAST(enterDate AS VARCHAR) AS enterDate) FROM p WHERE rowNo <= 500""")

_ITEM = """WITH r AS (SELECT i.invID, i.itemCode, pc.prodCategoryName AS prodCategory, sc.prodCategoryName AS prodSubCategory, ty.inventoryType AS prodType, i.modelNo,
        i.inventorySKU, i.productName, i.itemDesc, CASE WHEN i.status = 1 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status {extra}
    FROM md_Inventory i LEFT JOIN md_InventoryCategory pc ON pc.prodCategoryId = i.productCategory AND pc.prodCategoryParentID = 1
    LEFT JOIN md_InventoryCategory sc ON sc.prodCategoryId = i.productSubCategory AND sc.prodCategoryParentID = i.productCategory
    LEFT JOIN md_inventoryType ty ON ty.inventoryTypeId = i.productType AND ty.prodCategoryId = i.productSubCategory
    WHERE i.invID IN (
        SELECT invID FROM md_Inventory WHERE contains(lower(concat_ws('~', itemCode, modelNo, inventorySKU, productName, itemDesc)), '{term}')
        UNION SELECT x.invID FROM md_Inventory x JOIN md_InventoryCategory c ON c.prodCategoryId = x.productCategory WHERE contains(lower(c.prodCategoryName), '{term}')
        UNION SELECT x.invID FROM md_Inventory x JOIN md_InventoryCategory c ON c.prodCategoryId = x.productSubCategory WHERE contains(lower(c.prodCategoryName), '{term}')
        UNION SELECT x.invID FROM md_Inventory x JOIN md_inventoryType c ON c.inventoryTypeId = x.productType WHERE contains(lower(c.inventoryType), '{term}'))),
p AS (SELECT *, row_number() OVER (ORDER BY {order}, invID) AS rowNo, count(*) OVER () AS totalRecord FROM r)
SELECT {cols} FROM p WHERE rowNo BETWEEN {low} AND {high}"""
register("item_search", lambda t: L.item_search(t, "Brand#2", sort_by=7, direction="ASC", row_start=51, page_rows=200),
         _ITEM.format(extra="", term="brand#2", order="lower(productName)", cols="* EXCLUDE (totalRecord)", low=51, high=250))
register("item_catalog", lambda t: L.item_catalog(t, "large", sort_by=2, page_rows=300),
         _ITEM.format(extra=", i.thumbnailImage", term="large", order="lower(prodCategory) DESC", cols="*", low=1, high=300))
