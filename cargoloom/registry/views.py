"""Enriched views over all rows."""

from ..functions.permission import user_permission
from ..plans import views as V
from . import register

register("user_permission", lambda t: user_permission(t), """
SELECT u.userId, c.companyId, f.menuLevel2Id, r.roleName, f.functionAdd, f.functionEdit, f.functionDelete
FROM companyRole c, companyRoleFunction f, md_Role r, userRole u
WHERE c.companyRoleId = f.companyRoleId AND c.roleId = r.roleId AND u.userrolecompanyroleid = c.companyRoleId""")

_LINES = """SELECT l.soLineItemId, l.soHeaderId, l.customerSku, l.merchantSku, l.invID, i.modelNo, l.currencyCode, {price} AS csCost, l.odrQty, l.poQty, l.shpQty,
       l.processQty, l.itemNote, l.soLineItemStatus, m.categoryName AS itemStatus, coalesce(d.categoryName, '') AS tagDivision
FROM soLineItem l JOIN md_Inventory i ON l.invID = i.invID JOIN md_MasterCategory m ON l.soLineItemStatus = m.categoryId
LEFT JOIN md_MasterCategory d ON l.tagDivision = d.categoryId"""
register("order_lines", lambda t: V.order_lines(t, 0, 1, 1018), _LINES.format(price="l.csCost"))
register("order_lines_price_masked", lambda t: V.order_lines(t, 2, 3, 1018), _LINES.format(price="CAST(0 AS BIGINT)"))

register("order_lines_for_shipment", lambda t: V.order_lines_for_shipment(t), """
SELECT l.soLineItemId, l.customerSku, l.merchantSku, l.odrQty, l.poQty, h.soName, h.customerPO, CAST(h.earlyShipDate AS VARCHAR) AS earlyShipDate,
       s.shipToLabel, l.poQty AS shpQty
FROM soLineItem l JOIN soHeader h ON l.soHeaderId = h.soHeaderId JOIN md_ShipToDestination s ON h.shipToId = s.shipToId WHERE l.soLineItemStatus = 2125""")

register("customer_sku_dropdown", lambda t: V.customer_sku_dropdown(t), """
SELECT k.customerskuId, i.productCategory, i.productSubCategory, i.productType, k.customerSku || ' ( ' || i.inventorySKU || ' )' AS inventory,
       m.categoryName AS currencyCode, k.csCost, k.merchantSKU
FROM md_CustomerSku k JOIN md_Inventory i ON k.invID = i.invID AND i.status = 1 JOIN md_MasterCategory m ON k.currencyCode = m.categoryId WHERE k.statusflag = 1""")

register("po_items", lambda t: V.po_items(t), """
SELECT podetailsId, poId, poItemDesc AS productName, supplierSku, invID, currencyCode, unitPrice, qty, rcvQty, itemNote, itemStatus,
       unitPrice * qty AS totalPrice, qty - rcvQty AS tobeRcvQty FROM poLineItem""")

register("po_document_items", lambda t: V.po_document_items(t), """
SELECT l.podetailsId, l.poId, l.supplierSku AS factoryModelNo, s.merchantSku AS customerModelNo,
       CASE WHEN k.itemDesc = '' THEN i.productName ELSE k.itemDesc END AS productName, s.customerSku AS vendorStkNo,
       coalesce(c.value, '') AS color, coalesce(p.value, '') AS packaging, l.currencyCode, l.unitPrice, l.qty, l.unitPrice * l.qty AS amount, h.poNote
FROM poLineItem l JOIN poHeader h ON l.poId = h.poId JOIN md_SupplierSku k ON k.invId = l.invID AND k.supplierId = h.supplierId AND k.statusflag = 1
JOIN md_Inventory i ON i.invID = l.invID LEFT JOIN soLineItem s ON s.soLineItemId = l.soLineItemId
LEFT JOIN inventory_attributes c ON c.invID = l.invID AND c.categoryId = 3194 LEFT JOIN inventory_attributes p ON p.invID = l.invID AND p.categoryId = 1123
WHERE l.itemStatus <> 1086""")

_EXPORT = """WITH o AS (SELECT poId, supplierSku, unitPrice, CAST(sum(qty) AS BIGINT) AS qty FROM poLineItem GROUP BY ALL),
n AS (SELECT *, qty * unitPrice AS totalCost, row_number() OVER (PARTITION BY poId ORDER BY supplierSku, unitPrice) AS itemNo FROM o),
r AS (SELECT DISTINCT l.poId, l.supplierSku, l.unitPrice, h.soName || ' *' || l.qty AS remark
      FROM poLineItem l JOIN soLineItem s ON l.soLineItemId = s.soLineItemId JOIN soHeader h ON s.soHeaderId = h.soHeaderId),
u AS (SELECT poId, 'TH' AS rowType, itemNo, supplierSku, qty, unitPrice, totalCost FROM n
      UNION SELECT n.poId, 'TL', n.itemNo, r.remark, NULL, NULL, NULL FROM r JOIN n ON n.poId = r.poId AND n.supplierSku = r.supplierSku AND n.unitPrice = r.unitPrice)"""
register("po_export_rows", lambda t: V.po_export_rows(t), _EXPORT + " SELECT * FROM u")
register("po_export_rows_slice", lambda t: V.po_export_rows(t, row_start=2, row_end=3), _EXPORT + " SELECT * FROM u WHERE itemNo BETWEEN 2 AND 3")
register("po_export_row_count", lambda t: V.po_export_row_count(t), _EXPORT + " SELECT poId, count(*) AS rowReturn FROM u GROUP BY poId")

register("request_lines", lambda t: V.request_lines(t), """
SELECT l.lrDetailsId, l.lrHeaderId, l.lrContainerId, l.poDetailsId, c.containerSeq, p.poName, s.soName, s.customerPO, l.supplierSku, sl.merchantSku, l.qty AS lrQty, l.confirmQty,
       coalesce((SELECT CAST(sum(balanceQty) AS BIGINT) FROM inventoryBalanceWH b WHERE b.companyId = h.companyId AND b.invId = l.invID), 0) AS invBalance,
       l.itemNote, m.categoryName AS itemStatus, s.customerId
FROM lrLineItem l JOIN lrContainer c ON l.lrContainerId = c.lrContainerId JOIN lrHeader h ON l.lrHeaderId = h.lrHeaderId
JOIN md_MasterCategory m ON l.itemStatus = m.categoryId AND m.categoryParentID = 2128
LEFT JOIN poHeader p ON p.poId = l.poId LEFT JOIN soHeader s ON s.soHeaderId = l.soHeaderId LEFT JOIN soLineItem sl ON sl.soLineItemId = l.soLineItemId""")

register("container_load", lambda t: V.container_load(t), """
SELECT c.lrContainerId, c.lrHeaderId, c.containerSeq, m.categoryName AS containerType,
       (SELECT max(attributeValue) FROM md_MasterCategoryAttribute a WHERE a.masterCategoryId = c.containerTypeId AND lower(attributeName) = 'dimension') AS dimension,
       (SELECT max(attributeValue) FROM md_MasterCategoryAttribute a WHERE a.masterCategoryId = c.containerTypeId AND lower(attributeName) = 'cbm') AS CBM,
       (SELECT max(attributeValue) FROM md_MasterCategoryAttribute a WHERE a.masterCategoryId = c.containerTypeId AND lower(attributeName) = 'weight') AS grossWeight,
       q.totalItemCBM, q.totalItemGrossWeight
FROM lrContainer c LEFT JOIN md_MasterCategory m ON c.containerTypeId = m.categoryId
LEFT JOIN (SELECT l.lrContainerId, CAST(sum(l.qty * i.cbm) AS BIGINT) AS totalItemCBM, CAST(sum(l.qty * i.grossWeight) AS BIGINT) AS totalItemGrossWeight
           FROM lrLineItem l JOIN md_Inventory i ON l.invID = i.invID GROUP BY 1) q ON q.lrContainerId = c.lrContainerId""")

register("request_headers", lambda t: V.request_headers(t), """
SELECT h.lrHeaderId, h.companyId,
       CASE WHEN s.supplierId IS NOT NULL THEN s.supplierCompanyName WHEN c.customerId IS NOT NULL THEN c.customerShortCode ELSE '' END AS requestor, h.lrName,
       CAST(h.lrDate AS VARCHAR) AS lrDate, b.containerSeq, st.categoryName AS lrStatus, b.containerTypeId, ct.categoryName AS containerType,
       CAST(b.earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(b.lateShipDate AS VARCHAR) AS lateShipDate, b.portId, p.portName, b.notes
FROM lrHeader h JOIN lrContainer b ON b.lrHeaderId = h.lrHeaderId JOIN md_MasterCategory ct ON ct.categoryId = b.containerTypeId
LEFT JOIN md_MasterCategory st ON st.categoryId = b.containerStatus LEFT JOIN md_Port p ON p.portId = b.portId
LEFT JOIN md_Customer c ON c.customerId = h.customerId AND c.customerId <> 0 LEFT JOIN md_Supplier s ON s.supplierId = h.supplierId AND s.supplierId <> 0""")

register("container_bookings", lambda t: V.container_bookings(t), """
SELECT b.lrContainerId, b.lrHeaderId, ct.categoryName AS containerType, b.containerSeq, b.containerNo, b.containerSealNo, b.forwarderId, f.categoryName AS forwarder,
       CAST(b.forwarderBookingDate AS VARCHAR) AS forwarderBookingDate, b.forwarderBookingNo, CAST(b.ETD AS VARCHAR) AS ETD, CAST(b.ETA AS VARCHAR) AS ETA,
       b.haulierId, coalesce(h.haulier, '') AS haulier, b.portId, p.portName
FROM lrContainer b JOIN md_MasterCategory ct ON ct.categoryId = b.containerTypeId LEFT JOIN md_MasterCategory f ON f.categoryId = b.forwarderId
LEFT JOIN md_haulier h ON h.haulierId = b.haulierId LEFT JOIN md_Port p ON p.portId = b.portId""")

register("container_details", lambda t: V.container_details(t), """
SELECT b.lrHeaderId, b.lrContainerId, b.containerSeq, b.containerNo, b.containerSealNo, b.containerTypeId, ct.categoryName AS containerType
FROM lrContainer b JOIN md_MasterCategory ct ON ct.categoryId = b.containerTypeId""")

register("shipment_headers", lambda t: V.shipment_headers(t), """
SELECT h.shipmentId, h.shipId, h.bol, c.customerName, CAST(h.shipmentDate AS VARCHAR) AS shipmentDate, st.categoryName AS shipStatus,
       CAST(h.containerPullOutDate AS VARCHAR) AS checkoutDate, h.lrName, h.soName, h.customerPO, h.invoiceId, h.customerInvoiceNo, h.InvoiceAmount AS invoiceAmount, h.pickupAddrId, h.shipToId, h.pol, h.pod,
       h.paymentTermId, pt.categoryName AS paymentTerm, h.note, h.apiStatus, CAST(h.invoiceDate AS VARCHAR) AS invoiceDate, w.label AS shipFrom, s.shipToLabel
FROM shipmentHeader h JOIN md_Customer c ON h.customerId = c.customerId JOIN md_MasterCategory pt ON h.paymentTermId = pt.categoryId
JOIN md_MasterCategory st ON h.shipmentStatus = st.categoryId JOIN md_Warehouse w ON h.pickupAddrId = w.warehouseId
JOIN md_ShipToDestination s ON h.shipToId = s.shipToId""")

register("shipment_lines", lambda t: V.shipment_lines(t), """
SELECT h.shipmentId, h.shipId, h.bol, l.customerSku, i.inventorySKU AS inventorySku, l.merchantSku, l.shipmentQty, l.shipQty, l.lineItemNotes, l.lineItemStatus,
       m.categoryName AS itemStatus, l.shipmentLineItemId
FROM shipmentLineItem l JOIN shipmentHeader h ON l.shipmentId = h.shipmentId JOIN md_Inventory i ON l.invId = i.invID
JOIN md_MasterCategory m ON l.lineItemStatus = m.categoryId""")

register("shipment_freight", lambda t: V.shipment_freight(t), """
SELECT h.shipmentId, h.shipId, h.bol, h.containerSeqNo, h.containerNo, h.containerSealNo, h.containerTypeId, ct.categoryName AS containerType, h.forwarderId,
       f.categoryName AS forwarder, h.haulierId, x.haulier AS haulier, v.categoryName AS vessel, CAST(h.ETD AS VARCHAR) AS ETD, CAST(h.ETA AS VARCHAR) AS ETA,
       CAST(h.containerPullOutDate AS VARCHAR) AS containerPullOutDate
FROM shipmentHeader h JOIN md_MasterCategory ct ON ct.categoryId = h.containerTypeId LEFT JOIN md_MasterCategory f ON f.categoryId = h.forwarderId
LEFT JOIN md_haulier x ON x.haulierId = h.haulierId LEFT JOIN md_MasterCategory v ON v.categoryId = h.vesselId""")

register("bill_of_lading", lambda t: V.bill_of_lading(t), """
SELECT DISTINCT h.bol, h.customerId, CAST(h.shipmentDate AS VARCHAR) AS shipmentDate, h.lrName, h.pol, h.pod, ct.categoryName AS containerType, h.containerNo,
       h.forwarderBookingNo AS bookingNo, h.containerSealNo, h.countryOfOrigin, v.categoryName AS vesselName, CAST(h.ETD AS VARCHAR) AS ETD, CAST(h.ETA AS VARCHAR) AS ETA,
       h.bolTotalShipmentWeight, h.note, q.totalPcs
FROM shipmentHeader h JOIN md_MasterCategory ct ON ct.categoryId = h.containerTypeId LEFT JOIN md_MasterCategory v ON v.categoryId = h.vesselId
LEFT JOIN (SELECT x.bol, CAST(sum(l.shipmentQty) AS BIGINT) AS totalPcs FROM shipmentHeader x JOIN shipmentLineItem l ON l.shipmentId = x.shipmentId GROUP BY 1) q
     ON q.bol = h.bol""")

register("receipt_lines", lambda t: V.receipt_lines(t), """
SELECT l.poRcvLineItemId, l.poRcvHeaderId, p.poName, w.label AS warehouse, d.supplierSku, d.qty AS POQty, d.rcvQty, l.notes, m.categoryName AS poItemStatus
FROM poReceivedLineItem l JOIN poReceivedHeader h ON l.poRcvHeaderId = h.poRcvHeaderId JOIN poLineItem d ON d.podetailsId = l.poDetailsId
LEFT JOIN poHeader p ON p.poId = d.poId JOIN md_Warehouse w ON w.warehouseId = h.warehouseId JOIN md_MasterCategory m ON m.categoryId = l.poRcvLineItemStatus""")

register("work_order_headers", lambda t: V.work_order_headers(t), """
SELECT h.workOrderHeaderId, h.workOrderName, h.companyId, h.customerId, c.customerShortCode, h.thirdParty, h.warehouseId, w.locNo,
       CAST(h.workOrderDate AS VARCHAR) AS workOrderDate, CAST(h.targetCompleteDate AS VARCHAR) AS targetCompleteDate, CAST(h.shipDate AS VARCHAR) AS shipDate,
       h.workOrderNote, h.workOrderStatus, m.categoryName AS woStatus, u.userName AS createUser, v.userName AS updateUser, h.apiStatus
FROM workOrderHeader h JOIN md_Customer c ON h.customerId = c.customerId JOIN md_MasterCategory m ON h.workOrderStatus = m.categoryId
LEFT JOIN md_Warehouse w ON w.warehouseId = h.warehouseId LEFT JOIN md_User u ON u.userId = h.createBy LEFT JOIN md_User v ON v.userId = h.updateBy""")

register("work_order_lines", lambda t: V.work_order_lines(t), """
SELECT l.workOrderLineItemId, l.workOrderHeaderId, l.soHeaderId, l.soName, l.soLineItemId, l.invId, i.inventorySKU AS inventorySku, l.qty, l.confirmQty, l.produceQty,
       l.workOrderItemNote, l.workOrderItemStatus, m.categoryName AS itemStatus
FROM workOrderLineItem l JOIN md_Inventory i ON l.invId = i.invID JOIN md_MasterCategory m ON l.workOrderItemStatus = m.categoryId""")

_STOCK = """SELECT b.companyId, b.invId, i.inventorySKU, i.grossWeight, i.cbm, CAST(sum(b.balanceQty) AS BIGINT) AS qty
            FROM inventoryBalanceWH b JOIN md_Inventory i ON b.invId = i.invID GROUP BY ALL"""
register("process_details", lambda t: V.process_details(t), f"""
SELECT l.opLineItemId, l.opId, b.inventorySKU AS inventorySku, s.customerSku, s.merchantSku, s.itemReference1, l.requestQty, l.confirmQty,
       l.requestQty * b.grossWeight AS ttlGrossWeight, l.requestQty * b.cbm AS ttlCbm, b.qty AS whBalanceQty
FROM orderProcessLineItem l JOIN orderProcess h ON h.opId = l.opId JOIN soLineItem s ON s.soLineItemId = l.soLineItemId
LEFT JOIN ({_STOCK}) b ON b.companyId = h.companyId AND b.invId = s.invID""")

register("process_pending", lambda t: V.process_pending(t), f"""
SELECT l.opLineItemId, c.customerName, d.shipToLabel, CAST(o.earlyShipDate AS VARCHAR) AS earlyShipDate, CAST(o.lateShipDate AS VARCHAR) AS lateShipDate, o.soName, o.customerPO,
       b.inventorySKU AS inventorySku, s.customerSku, s.merchantSku, s.itemReference1, s.odrQty - s.shpQty AS soPendingQty, l.requestQty, l.confirmQty,
       l.requestQty * b.grossWeight AS ttlGrossWeight, l.requestQty * b.cbm AS ttlCbm, b.qty AS whBalanceQty
FROM orderProcess h JOIN md_Customer c ON c.customerId = h.customerId JOIN orderProcessLineItem l ON l.opId = h.opId JOIN soLineItem s ON s.soLineItemId = l.soLineItemId
JOIN soHeader o ON o.soHeaderId = s.soHeaderId JOIN md_ShipToDestination d ON d.shipToId = o.shipToId
LEFT JOIN ({_STOCK}) b ON b.companyId = h.companyId AND b.invId = s.invID WHERE h.opStatus = 2142""")

register("procurement_pending", lambda t: V.procurement_pending(t), """
WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invId ORDER BY supCost, supplierskuId) AS rn FROM md_SupplierSku WHERE statusflag = 1) WHERE rn = 1),
b AS (SELECT invId, CAST(sum(balanceQty) AS BIGINT) AS balanceQty, max(lockQty) AS lockQty FROM inventoryBalanceWH GROUP BY 1)
SELECT p.procurementProcessId, k.supplierId, s.soName, CAST(s.earlyShipDate AS VARCHAR) AS shipDate, i.inventorySKU AS inventorySku, p.processQty, p.rawBomQty, b.balanceQty,
       b.lockQty AS warehouseLockQty, p.rawBomInvId, r.inventorySKU AS orderedBom, p.rawBomTotalQty - p.poQty AS rawBomTotalQty, x.supplierCompanyName, k.supCost, p.poQty, p.lockQty
FROM procurementProcess p JOIN soHeader s ON p.soHeaderId = s.soHeaderId JOIN md_Inventory i ON i.invID = p.invId AND i.status = 1
JOIN md_Inventory r ON r.invID = p.rawBomInvId AND r.status = 1 JOIN k ON k.invId = p.rawBomInvId JOIN b ON b.invId = p.rawBomInvId
JOIN md_Supplier x ON x.supplierId = k.supplierId WHERE p.status = 0""")

register("warehouse_stock", lambda t: V.warehouse_stock(t), """
SELECT b.invId, b.companyId, b.warehouseId, w.label AS warehouse, b.balanceQty, b.lockQty, b.balanceQty - b.lockQty AS availableQty
FROM inventoryBalanceWH b JOIN md_Warehouse w ON b.warehouseId = w.warehouseId""")

register("item_suppliers", lambda t: V.item_suppliers(t), """
SELECT k.invId, k.supplierId, s.supplierCompanyName, k.supCost FROM md_SupplierSku k JOIN md_Supplier s ON k.supplierId = s.supplierId AND s.status = 1 WHERE k.statusflag = 1""")

register("item_details", lambda t: V.item_details(t), """
SELECT i.invID, i.itemCode, c.prodCategoryName AS prodCategory, d.prodCategoryName AS prodSubCategory, y.inventoryType AS prodType, i.modelNo, i.inventorySKU, i.productName,
       i.itemDesc, i.grossWeight, i.netWeight, i.cbm, u.categoryName AS measurements, i.glCode, CASE i.isVirtual WHEN 1 THEN 'YES' ELSE 'NO' END AS virtualProduct,
       CASE i.isBuffer WHEN 1 THEN 'YES' ELSE 'NO' END AS "Buffer"
FROM md_Inventory i LEFT JOIN md_InventoryCategory c ON c.prodCategoryId = i.productCategory AND c.prodCategoryParentID = 1
LEFT JOIN md_InventoryCategory d ON d.prodCategoryId = i.productSubCategory AND d.prodCategoryParentID = i.productCategory
LEFT JOIN md_inventoryType y ON y.inventoryTypeId = i.productType AND y.prodCategoryId = i.productSubCategory
LEFT JOIN md_MasterCategory u ON u.categoryId = i.measurement AND u.categoryParentID = 1069""")

register("item_attributes", lambda t: V.item_attributes(t), """
SELECT a.attributesId, a.invID, upper(m.categoryName) AS attributeName, a.value AS attributeValue
FROM inventory_attributes a LEFT JOIN md_MasterCategory m ON a.categoryId = m.categoryId""")

register("item_customer_skus", lambda t: V.item_customer_skus(t), """
SELECT k.customerskuId, k.invID, c.customerName, k.customerSku, k.merchantSKU, k.EAN, k.itemDesc, m.categoryName AS currencyCode, k.csCost,
       CASE k.statusflag WHEN 1 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status
FROM md_CustomerSku k LEFT JOIN md_Customer c ON k.customerId = c.customerId LEFT JOIN md_MasterCategory m ON m.categoryId = k.currencyCode AND m.categoryParentID = 1119""")

register("item_supplier_skus", lambda t: V.item_supplier_skus(t), """
SELECT k.supplierskuId, k.invId, s.supplierCompanyName AS supplierName, k.supplierSku, k.itemDesc, m.categoryName AS currencyCode, k.supCost,
       CASE k.isDefault WHEN 1 THEN 'YES' ELSE 'NO' END AS isDefault, CASE k.statusflag WHEN 1 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status
FROM md_SupplierSku k LEFT JOIN md_Supplier s ON k.supplierId = s.supplierId LEFT JOIN md_MasterCategory m ON m.categoryId = k.currencyCode AND m.categoryParentID = 1119""")

register("bom_listing", lambda t: V.bom_listing(t), """
SELECT r.invId, i.itemCode, i.modelNo, CASE WHEN r.status = 1 THEN 'Active' ELSE 'InActive' END AS status, count(r.rawBomInvId) AS countOfRawBom
FROM rawBom r JOIN md_Inventory i ON r.invId = i.invID AND r.companyId = i.companyId AND i.status = 1 GROUP BY ALL""")

register("bom_details", lambda t: V.bom_details(t), """
SELECT r.invId, r.rawBomInvId, i.itemCode AS rawBomUpc, i.modelNo, r.rawBomQty AS rawQty FROM rawBom r JOIN md_Inventory i ON r.rawBomInvId = i.invID AND i.status = 1""")

register("currency_rates", lambda t: V.currency_rates(t), """
SELECT companyId, homeCurrency, foreignCurrency, foreignRate FROM md_CurrencyRate WHERE status = 1""")

register("change_log", lambda t: V.change_log(t, user_id=1), """
SELECT row_number() OVER (PARTITION BY sourceModule, sourceRecordId ORDER BY a.createDate DESC, actionNotificationID) AS rowNo, a.actionNotificationID, a.sourceModule,
       a.sourceRecordId, a.eventType, a.comment, strftime(a.createDate, '%Y-%m-%d %I:%M%p') AS createDate
FROM actionNotification a WHERE a.actionNotificationID IN (SELECT notificationID FROM notificationRecipient WHERE userID = 1 AND isRead = 0)""")
