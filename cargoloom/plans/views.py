"""Enriched document views, for all rows or for a set of keys.

``ids`` is an optional DataFrame holding the wanted key values; it restricts the
view by a semi join on the columns it shares with the base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permission import may_add
from ..operators.lookup import code_name, keep_if, lookup
from ..operators.ordering import Falling, ordinal, removed_rows, shared_rows
from ..sources.tables import Tables


def only(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return df if ids is None else df.join(ids, ids.columns, "left_semi")


def present(df: DataFrame, *names: str) -> DataFrame:
    """Select the named columns the table has, in this order."""
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(n).alias(n) for n in names if n.lower() in have])


def attribute(df: DataFrame, t: Tables, category: int, out: str, item: str = "invID") -> DataFrame:
    """Value of one item attribute; the lowest attribute id wins when an item has several."""
    values = t.inventory_attributes.where(F.col("categoryId") == category) \
        .groupBy("invID").agg(F.min_by("value", "attributesId").alias("value"))
    return lookup(df, values, {item: "invID"}, **{out: "value"})


def company_stock(t: Tables) -> DataFrame:
    return t.inventoryBalanceWH.groupBy("companyId", "invId").agg(F.sum("balanceQty").alias("balanceQty"))


def money(c):
    """Two-decimal amount; integer amounts (minor units) stay as they are."""
    return F.round(c, 2)


def order_lines(t: Tables, user_id, company_id, menu, ids: DataFrame | None = None) -> DataFrame:
    """Order lines with names; prices read 0 for users who may not add under the menu."""
    lines = lookup(only(t.soLineItem, ids), t.md_Inventory, {"invID": "invID"}, "inner", modelNo="modelNo")
    lines = code_name(lines, t.md_MasterCategory, "soLineItemStatus", "itemStatus", "inner")
    lines = code_name(lines, t.md_MasterCategory, "tagDivision", "division")
    priced = [c for c in ("csCost", "freightCost") if c in lines.columns]
    allowed = may_add(t, user_id, company_id, menu)
    lines = lines.withColumns({c: F.when(allowed == 1, F.col(c)).otherwise(0) for c in priced})
    return lines.withColumn("tagDivision", F.coalesce("division", F.lit(""))) \
        .transform(present, "soLineItemId", "soHeaderId", "customerSkuId", "customerSku", "merchantSku", "invID", "modelNo", "currencyCode",
                   "csCost", "freightCost", "odrQty", "poQty", "shpQty", "processQty", "itemNote", "soLineItemStatus", "itemStatus", "tagDivision")


def order_lines_for_shipment(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = only(t.soLineItem.where(F.col("soLineItemStatus") == 2125), ids) \
        .select("soLineItemId", "soHeaderId", "customerSku", "merchantSku", "odrQty", "poQty")
    orders = lookup(t.soHeader, t.md_ShipToDestination, {"shipToId": "shipToId"}, "inner", shipToLabel="shipToLabel")
    return lines.join(orders.select("soHeaderId", "soName", "customerPO", "earlyShipDate", "shipToLabel"), "soHeaderId") \
        .withColumn("shpQty", F.col("poQty")).drop("soHeaderId")


def customer_sku_dropdown(t: Tables, company_id=None, customer_id=None, category=None, sub_category=None, item_type=None) -> DataFrame:
    skus = keep_if(keep_if(t.md_CustomerSku.where(F.col("statusflag") == 1), "companyId", company_id), "customerId", customer_id)
    items = keep_if(keep_if(keep_if(t.md_Inventory.where(F.col("status") == 1), "productCategory", category),
                            "productSubCategory", sub_category), "productType", item_type)
    rows = lookup(skus, items, {"invID": "invID"}, "inner", productCategory="productCategory", productSubCategory="productSubCategory",
                  productType="productType", _sku="inventorySKU")
    rows = code_name(rows, t.md_MasterCategory, "currencyCode", "_currency", "inner")
    return rows.select("customerskuId", "productCategory", "productSubCategory", "productType",
                       F.concat("customerSku", F.lit(" ( "), "_sku", F.lit(" )")).alias("inventory"),
                       F.col("_currency").alias("currencyCode"), "csCost", "merchantSKU")


def po_items(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    return only(t.poLineItem, ids).withColumns({
        "productName": F.col("poItemDesc"), "totalPrice": money(F.col("unitPrice") * F.col("qty")),
        "tobeRcvQty": F.col("qty") - F.col("rcvQty")}) \
        .transform(present, "podetailsId", "poId", "productName", "supplierSku", "invID", "currencyCode", "unitPrice", "qty", "rcvQty",
                   "itemNote", "itemStatus", "homeCurrencyCost", "totalPrice", "tobeRcvQty")


def po_document_items(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """PO lines as printed: amounts, customer SKU, colour, packing, supplier description or product name."""
    lines = only(t.poLineItem, ids).where(F.col("itemStatus") != 1086) \
        .select("podetailsId", "poId", "soLineItemId", "supplierSku", "invID", "currencyCode", "unitPrice", "qty",
                money(F.col("unitPrice") * F.col("qty")).alias("amount"))
    lines = lines.join(t.poHeader.select("poId", "supplierId", "poNote"), "poId")
    skus = t.md_SupplierSku.where(F.col("statusflag") == 1)
    lines = lookup(lines, skus, {"invID": "invId", "supplierId": "supplierId"}, "inner", _desc="itemDesc")
    lines = lookup(lines, t.md_Inventory, {"invID": "invID"}, "inner", _name="productName")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, customerModelNo="merchantSku", vendorStkNo="customerSku")
    lines = attribute(attribute(lines, t, 3194, "color"), t, 1123, "packaging")
    return lines.select("podetailsId", "poId", F.col("supplierSku").alias("factoryModelNo"), "customerModelNo",
                        F.when(F.col("_desc") == "", F.col("_name")).otherwise(F.col("_desc")).alias("productName"), "vendorStkNo",
                        F.coalesce("color", F.lit("")).alias("color"), F.coalesce("packaging", F.lit("")).alias("packaging"),
                        "currencyCode", "unitPrice", "qty", "amount", "poNote")


def po_export_rows(t: Tables, ids: DataFrame | None = None, row_start=None, row_end=None) -> DataFrame:
    """Numbered items (TH) of each PO with their per-order remark rows (TL).

    Items group a PO's lines by SKU and price; a remark belongs to the item of
    its own SKU and price.
    """
    lines = only(t.poLineItem, ids).select("poId", "supplierSku", "unitPrice", "qty", "soLineItemId")
    items = lines.groupBy("poId", "supplierSku", "unitPrice").agg(F.sum("qty").alias("qty")) \
        .withColumn("totalCost", F.col("qty") * F.col("unitPrice"))
    items = ordinal(items, ["supplierSku", "unitPrice"], within=["poId"], name="itemNo")
    if row_start is not None and row_end is not None:
        items = items.where(F.col("itemNo").between(row_start, row_end))
    orders = lookup(t.soLineItem, t.soHeader, {"soHeaderId": "soHeaderId"}, "inner", soName="soName")
    remarks = lookup(lines, orders, {"soLineItemId": "soLineItemId"}, "inner", soName="soName") \
        .select("poId", "supplierSku", "unitPrice", F.concat("soName", F.lit(" *"), F.col("qty").cast("string")).alias("remark")).distinct()
    remarks = remarks.join(items.select("poId", "supplierSku", "unitPrice", "itemNo"), ["poId", "supplierSku", "unitPrice"])
    head = items.select("poId", F.lit("TH").alias("rowType"), "itemNo", "supplierSku", "qty", "unitPrice", "totalCost")
    tail = remarks.select("poId", F.lit("TL").alias("rowType"), "itemNo", F.col("remark").alias("supplierSku"))
    return head.unionByName(tail, allowMissingColumns=True)


def po_export_row_count(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Rows ``po_export_rows`` gives per PO; counted without numbering the items."""
    lines = only(t.poLineItem, ids)
    items = lines.select("poId", "supplierSku", "unitPrice").distinct().groupBy("poId").agg(F.count(F.lit(1)).alias("n"))
    orders = t.soLineItem.select("soLineItemId", "soHeaderId")
    named = lines.join(orders, "soLineItemId").join(t.soHeader.select("soHeaderId", "soName"), "soHeaderId")
    remarks = named.select("poId", "supplierSku", "unitPrice", "soName", "qty").distinct().groupBy("poId").agg(F.count(F.lit(1)).alias("n"))
    return items.unionByName(remarks).groupBy("poId").agg(F.sum("n").alias("rowReturn"))


def request_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = only(t.lrLineItem, ids)
    lines = lookup(lines, t.lrContainer, {"lrContainerId": "lrContainerId"}, "inner", containerSeq="containerSeq")
    lines = lookup(lines, t.lrHeader, {"lrHeaderId": "lrHeaderId"}, "inner", companyId="companyId")
    states = t.md_MasterCategory.where(F.col("categoryParentID") == 2128)
    lines = code_name(lines, states, "itemStatus", "statusName", "inner")
    if ids is None:  # of all lines, what two joins shuffle is on disk at once
        placed = lines = shared_rows(present(lines, "lrDetailsId", "lrHeaderId", "lrContainerId", "poDetailsId", "poId", "soHeaderId", "soLineItemId", "companyId", "invID", "containerSeq", "supplierSku",
                                             "qty", "confirmQty", "itemNote", "statusName"))
    lines = lookup(lines, company_stock(t), {"companyId": "companyId", "invID": "invId"}, _stock="balanceQty")
    lines = lookup(lines, t.poHeader, {"poId": "poId"}, poName="poName")
    if ids is None:
        lines = shared_rows(present(lines, "lrDetailsId", "lrHeaderId", "lrContainerId", "poDetailsId", "soHeaderId", "soLineItemId", "containerSeq", "poName", "supplierSku", "qty", "confirmQty",
                                    "_stock", "itemNote", "statusName"))
        removed_rows(placed)
    lines = lookup(lines, t.soHeader, {"soHeaderId": "soHeaderId"}, soName="soName", customerPO="customerPO", customerId="customerId")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, merchantSku="merchantSku", customerSku="customerSku")
    return lines.withColumns({"lrQty": F.col("qty"), "invBalance": F.coalesce("_stock", F.lit(0)), "itemStatus": F.col("statusName")}) \
        .transform(present, "lrDetailsId", "lrHeaderId", "lrContainerId", "poDetailsId", "containerSeq", "poName", "soName", "customerPO",
                   "supplierSku", "merchantSku", "lrQty", "confirmQty", "invBalance", "itemNote", "itemStatus", "customerId")


def container_limits(t: Tables) -> DataFrame:
    """Container type attributes as columns: dimension, cbm, weight."""
    named = t.md_MasterCategoryAttribute.select("masterCategoryId", F.lower("attributeName").alias("a"), "attributeValue")
    return named.groupBy("masterCategoryId").agg(*[F.max(F.when(F.col("a") == a, F.col("attributeValue"))).alias(a)
                                                   for a in ("dimension", "cbm", "weight")])


def container_load(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per container: type limits against the weight and volume of what is planned into it."""
    boxes = only(t.lrContainer.select("lrContainerId", "lrHeaderId", "containerSeq", "containerTypeId"), ids)
    boxes = code_name(boxes, t.md_MasterCategory, "containerTypeId", "containerType")
    boxes = lookup(boxes, container_limits(t), {"containerTypeId": "masterCategoryId"}, dimension="dimension", CBM="cbm", grossWeight="weight")
    items = lookup(t.lrLineItem.select("lrContainerId", "invID", "qty"), t.md_Inventory, {"invID": "invID"}, "inner", _w="grossWeight", _v="cbm")
    sums = items.groupBy("lrContainerId").agg(F.sum(F.col("qty") * F.col("_v")).alias("totalItemCBM"),
                                              F.sum(F.col("qty") * F.col("_w")).alias("totalItemGrossWeight"))
    return boxes.join(sums, "lrContainerId", "left").drop("containerTypeId")


def request_headers(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Request and container; the requester is the supplier's name, else the customer's short code."""
    heads = only(t.lrHeader, ids)
    heads = lookup(heads, t.md_Customer.where(F.col("customerId") != 0), {"customerId": "customerId"}, _customer="customerShortCode")
    heads = lookup(heads, t.md_Supplier.where(F.col("supplierId") != 0), {"supplierId": "supplierId"}, _supplier="supplierCompanyName")
    heads = heads.select("lrHeaderId", "companyId", F.coalesce("_supplier", "_customer", F.lit("")).alias("requestor"), "lrName", "lrDate")
    boxes = lookup(t.lrContainer, t.md_Port, {"portId": "portId"}, portName="portName")
    boxes = code_name(boxes, t.md_MasterCategory, "containerStatus", "lrStatus")
    boxes = code_name(boxes, t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    return heads.join(boxes.select("lrHeaderId", "containerSeq", "lrStatus", "containerTypeId", "containerType", "earlyShipDate", "lateShipDate",
                                   "portId", "portName", "notes"), "lrHeaderId")


def container_bookings(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    boxes = lookup(only(t.lrContainer, ids), t.md_Port, {"portId": "portId"}, portName="portName")
    boxes = code_name(boxes, t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    boxes = code_name(boxes, t.md_MasterCategory, "forwarderId", "forwarder")
    boxes = lookup(boxes, t.md_haulier, {"haulierId": "haulierId"}, _haulier="haulier")
    return boxes.withColumns({"containerNo": F.coalesce("containerNo", F.lit("")), "containerSealNo": F.coalesce("containerSealNo", F.lit("")),
                              "haulierId": F.coalesce("haulierId", F.lit(0)), "haulier": F.coalesce("_haulier", F.lit(""))}) \
        .transform(present, "lrContainerId", "lrHeaderId", "containerType", "containerSeq", "containerNo", "containerSealNo", "forwarderId",
                   "forwarder", "forwarderBookingId", "forwarderBookingDate", "forwarderReplyDate", "forwarderSICutOffDate",
                   "forwarderBookingNo", "ETD", "ETA", "MAAP", "Pouch", "haulierId", "haulier", "portId", "portName")


def container_details(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    boxes = code_name(only(t.lrContainer, ids), t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    return present(boxes, "lrHeaderId", "lrContainerId", "containerSeq", "containerNo", "containerSealNo", "containerMaxGross", "containerTare",
                   "containerTypeId", "containerType", "containerPullInDate", "containerPullOutDate", "cargoReadyDate")


def shipment_headers(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Shipments with names; a shipment whose code, customer or place is unknown is left out."""
    ships = lookup(only(t.shipmentHeader, ids), t.md_Customer, {"customerId": "customerId"}, "inner", customerName="customerName")
    ships = code_name(ships, t.md_MasterCategory, "paymentTermId", "paymentTerm", "inner")
    ships = code_name(ships, t.md_MasterCategory, "shipmentStatus", "shipStatus", "inner")
    ships = lookup(ships, t.md_Warehouse, {"pickupAddrId": "warehouseId"}, "inner", shipFrom="label")
    ships = lookup(ships, t.md_ShipToDestination, {"shipToId": "shipToId"}, "inner", shipToLabel="shipToLabel")
    return ships.withColumn("checkoutDate", F.col("containerPullOutDate")).transform(
        present, "shipmentId", "shipId", "bol", "customerName", "shipmentDate", "shipStatus", "checkoutDate", "lrName", "soName", "customerPO",
        "invoiceId", "customerInvoiceNo", "invoiceAmount", "pickupAddrId", "shipToId", "pol", "pod", "paymentTermId", "paymentTerm", "note",
        "apiStatus", "asnDate", "invoiceDate", "shipFrom", "shipToLabel")


def shipment_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = lookup(only(t.shipmentLineItem, ids), t.md_Inventory, {"invId": "invID"}, "inner", inventorySku="inventorySKU")
    lines = code_name(lines, t.md_MasterCategory, "lineItemStatus", "itemStatus", "inner")
    return lines.join(t.shipmentHeader.select("shipmentId", "shipId", "bol"), "shipmentId") \
        .select("shipmentId", "shipId", "bol", "customerSku", "inventorySku", "merchantSku", "shipmentQty", "shipQty", "lineItemNotes",
                "lineItemStatus", "itemStatus", "shipmentLineItemId")


def shipment_freight(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    ships = code_name(only(t.shipmentHeader, ids), t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    ships = code_name(ships, t.md_MasterCategory, "forwarderId", "forwarder")
    ships = lookup(ships, t.md_haulier, {"haulierId": "haulierId"}, haulier="haulier")
    ships = code_name(ships, t.md_MasterCategory, "vesselId", "vessel")
    return present(ships, "shipmentId", "shipId", "bol", "containerSeqNo", "containerNo", "containerSealNo", "containerMaxGross", "containerTare",
                   "containerTypeId", "containerType", "forwarderId", "forwarder", "haulierId", "haulier", "vessel", "ETD", "ETA",
                   "containerPullInDate", "containerPullOutDate")


def bill_of_lading(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Per bill of lading: distinct header rows and the total pieces of all its shipments."""
    ships = only(t.shipmentHeader, ids)
    pieces = t.shipmentLineItem.groupBy("shipmentId").agg(F.sum("shipmentQty").alias("n"))
    total = ships.select("shipmentId", "bol").join(pieces, "shipmentId").groupBy("bol").agg(F.sum("n").alias("totalPcs"))
    heads = code_name(ships, t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    heads = code_name(heads, t.md_MasterCategory, "vesselId", "vesselName")
    heads = heads.withColumn("bookingNo", F.col("forwarderBookingNo")).transform(
        present, "bol", "customerId", "shipmentDate", "lrName", "pol", "pod", "containerType", "containerNo", "bookingNo", "containerSealNo",
        "countryOfOrigin", "vesselName", "ETD", "ETA", "bolTotalShipmentWeight", "summary", "note").distinct()
    return heads.join(total, "bol", "left")


def receipt_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = only(t.poReceivedLineItem, ids).select("poRcvLineItemId", "poRcvHeaderId", "poDetailsId", "notes", "poRcvLineItemStatus")
    lines = lines.join(t.poReceivedHeader.select("poRcvHeaderId", "warehouseId"), "poRcvHeaderId")
    lines = lookup(lines, t.poLineItem, {"poDetailsId": "podetailsId"}, "inner", supplierSku="supplierSku", POQty="qty", rcvQty="rcvQty", _po="poId")
    lines = lookup(lines, t.poHeader, {"_po": "poId"}, poName="poName")
    lines = lookup(lines, t.md_Warehouse, {"warehouseId": "warehouseId"}, "inner", warehouse="label")
    lines = code_name(lines, t.md_MasterCategory, "poRcvLineItemStatus", "poItemStatus", "inner")
    return lines.select("poRcvLineItemId", "poRcvHeaderId", "poName", "warehouse", "supplierSku", "POQty", "rcvQty", "notes", "poItemStatus")


def work_order_headers(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    rows = lookup(only(t.workOrderHeader, ids), t.md_Customer, {"customerId": "customerId"}, "inner", customerShortCode="customerShortCode")
    rows = code_name(rows, t.md_MasterCategory, "workOrderStatus", "woStatus", "inner")
    rows = lookup(rows, t.md_Warehouse, {"warehouseId": "warehouseId"}, locNo="locNo")
    rows = lookup(rows, t.md_User, {"createBy": "userId"}, createUser="userName")
    rows = lookup(rows, t.md_User, {"updateBy": "userId"}, updateUser="userName")
    return present(rows, "workOrderHeaderId", "workOrderName", "companyId", "customerId", "customerShortCode", "thirdParty", "warehouseId", "locNo",
                   "workOrderDate", "targetCompleteDate", "shipDate", "workOrderNote", "workOrderStatus", "woStatus", "createUser", "createDate",
                   "updateUser", "updateDate", "apiStatus")


def work_order_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """By header or by line, depending on the key column ``ids`` holds."""
    rows = lookup(only(t.workOrderLineItem, ids), t.md_Inventory, {"invId": "invID"}, "inner", inventorySku="inventorySKU")
    rows = code_name(rows, t.md_MasterCategory, "workOrderItemStatus", "itemStatus", "inner")
    return present(rows, "workOrderLineItemId", "workOrderHeaderId", "workOrderName", "soHeaderId", "soName", "soLineItemId", "invId",
                   "inventorySku", "qty", "confirmQty", "produceQty", "workOrderItemNote", "workOrderItemStatus", "itemStatus")


def _process_figures(t: Tables, lines: DataFrame) -> DataFrame:
    """Stock, weight and volume per process line (item facts only where the company holds the item)."""
    stock = lookup(company_stock(t), t.md_Inventory, {"invId": "invID"}, "inner", _sku="inventorySKU", _w="grossWeight", _v="cbm")
    lines = lookup(lines, stock, {"companyId": "companyId", "invId": "invId"}, inventorySku="_sku", whBalanceQty="balanceQty", _w="_w", _v="_v")
    return lines.withColumns({"ttlGrossWeight": F.col("requestQty") * F.col("_w"), "ttlCbm": F.col("requestQty") * F.col("_v")}).drop("_w", "_v")


def process_details(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = only(t.orderProcessLineItem.select("opLineItemId", "opId", "soLineItemId", "requestQty", "confirmQty"), ids)
    lines = lines.join(t.orderProcess.select("opId", "companyId"), "opId")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", invId="invID", customerSku="customerSku",
                   merchantSku="merchantSku", itemReference1="itemReference1")
    return _process_figures(t, lines).select("opLineItemId", "opId", "inventorySku", "customerSku", "merchantSku", "itemReference1", "requestQty",
                                             "confirmQty", "ttlGrossWeight", "ttlCbm", "whBalanceQty")


def process_pending(t: Tables, company_id=None) -> DataFrame:
    heads = keep_if(t.orderProcess.where(F.col("opStatus") == 2142), "companyId", company_id)
    heads = lookup(heads, t.md_Customer, {"customerId": "customerId"}, "inner", customerName="customerName")
    lines = t.orderProcessLineItem.select("opLineItemId", "opId", "soLineItemId", "requestQty", "confirmQty") \
        .join(heads.select("opId", "companyId", "customerName"), "opId")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", invId="invID", customerSku="customerSku", merchantSku="merchantSku",
                   itemReference1="itemReference1", _so="soHeaderId", soPendingQty=F.col("odrQty") - F.col("shpQty"))
    orders = lookup(t.soHeader, t.md_ShipToDestination, {"shipToId": "shipToId"}, "inner", shipToLabel="shipToLabel")
    lines = lookup(lines, orders, {"_so": "soHeaderId"}, "inner", soName="soName", customerPO="customerPO", earlyShipDate="earlyShipDate",
                   lateShipDate="lateShipDate", shipToLabel="shipToLabel")
    return _process_figures(t, lines).select("opLineItemId", "customerName", "shipToLabel", "earlyShipDate", "lateShipDate", "soName", "customerPO",
                                             "inventorySku", "customerSku", "merchantSku", "itemReference1", "soPendingQty", "requestQty",
                                             "confirmQty", "ttlGrossWeight", "ttlCbm", "whBalanceQty")


def procurement_pending(t: Tables, company_id=None) -> DataFrame:
    """Open material demand with the cheapest active supplier and the stock of the material.

    The cheapest supplier is an aggregate (lowest cost, then lowest SKU id), so no item is sorted in one task.
    """
    demand = keep_if(t.procurementProcess.where(F.col("status") == 0), "companyId", company_id)
    demand = lookup(demand, t.soHeader, {"soHeaderId": "soHeaderId"}, "inner", soName="soName", shipDate="earlyShipDate")
    items = t.md_Inventory.where(F.col("status") == 1)
    demand = lookup(demand, items, {"invId": "invID"}, "inner", inventorySku="inventorySKU")
    demand = lookup(demand, items, {"rawBomInvId": "invID"}, "inner", orderedBom="inventorySKU")
    offers = keep_if(t.md_SupplierSku.where(F.col("statusflag") == 1), "companyId", company_id)
    best = offers.groupBy("invId").agg(F.min(F.struct("supCost", "supplierskuId", "supplierId")).alias("b"))
    demand = lookup(demand, best, {"rawBomInvId": "invId"}, "inner", supplierId="b.supplierId", supCost="b.supCost")
    demand = lookup(demand, t.md_Supplier, {"supplierId": "supplierId"}, "inner", supplierCompanyName="supplierCompanyName")
    stock = t.inventoryBalanceWH.groupBy("invId").agg(F.sum("balanceQty").alias("b"), F.max("lockQty").alias("l"))
    demand = lookup(demand, stock, {"rawBomInvId": "invId"}, "inner", balanceQty="b", warehouseLockQty="l")
    return demand.select("procurementProcessId", "supplierId", "soName", "shipDate", "inventorySku", "processQty", "rawBomQty", "balanceQty",
                         "warehouseLockQty", "rawBomInvId", "orderedBom", (F.col("rawBomTotalQty") - F.col("poQty")).alias("rawBomTotalQty"),
                         "supplierCompanyName", "supCost", "poQty", "lockQty")


def warehouse_stock(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Balance, lock and available quantity per item and warehouse."""
    rows = lookup(only(t.inventoryBalanceWH, ids), t.md_Warehouse, {"warehouseId": "warehouseId"}, "inner", warehouse="label")
    return rows.select("invId", "companyId", "warehouseId", "warehouse", "balanceQty", "lockQty",
                       (F.col("balanceQty") - F.col("lockQty")).alias("availableQty"))


def item_suppliers(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    offers = only(t.md_SupplierSku.where(F.col("statusflag") == 1), ids)
    active = t.md_Supplier.where(F.col("status") == 1)
    return lookup(offers, active, {"supplierId": "supplierId"}, "inner", supplierCompanyName="supplierCompanyName") \
        .select("invId", "supplierId", "supplierCompanyName", "supCost")


def item_details(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    categories = t.md_InventoryCategory.where(F.col("status") == 1)
    rows = lookup(only(t.md_Inventory, ids), categories.where(F.col("prodCategoryParentID") == 1), {"productCategory": "prodCategoryId"},
                  prodCategory="prodCategoryName")
    rows = lookup(rows, categories, {"productSubCategory": "prodCategoryId", "productCategory": "prodCategoryParentID"},
                  prodSubCategory="prodCategoryName")
    rows = lookup(rows, t.md_inventoryType.where(F.col("status") == 1), {"productType": "inventoryTypeId", "productSubCategory": "prodCategoryId"},
                  prodType="inventoryType")
    units = t.md_MasterCategory.where((F.col("categoryParentID") == 1069) & (F.col("status") == 1))
    rows = code_name(rows, units, "measurement", "measurements")

    def yes_no(c):
        return F.when(F.col(c) == 1, "YES").otherwise("NO")

    return rows.withColumns({"virtualProduct": yes_no("isVirtual"), "Buffer": yes_no("isBuffer")}).transform(
        present, "invID", "itemCode", "prodCategory", "prodSubCategory", "prodType", "modelNo", "inventorySKU", "productName", "itemDesc",
        "productPrice", "grossWeight", "grossLength", "grossWidth", "grossHeight", "netWeight", "netLength", "netWidth", "netHeight", "cbm",
        "measurements", "glCode", "virtualProduct", "Buffer")


def item_attributes(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    names = t.md_MasterCategory.where(F.col("status") == 1)
    return lookup(only(t.inventory_attributes, ids), names, {"categoryId": "categoryId"}, attributeName=F.upper("categoryName")) \
        .select("attributesId", "invID", "attributeName", F.col("value").alias("attributeValue"))


def _currency_name(df: DataFrame, t: Tables) -> DataFrame:
    currencies = t.md_MasterCategory.where((F.col("categoryParentID") == 1119) & (F.col("status") == 1))
    return code_name(df, currencies, "currencyCode", "_currency").withColumn("currencyCode", F.col("_currency")).drop("_currency")


def item_customer_skus(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    rows = lookup(only(t.md_CustomerSku, ids), t.md_Customer, {"customerId": "customerId"}, customerName="customerName")
    return _currency_name(rows, t).select("customerskuId", "invID", "customerName", "customerSku", "merchantSKU", "EAN", "itemDesc", "currencyCode",
                                          "csCost", F.when(F.col("statusflag") == 1, "ACTIVE").otherwise("INACTIVE").alias("status"))


def item_supplier_skus(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    rows = lookup(only(t.md_SupplierSku, ids), t.md_Supplier, {"supplierId": "supplierId"}, supplierName="supplierCompanyName")
    rows = _currency_name(rows, t).withColumns({"status": F.when(F.col("statusflag") == 1, "ACTIVE").otherwise("INACTIVE"),
                                                "isDefault": F.when(F.col("isDefault") == 1, "YES").otherwise("NO")})
    return present(rows, "supplierskuId", "invId", "supplierName", "supplierSku", "itemDesc", "currencyCode", "supCost", "moq", "isDefault", "status")


def bom_listing(t: Tables, company_id=None) -> DataFrame:
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = lookup(keep_if(t.rawBom, "companyId", company_id), items, {"invId": "invID", "companyId": "companyId"}, "inner",
                  itemCode="itemCode", modelNo="modelNo")
    state = F.when(F.col("status") == 1, "Active").otherwise("InActive").alias("status")
    return rows.groupBy("invId", "itemCode", "modelNo", state).agg(F.count("rawBomInvId").alias("countOfRawBom"))


def bom_details(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Components of items; component items are matched on the key alone, as a component may belong to another company."""
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = lookup(only(t.rawBom, ids), items, {"rawBomInvId": "invID"}, "inner", rawBomUpc="itemCode", modelNo="modelNo")
    return rows.select("invId", "rawBomInvId", "rawBomUpc", "modelNo", F.col("rawBomQty").alias("rawQty"))


def currency_rates(t: Tables, company_id=None) -> DataFrame:
    return keep_if(t.md_CurrencyRate.where(F.col("status") == 1), "companyId", company_id) \
        .select("companyId", "homeCurrency", "foreignCurrency", "foreignRate")


def change_log(t: Tables, user_id, company_id=None, module=None, ids: DataFrame | None = None) -> DataFrame:
    """A user's unread notices, numbered newest first per record, with a formatted time."""
    mine = t.notificationRecipient.where((F.col("userID") == user_id) & (F.col("isRead").cast("int") == 0)).select("notificationID").distinct()
    rows = only(keep_if(keep_if(t.actionNotification, "corporateId", company_id), "sourceModule", module), ids)
    rows = rows.join(mine, F.col("actionNotificationID") == F.col("notificationID"), "left_semi")
    rows = ordinal(rows, [Falling("createDate"), "actionNotificationID"], within=["sourceModule", "sourceRecordId"])
    return rows.select("rowNo", "actionNotificationID", "sourceModule", "sourceRecordId", "eventType", "comment",
                       F.date_format("createDate", "yyyy-MM-dd hh:mma").alias("createDate"))
