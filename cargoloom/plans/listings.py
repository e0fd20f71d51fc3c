"""Paged, searchable document listings.

All take the tables and keyword parameters; an unset parameter (None, 0, '')
means no filter.  The searched or filtered rows are sorted and cut first, and
costly per-document figures are then computed for the page only, unless the
page is sorted by such a figure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, contains_text, distinct_list
from ..operators.history import unread_flags
from ..operators.lookup import between_if, code_name, keep_if, lookup
from ..operators.ordering import shared_checkpoint
from ..operators.paging import paged_listing
from ..sources.tables import Tables


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def sales_order_listing(t: Tables, company_id=None, customer_id=None, order_dates=(None, None), ship_dates=(None, None),
                        port=None, status=None, search=None, user_id=0, sort_by=1, direction="DESC",
                        row_start=1, page_rows=50) -> DataFrame:
    orders = keep_if(t.soHeader, "companyId", company_id)
    if search:
        orders = orders.where(contains_text("soName", search) | contains_text("customerPO", search))
    else:
        orders = keep_if(keep_if(orders, "soStatus", status), "customerId", customer_id)
        orders = between_if(between_if(orders, "soDate", *order_dates), "earlyShipDate", *ship_dates)
    ship_to = keep_if(keep_if(t.md_ShipToDestination, "companyId", company_id), "pod", port)
    rows = lookup(orders, ship_to, {"shipToId": "shipToId"}, "inner", shipToLabel="shipToLabel")
    rows = lookup(rows, t.md_Customer, {"customerId": "customerId"}, "inner", customerName="customerName")
    rows = code_name(rows, t.md_MasterCategory, "soStatus", "soStatusName", "inner")
    rows = rows.select("soHeaderId", "companyId", "customerName", "soName", "customerPO", "soDate",
                       F.col("earlyShipDate").alias("shipDate"), "shipToLabel",
                       F.col("soStatus").alias("soStatusId"), F.col("soStatusName").alias("soStatus"))
    sorts = {1: "soName", 2: "customerPO", 3: "soDate", 4: "customerName", 5: "shipToLabel", 6: "shipDate", 7: "soStatus"}
    page = paged_listing(rows, sorts, sort_by, direction, ["soHeaderId"], row_start, page_rows)
    return unread_flags(page, t, "soHeaderId", "SalesOrder", user_id, company_id).drop("companyId")


def work_order_queue_listing(t: Tables, company_id=None, customer_id=None, ship_from=None, port=None, loc_no=None,
                             ready_only=True, search=None, sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    """Order lines with quantity still to be put on a work order."""
    orders = keep_if(t.soHeader, "companyId", company_id)
    if search:
        orders = orders.where(contains_text("soName", search) | contains_text("customerPO", search))
    else:
        orders = keep_if(keep_if(keep_if(orders, "customerId", customer_id), "locNo", loc_no), "portOfDestination", port)
        orders = between_if(orders, "earlyShipDate", ship_from)
    if ready_only:
        orders = orders.where(~blank("locNo") & (F.col("soStatus") != 1105))
    orders = lookup(orders, t.md_Port, {"portOfDestination": "portId"}, "inner", portName="portName")
    orders = code_name(orders, t.md_MasterCategory, "soStatus", "soStatusName", "inner")
    lines = t.soLineItem.where((F.col("odrQty") - F.col("processQty") > 0) & ~F.col("soLineItemStatus").isin(1107, 1108)) \
        .select("soLineItemId", "soHeaderId", "invID", "odrQty", "processQty")
    rows = lines.join(orders.select("soHeaderId", "soName", "locNo", "thirdParty", "customerPO", "earlyShipDate", "portName",
                                    "soStatusName"), "soHeaderId")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, "inner", inventorySku="inventorySKU")
    rows = rows.select("soLineItemId", F.coalesce("locNo", F.lit("")).alias("locNo"), "soName", "thirdParty", "customerPO",
                       F.col("earlyShipDate").alias("shipDate"), "portName", "inventorySku", "odrQty", "processQty",
                       (F.col("odrQty") - F.col("processQty")).alias("pendingProcessQty"), F.col("soStatusName").alias("soStatus"))
    sorts = {1: "locNo", 2: "soName", 3: "thirdParty", 4: "customerPO", 5: "shipDate", 6: "portName"}
    return paged_listing(rows, sorts, sort_by, direction, ["soLineItemId"], row_start, page_rows)


def packing_list(t: Tables, company_id=None, customer_id=None, ship_dates=(None, None), port=None, search=None,
                 sort_by=1, direction="ASC", row_start=1, page_rows=50) -> DataFrame:
    """Order lines not fully shipped, with company stock and the quantity still to be loaded."""
    orders = keep_if(keep_if(t.soHeader, "companyId", company_id), "customerId", customer_id)
    orders = orders.where(~F.col("soStatus").isin(1107, 1108))
    if search:
        by_request = _ids(lookup(t.lrLineItem, t.lrHeader, {"lrHeaderId": "lrHeaderId"}, "inner", _lr="lrName")
                          .where(contains_text("_lr", search)), "soHeaderId").withColumn("_hit", F.lit(1))
        orders = orders.join(by_request, "soHeaderId", "left") \
            .where(contains_text("soName", search) | contains_text("customerPO", search) | F.col("_hit").isNotNull()).drop("_hit")
    else:
        orders = between_if(orders, "earlyShipDate", *ship_dates)
    orders = lookup(orders, keep_if(t.md_ShipToDestination, "pod", port), {"shipToId": "shipToId"}, "inner", shipToLabel="shipToLabel")
    orders = lookup(orders, t.md_Customer, {"customerId": "customerId"}, "inner", customerName="customerName")
    lines = t.soLineItem.where(~F.col("soLineItemStatus").isin(1107, 1108) & (F.col("odrQty") - F.col("shpQty") > 0)) \
        .select("soLineItemId", "soHeaderId", "invID", (F.col("odrQty") - F.col("shpQty")).alias("openQty"))
    rows = lines.join(orders.select("soHeaderId", "companyId", "customerName", "soName", "customerPO", "soDate", "earlyShipDate",
                                    "lateShipDate", "shipToLabel"), "soHeaderId")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, inventorySku="inventorySKU")
    loading = lookup(t.lrLineItem, t.lrHeader, {"lrHeaderId": "lrHeaderId"}, "inner", lrName="lrName")
    rows = lookup(rows, loading, {"soLineItemId": "soLineItemId"}, _lrDetailsId="lrDetailsId", lrName="lrName",
                  loadingQty=F.col("qty") - F.col("processQty"))
    sorts = {1: "soName", 2: "lrName", 3: "customerName", 4: "shipToLabel", 5: "earlyShipDate"}
    page = paged_listing(rows, sorts, sort_by, direction, ["soLineItemId", "_lrDetailsId"], row_start, page_rows)
    stock = t.inventoryBalanceWH.groupBy("companyId", "invId").agg(F.sum("balanceQty").alias("qty"))
    page = lookup(page, stock, {"companyId": "companyId", "invID": "invId"}, _stock="qty")
    return page.withColumn("warehouseQty", F.coalesce("_stock", F.lit(0))) \
        .select("soLineItemId", "customerName", "soName", "lrName", "customerPO", "soDate", "earlyShipDate", "lateShipDate",
                "shipToLabel", "inventorySku", "openQty", "loadingQty", "warehouseQty", "rowNo", "totalRecord")


def open_sales_orders(t: Tables, company_id=None, customer_id=None) -> DataFrame:
    orders = keep_if(keep_if(t.soHeader, "companyId", company_id), "customerId", customer_id)
    orders = code_name(orders.where(~F.col("soStatus").isin(1107, 1108)), t.md_MasterCategory, "soStatus", "statusName", "inner")
    return orders.select("soHeaderId", "customerId", "soName", "soDate", "customerPO", "earlyShipDate", "lateShipDate",
                         F.col("statusName").alias("soStatus")).orderBy("earlyShipDate", "soHeaderId")


def _po_quantities(page: DataFrame, t: Tables) -> DataFrame:
    sums = t.poLineItem.where(F.col("itemStatus") != 1086).join(_ids(page, "poId"), "poId", "left_semi") \
        .groupBy("poId").agg(F.sum("qty").alias("totalQty"), F.sum("rcvQty").alias("totalReceived"))
    return page.join(sums, "poId", "left")


def purchase_order_listing(t: Tables, company_id=None, supplier_id=None, ship_dates=(None, None), status=None, search=None,
                           sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    pos = keep_if(t.poHeader, "companyId", company_id)
    if search:
        by_customer_po = _ids(keep_if(t.soHeader, "companyId", company_id).where(contains_text("customerPO", search)), "soName")
        pos = lookup(pos, by_customer_po, {"poReferenceId": "soName"}, _hit="soName") \
            .where(contains_text("poName", search) | contains_text("poReferenceId", search) | F.col("_hit").isNotNull()).drop("_hit")
    else:
        pos = keep_if(keep_if(pos, "supplierId", supplier_id), "poStatus", status)
        pos = between_if(pos, "poEarlyShipDate", *ship_dates)
    pos = code_name(pos, t.md_MasterCategory, "poStatus", "poStatusName")
    suppliers = lookup(t.md_Supplier, t.md_Company, {"internal_branchId": "companyId"}, _short="companyShortCode")
    pos = lookup(pos, suppliers, {"supplierId": "supplierId"}, internal_branchId="internal_branchId",
                 supplierCompanyName=F.coalesce("_short", "supplierCompanyName"))
    rows = pos.select("poId", "poReferenceId", "poName", "internal_branchId", "supplierCompanyName", "customerCode", "poDate",
                      F.col("poEarlyShipDate").alias("shipDate"), "poGrossTotal", "poStatus", "poStatusName")
    sorts = {1: "poReferenceId", 2: "customerCode", 3: "poName", 4: "supplierCompanyName", 5: "poDate", 6: "totalQty",
             7: "totalReceived", 8: "poGrossTotal", 9: "shipDate", 10: "poStatusName"}
    if sort_by in (6, 7):
        return paged_listing(_po_quantities(rows, t), sorts, sort_by, direction, ["poId"], row_start, page_rows)
    return _po_quantities(paged_listing(rows, sorts, sort_by, direction, ["poId"], row_start, page_rows), t)


def loading_request_listing(t: Tables, company_id=None, supplier_id=None, ship_dates=(None, None), status=None, search=None,
                            sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    """One row per request, container and customer with SKU count, quantity and stock."""
    headers = keep_if(t.lrHeader, "lrStatus", status)
    start, end = (F.lit(d).cast("date") if d is not None else None for d in ship_dates)
    if search:
        lines = t.lrLineItem
        orders = keep_if(t.soHeader, "companyId", company_id).where(
            contains_text("soName", search) | contains_text("thirdPartyPO", search)).select("soHeaderId")
        pos = keep_if(t.poHeader, "companyId", company_id).where(contains_text("poName", search)).select("poId")
        own = keep_if(t.lrHeader, "companyId", company_id)
        booked = t.lrContainer.where(contains_text("forwarderBookingNo", search)).join(own, "lrHeaderId", "left_semi")
        hits = (own.where(contains_text("lrName", search)).select("lrHeaderId")
                .unionByName(lines.join(orders, "soHeaderId", "left_semi").select("lrHeaderId"))
                .unionByName(lines.join(pos, "poId", "left_semi").select("lrHeaderId"))
                .unionByName(booked.select("lrHeaderId")))
        headers = headers.join(hits, "lrHeaderId", "left_semi")
        start = F.add_months(start, -12) if start is not None else None
        end = F.add_months(end, 12) if end is not None else None
    else:
        headers = keep_if(headers, "companyId", company_id)
    headers = keep_if(headers, "supplierId", supplier_id)
    headers = code_name(headers, t.md_MasterCategory, "lrStatus", "status", "inner").select("lrHeaderId", "companyId", "lrStatus", "status")

    containers = t.lrContainer.where(F.col("containerStatus") != 2130)
    containers = containers.where(F.col("earlyShipDate") >= start) if start is not None else containers
    containers = containers.where(F.col("lateShipDate") <= end) if end is not None else containers
    containers = code_name(containers, t.md_MasterCategory, "containerTypeId", "containerType", "inner") \
        .select("lrContainerId", "lrHeaderId", "lrName", F.coalesce("forwarderBookingNo", F.lit("")).alias("bookingNo"),
                "earlyShipDate", "lateShipDate", "containerType", "containerSeq").join(headers, "lrHeaderId")
    customers = lookup(t.soHeader, t.md_Customer, {"customerId": "customerId"}, _short="customerShortCode")
    lines = t.lrLineItem.select("lrContainerId", "soHeaderId", "supplierSku", "qty", "itemStatus", "invID").join(containers, "lrContainerId")
    lines = lookup(lines, customers, {"soHeaderId": "soHeaderId"}, soName="soName", customerPO="customerPO",
                   customerName=F.concat("_short", F.when(blank("thirdParty"), "").otherwise(F.concat(F.lit(" /"), "thirdParty"))))
    stock = t.inventoryBalanceWH.groupBy("companyId", "invId").agg(F.sum("balanceQty").alias("qty"))
    lines = lookup(lines, stock, {"companyId": "companyId", "invID": "invId"}, _stock="qty")

    by = ["lrHeaderId", "lrName", "bookingNo", "customerName", "earlyShipDate", "lateShipDate", "containerType", "containerSeq",
          "lrStatus", "status", "itemStatus"]
    # the grouped rows are counted and paged, so they are made once; the lists are made for the page only
    rows = shared_checkpoint(lines.groupBy(*by).agg(F.countDistinct("supplierSku").alias("uniqueSku"), F.sum("qty").alias("totalLrQty"),
                                                    F.sum(F.coalesce("_stock", F.lit(0))).alias("invBalance")))

    def lists(of: DataFrame) -> DataFrame:
        return of.groupBy("lrHeaderId").agg(distinct_list("soName").alias("soName"), distinct_list("customerPO").alias("customerPO"))

    sorts = {1: "lrName", 2: "bookingNo", 3: "customerName", 4: "soName", 5: "customerPO", 6: "earlyShipDate", 7: "containerType",
             8: "containerSeq", 9: "uniqueSku", 10: "totalLrQty"}
    key = ["lrHeaderId", "containerSeq", "customerName", "itemStatus"]
    if sort_by in (4, 5):
        return paged_listing(rows.join(lists(lines), "lrHeaderId"), sorts, sort_by, direction, key, row_start, page_rows)
    page = paged_listing(rows, sorts, sort_by, direction, key, row_start, page_rows)
    return page.join(lists(lines.join(_ids(page, "lrHeaderId"), "lrHeaderId", "left_semi")), "lrHeaderId")


def loading_pending_listing(t: Tables, company_id=None, customer_id=None, ship_dates=(None, None), port=None,
                            row_start=1, page_rows=50) -> DataFrame:
    """Released PO lines with quantity not yet on a loading request."""
    pos = between_if(t.poHeader.where(F.col("poStatus") == 1077), "poEarlyShipDate", ship_dates[0], None)
    ship_to = keep_if(keep_if(t.md_ShipToDestination, "companyId", company_id), "pod", port)
    pos = lookup(pos, ship_to, {"shipToId": "shipToId"}, "inner", pod="pod")
    orders = between_if(keep_if(t.soHeader, "customerId", customer_id), "lateShipDate", None, ship_dates[1])
    pos = lookup(pos, orders, {"poReferenceId": "soName"}, "inner", customerPO="customerPO")
    pos = lookup(pos, t.md_Port, {"pod": "portId"}, "inner", destination="portName")
    lines = t.poLineItem.where((F.col("qty") - F.col("lrQty") > 0) & (F.col("itemStatus") == 1077)) \
        .select("podetailsId", "poId", "invID", "supplierSku", (F.col("qty") - F.col("lrQty")).alias("openLrQty"))
    rows = lines.join(pos.select("poId", "poName", "poLateShipDate", "destination", "customerPO"), "poId") \
        .select("podetailsId", "poName", F.col("poLateShipDate").alias("lateShipDate"), "destination", "customerPO", "supplierSku",
                "openLrQty", "invID")
    return paged_listing(rows, {1: "podetailsId"}, 1, "ASC", ["podetailsId"], row_start, page_rows)


def booking_pending_listing(t: Tables, company_id=None, ship_dates=(None, None), row_start=1, page_rows=50) -> DataFrame:
    """Containers still to be booked or moved, counted per identical booking details."""
    headers = keep_if(t.lrHeader, "companyId", company_id).where(~F.col("lrStatus").isin(2130, 2131))
    headers = code_name(headers, t.md_MasterCategory, "lrStatus", "status").select("lrHeaderId", "status")
    boxes = between_if(t.lrContainer.where(~F.col("containerStatus").isin(2130, 2131)), "earlyShipDate", *ship_dates)
    boxes = code_name(boxes, t.md_MasterCategory, "containerTypeId", "containerType").join(headers, "lrHeaderId")
    first_line = t.lrLineItem.groupBy("lrContainerId").agg(F.min("poId").alias("poId"))
    first_line = lookup(first_line, t.poHeader, {"poId": "poId"}, customerName="customerCode")
    boxes = lookup(boxes, first_line, {"lrContainerId": "lrContainerId"}, customerName="customerName")
    by = ["lrHeaderId", "lrName", "customerName", "earlyShipDate", "containerType", "forwarderId", "forwarderBookingNo",
          "forwarderBookingDate", "ETD", "ETA", "status"]
    rows = boxes.groupBy(*by).agg(F.count("containerSeq").alias("containerCount"))
    return paged_listing(rows, {1: "earlyShipDate"}, 1, "ASC", [c for c in by if c != "earlyShipDate"], row_start, page_rows)


def shipment_listing(t: Tables, company_id=None, customer_id=None, ship_dates=(None, None), search=None, documents_only=False,
                     sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    """Shipments; ``documents_only`` leaves out those whose invoice message has gone out."""
    ships = keep_if(t.shipmentHeader, "companyId", company_id)
    if search:
        ships = ships.where(contains_text("lrName", search) | contains_text("invoiceId", search) | contains_text("soName", search))
    else:
        ships = between_if(keep_if(ships, "customerId", customer_id), "shipmentDate", *ship_dates)
    if documents_only:
        ships = ships.where(F.coalesce("apiStatus", F.lit("")) != "_INV_")
    ships = lookup(ships, t.md_Customer, {"customerId": "customerId"}, "inner", customerName="customerShortCode")
    ships = code_name(ships, t.md_MasterCategory, "shipmentStatus", "shipStatus")
    ships = code_name(ships, t.md_MasterCategory, "containerTypeId", "containerType")
    rows = ships.select("shipmentId", "lrHeaderId", "invoiceId", "customerName", "lrName", F.col("bol").alias("PL"), "shipId", "shipmentDate",
                        "soName", "customerPO", "shipStatus", "pol", "pod", "containerType", "containerNo", "ETD", "shipmentWeight",
                        "bolTotalShipmentWeight", "apiStatus")
    sorts = {1: "customerName", 2: "lrName", 3: "PL", 4: "shipmentDate", 5: "shipStatus", 6: "soName", 7: "customerPO", 8: "pod",
             9: "containerType", 10: "containerNo", 11: "ETD", 12: "invoiceId"}
    return paged_listing(rows, sorts, sort_by, direction, ["shipmentId"], row_start, page_rows)


def shipment_document_listing(t: Tables, **kw) -> DataFrame:
    return shipment_listing(t, documents_only=True, **kw)


def work_order_listing(t: Tables, company_id=None, warehouse_id=None, status=None, search=None, user_id=0,
                       sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    orders = keep_if(t.workOrderHeader, "companyId", company_id)
    if search:
        items = keep_if(t.md_Inventory, "companyId", company_id).where(contains_text("modelNo", search)).select(F.col("invID").alias("invId"))
        lines = t.workOrderLineItem.select("workOrderHeaderId", "invId", "soName")
        hits = lines.join(items, "invId", "left_semi").select("workOrderHeaderId") \
            .unionByName(lines.where(contains_text("soName", search)).select("workOrderHeaderId")).distinct().withColumn("_hit", F.lit(1))
        orders = orders.join(hits, "workOrderHeaderId", "left") \
            .where(contains_text("workOrderName", search) | F.col("_hit").isNotNull()).drop("_hit")
    else:
        orders = keep_if(keep_if(orders, "workOrderStatus", status), "warehouseId", warehouse_id)
    rows = lookup(orders, t.md_Warehouse, {"warehouseId": "warehouseId"}, warehouse="label")
    rows = code_name(rows, t.md_MasterCategory, "workOrderStatus", "statusName")
    rows = lookup(rows, t.md_Customer, {"customerId": "customerId"}, _short="customerShortCode")
    rows = rows.select("workOrderHeaderId", "companyId", "workOrderName", "revision",
                       F.concat("_short", F.when(blank("thirdParty"), "").otherwise(F.concat(F.lit(" /"), "thirdParty"))).alias("customerName"),
                       "workOrderDate", "warehouse", "targetCompleteDate", "shipDate", F.col("statusName").alias("workOrderStatus"))
    sorts = {1: "workOrderName", 3: "workOrderDate", 5: "warehouse", 6: "targetCompleteDate", 7: "shipDate", 10: "workOrderStatus"}
    page = paged_listing(rows, sorts, sort_by, direction, ["workOrderHeaderId"], row_start, page_rows)
    figures = t.workOrderLineItem.join(_ids(page, "workOrderHeaderId"), "workOrderHeaderId", "left_semi").groupBy("workOrderHeaderId") \
        .agg(F.countDistinct("invId").alias("uniqueSkuCount"), F.sum("confirmQty").alias("totalQty"),
             distinct_list("soName", ";\r\n").alias("soName"))
    page = page.join(figures, "workOrderHeaderId", "left") \
        .withColumns({"uniqueSkuCount": F.coalesce("uniqueSkuCount", F.lit(0)), "totalQty": F.coalesce("totalQty", F.lit(0)),
                      "soName": F.coalesce("soName", F.lit(""))})
    return unread_flags(page, t, "workOrderHeaderId", "WorkOrder", user_id, company_id).drop("companyId")


def movement_listing(t: Tables, company_id=None, warehouse_id=None, inv_id=None, action=None, dates=(None, None),
                     sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    moves = keep_if(keep_if(t.inventoryMovement, "companyId", company_id), "warehouseId", warehouse_id)
    moves = keep_if(keep_if(moves, "invId", inv_id), "action", action)
    if dates[0] is not None:
        moves = between_if(moves, "enterDate", dates[0], None)
    if dates[1] is not None:  # the whole last day, as a half-open range the scan can use
        moves = moves.where(F.col("enterDate") < F.date_add(F.lit(dates[1]).cast("date"), 1).cast(moves.schema["enterDate"].dataType))
    moves = lookup(moves, t.md_User, {"enterBy": "userId"}, userName="userName")
    moves = lookup(moves, t.md_Warehouse, {"warehouseId": "warehouseId"}, warehouseLabel="label")
    moves = lookup(moves, t.md_Inventory, {"invId": "invID"}, inventorySku="inventorySKU")
    rows = moves.select("inventoryMovementId", "enterDate", "userName", "action", "actionKey", "reason", "warehouseLabel", "inventorySku", "qty")
    sorts = {1: "enterDate", 2: "action", 3: "warehouseLabel", 4: "inventorySku"}
    return paged_listing(rows, sorts, sort_by, direction, ["inventoryMovementId"], row_start, page_rows)


def _found_items(t: Tables, company_id, term: str, customer_id) -> DataFrame:
    """Items whose category, sub-category, type or text columns hold the term."""
    items = keep_if(t.md_Inventory, "companyId", company_id)
    categories = t.md_InventoryCategory.where(F.col("status") == 1)
    types = t.md_inventoryType.where(F.col("status") == 1)
    found_cat = _ids(categories.where(contains_text("prodCategoryName", term)), "prodCategoryId")
    found_type = _ids(types.where(contains_text("inventoryType", term)), "inventoryTypeId")
    hit = lookup(items, found_cat, {"productCategory": "prodCategoryId"}, _h1="prodCategoryId")
    hit = lookup(hit, found_cat, {"productSubCategory": "prodCategoryId"}, _h2="prodCategoryId")
    hit = lookup(hit, found_type, {"productType": "inventoryTypeId"}, _h3="inventoryTypeId")
    text = F.lit(False)
    for c in ("itemCode", "modelNo", "inventorySKU", "productName", "itemDesc"):
        text = text | F.coalesce(contains_text(c, term), F.lit(False))
    hit = hit.where(F.col("_h1").isNotNull() | F.col("_h2").isNotNull() | F.col("_h3").isNotNull() | text)
    if customer_id:
        skus = t.md_CustomerSku.where((F.col("statusflag") == 1) & (F.col("customerId") == customer_id))
        hit = hit.join(skus, ["invID", "companyId"], "left_semi")
    top = categories.where(F.col("prodCategoryParentID") == 1)
    hit = lookup(hit, top, {"productCategory": "prodCategoryId"}, prodCategory="prodCategoryName")
    hit = lookup(hit, categories, {"productSubCategory": "prodCategoryId", "productCategory": "prodCategoryParentID"},
                 prodSubCategory="prodCategoryName")
    hit = lookup(hit, types, {"productType": "inventoryTypeId", "productSubCategory": "prodCategoryId"}, prodType="inventoryType")
    return hit.select("invID", "itemCode", "prodCategory", "prodSubCategory", "prodType", "modelNo", "inventorySKU", "productName",
                      "itemDesc", F.when(F.col("status") == 1, "ACTIVE").otherwise("INACTIVE").alias("status"), "thumbnailImage")


_ITEM_SORTS = {1: "itemCode", 2: "prodCategory", 3: "prodSubCategory", 4: "prodType", 5: "modelNo", 6: "inventorySKU",
               7: "productName", 8: "itemDesc", 9: "status"}


def item_search(t: Tables, search: str, company_id=None, customer_id=None, sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    rows = _found_items(t, company_id, search, customer_id).drop("thumbnailImage")
    return paged_listing(rows, _ITEM_SORTS, sort_by, direction, ["invID"], row_start, page_rows).drop("totalRecord")


def item_catalog(t: Tables, search: str, company_id=None, customer_id=None, sort_by=1, direction="DESC", row_start=1, page_rows=50) -> DataFrame:
    rows = _found_items(t, company_id, search, customer_id)
    return paged_listing(rows, _ITEM_SORTS, sort_by, direction, ["invID"], row_start, page_rows)
