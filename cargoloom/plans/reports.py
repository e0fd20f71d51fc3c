"""Data sets behind the printed reports, for all documents or a set of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import party_addresses, phone_line
from ..functions.permission import may_add
from ..functions.text import blank, distinct_list
from ..operators.lookup import between_if, code_name, config_value, keep_if, lookup, resolve
from ..operators.ordering import ordinal, removed_rows, shared_checkpoint, shared_rows
from ..sources.tables import Tables
from .views import attribute, container_limits, money, only


def split_list(c: str) -> Column:
    """Trimmed parts of a comma list."""
    return F.transform(F.split(F.col(c), ","), lambda x: F.trim(x))


def list_range(c: str) -> Column:
    """'first - last' of the distinct parts of a comma list, or the only part."""
    parts = F.array_sort(F.array_distinct(split_list(c)))
    return F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(F.array_min(parts), F.lit(" - "), F.array_max(parts)))


def counted_types(df: DataFrame, by: list[str], type_name: str, count: Column, out: str, times: str = " x ") -> DataFrame:
    """Per group: 'n x type & m x type', types ascending."""
    counted = df.where(F.col(type_name).isNotNull()).groupBy(*by, type_name).agg(count.alias("_n"))
    text = F.concat(F.col("_n").cast("string"), F.lit(times), F.col(type_name))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(type_name).alias("t"), text.alias("s"))))
    return counted.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p["s"]), " & ").alias(out))


def sales_order_report(t: Tables, company_id=None, ids: DataFrame | None = None) -> DataFrame:
    """All live order lines with customer, port and SKU; the division shows for non-marketing companies only."""
    orders = only(keep_if(t.soHeader, "companyId", company_id).where(F.col("soStatus") != 1107), ids)
    orders = lookup(orders, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing")
    orders = lookup(orders, t.md_Customer, {"customerId": "customerId"}, customer="customerName")
    orders = lookup(orders, t.md_ShipToDestination, {"shipToId": "shipToId"}, pod=F.upper(F.col("pod").cast("string")))
    lines = t.soLineItem.where(F.col("soLineItemStatus") != 1107).select("soLineItemId", "soHeaderId", "invID", "customerSku", "odrQty", "tagDivision")
    rows = lines.join(orders.select("soHeaderId", "customer", "soName", "customerPO", "soDate", "earlyShipDate", "lateShipDate", "pod", "_marketing"),
                      "soHeaderId")
    rows = lookup(rows, t.md_Inventory, {"invID": "invID"}, inventorySku="inventorySKU")
    rows = code_name(rows, t.md_MasterCategory, "tagDivision", "_division")
    division = F.when((F.col("_marketing") == 0) & (F.col("tagDivision") > 0), F.upper("_division"))
    return rows.select("soLineItemId", "customer", "soName", "customerPO", "soDate", "earlyShipDate", "lateShipDate", "inventorySku", "customerSku",
                       "odrQty", "pod", division.alias("division"))


def sales_order_print_header(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    codes = t.md_MasterCategory
    heads = only(t.soHeader, ids)
    heads = lookup(heads, t.md_ShipToDestination, {"shipToId": "shipToId"}, shipTo=F.upper("shipToLabel"))
    heads = code_name(heads, codes, "shipWay", "_way")
    heads = config_value(heads, t.md_DefaultConfig, "companyId", "CargoReadyDate", "_days")
    billed = t.md_Customer.select(F.col("customerId").alias("_id"),
                                  F.when(F.col("parent_customerId") > 0, F.col("parent_customerId")).otherwise(F.col("customerId")).alias("_billTo"))
    heads = lookup(heads, billed, {"customerId": "_id"}, _billTo="_billTo")
    terms = code_name(t.md_Customer.select("customerId", "paymentTerm"), codes, "paymentTerm", "_term")
    heads = lookup(heads, terms, {"_billTo": "customerId"}, paymentTerm="_term")
    company = party_addresses(t.md_Company, codes, "company", 1).withColumn("_phone", phone_line())
    customer = party_addresses(t.md_Customer, codes, "customer", 2)
    heads = lookup(heads, company, {"companyId": "id"}, "inner", companyName="name", companyAddr1="line1", companyPhone="_phone")
    heads = lookup(heads, customer, {"_billTo": "id"}, "inner", customerName="name", customerAddr1="line1", customerAddr2="line2", contactNumber="phone")
    return heads.select("soHeaderId", "companyName", "companyAddr1", "companyPhone", "soName", "soDate", list_range("customerPO").alias("customerPO"),
                        F.upper("_way").alias("shipWay"), F.col("portOfLanding").alias("shipFrom"), "shipTo",
                        F.date_add("earlyShipDate", F.col("_days").cast("int")).alias("cargoReadyDate"), F.col("earlyShipDate").alias("deliveryDate"),
                        "lastUpdatedDate", "customerName", "customerAddr1", "customerAddr2", "contactNumber", "paymentTerm",
                        F.when(F.col("soStatus").isin(1105, 2144), 1).otherwise(0).alias("isDraft"),
                        F.when(F.col("lastUpdatedDate").isNull(), 0).otherwise(1).alias("isUpdate"))


def sales_order_print_lines(t: Tables, user_id, company_id, menu, ids: DataFrame | None = None) -> DataFrame:
    allowed = may_add(t, user_id, company_id, menu)
    lines = only(t.soLineItem, ids).withColumn("csCost", F.when(allowed == 1, F.col("csCost")).otherwise(0))
    lines = lines.join(t.soHeader.select("soHeaderId", "soNote"), "soHeaderId")
    lines = lookup(lines, t.md_Inventory, {"invID": "invID"}, modelNo="inventorySKU", itemCode="itemCode", _category="productCategory")
    lines = lookup(lines, t.md_InventoryHTSCode, {"_category": "HTSCode_prodCategoryId"}, HTSCode="HTSCode")
    lines = lookup(lines, t.md_InventoryCategory, {"_category": "prodCategoryId"}, prodSubCategory="prodCategoryName")
    lines = attribute(attribute(lines, t, 3194, "color"), t, 1123, "packagingType")
    lines = lines.select("soLineItemId", "soHeaderId", "invID", "customerSku", F.col("itemReference2").alias("EAN"), "merchantSku", "currencyCode", "csCost",
                         "odrQty", "soItemDesc", money(F.col("csCost") * F.col("odrQty")).alias("amount"), "color", "packagingType", "modelNo",
                         "itemCode", "HTSCode", F.col("soNote").alias("soNotes"), "prodSubCategory")
    return ordinal(lines, ["soLineItemId"], within=["soHeaderId"])


def _party_rows(documents: DataFrame, rules: DataFrame, party: str) -> DataFrame:
    """Rules of the document's company for its party, or the company's party-0 rules where the party has none."""
    own = rules.where(F.col("customerId") != 0).select(F.col("companyId").alias("_rc"), F.col("customerId").alias("_rp")).distinct()
    docs = documents.join(own, (F.col("companyId") == F.col("_rc")) & (F.col(party) == F.col("_rp")), "left") \
        .withColumn("_party", F.when(F.col("_rp").isNull(), 0).otherwise(F.col(party))).drop("_rc", "_rp")
    side = rules.withColumnsRenamed({"companyId": "_rc", "customerId": "_rp"})
    return docs.join(side, (F.col("companyId") == F.col("_rc")) & (F.col("_party") == F.col("_rp"))).drop("_rc", "_rp", "_party")


def sales_order_terms(t: Tables, module: str, ids: DataFrame | None = None) -> DataFrame:
    terms = t.md_termNCondition.where((F.col("statusFlag") == 1) & (F.col("module") == module))
    docs = only(t.soHeader, ids).select("soHeaderId", "companyId", "customerId")
    return _party_rows(docs, terms, "customerId").select("soHeaderId", "termRow", "termText")


def sales_order_remarks(t: Tables, module: str, ids: DataFrame | None = None) -> DataFrame:
    """The first tariff code of the order's items, lettered, followed by the remarks that apply."""
    lines = lookup(only(t.soLineItem, ids).select("soHeaderId", "invID"), t.md_Inventory, {"invID": "invID"}, "inner", _cat="productCategory")
    lines = lookup(lines, t.md_InventoryHTSCode, {"_cat": "HTSCode_prodCategoryId"}, "inner", _hts="HTSCode")
    lines = lookup(lines, t.md_InventoryCategory, {"_cat": "prodCategoryId"}, _name="prodCategoryName")
    first = lines.groupBy("soHeaderId").agg(F.min(F.struct("_hts", "_name")).alias("f"))
    letter = F.concat(F.lit("["), F.char(F.lit(65)), F.lit("]"))
    tariff = first.select("soHeaderId", F.lit(1).alias("displaySeq"), F.lit(1).alias("lineNum"),
                          F.concat(letter, F.lit(" "), "f._hts").alias("remarksName"), F.col("f._name").alias("remarks"))
    rules = t.md_reportAdditionalRemarks.where((F.col("statusFlag") == 1) & (F.col("module") == module))
    docs = only(t.soHeader, ids).select("soHeaderId", "companyId", "customerId")
    notes = _party_rows(docs, rules, "customerId").select("soHeaderId", F.lit(2).alias("displaySeq"), "lineNum", "remarksName", "remarks")
    return tariff.unionByName(notes)


# Booking details that identify one booking of a container.
_BOOKING = ["forwarderBookingDate", "forwarderBookingNo", "ETD", "ETA"]


def customer_di_checklist(t: Tables, company_id=None, customers: list | None = None, ship_dates=(None, None)) -> DataFrame:
    """Orders of customers in a ship window with their bookings and container volume.

    An internal customer's order stands for the order it refers to.
    """
    who = keep_if(t.md_Customer, "companyId", company_id)
    who = who if customers is None else who.where(F.col("customerId").isin(customers))
    orders = between_if(keep_if(t.soHeader, "companyId", company_id), "earlyShipDate", *ship_dates)
    orders = lookup(orders, who, {"customerId": "customerId"}, "inner", customer="customerShortCode", _internal="internal_branchId")
    orders = lookup(orders, t.md_Port, {"portOfDestination": "portId"}, destination=F.upper("portName"))
    # orders that refer to none are most of the orders and share the empty reference; they are dealt out by their ids and meet no name
    refers = (F.col("_internal") != 0) & ~blank("reference1")
    orders = orders.withColumn("_apart", F.when(refers, 0).otherwise(F.pmod(F.xxhash64("soHeaderId"), F.lit(4096)) + 1))
    names = t.soHeader.where(~blank("soName")).select("soName", "soHeaderId", F.lit(0).cast("long").alias("_zero"))
    orders = resolve(orders, names, {"reference1": "soName", "_apart": "_zero"}, "soHeaderId", _linked="soHeaderId")
    unnamed = t.soHeader.where(F.col("soName").isNotNull() & blank("soName")).agg(F.min("soHeaderId")).scalar()
    unnamed = F.when((F.col("_internal") != 0) & F.col("reference1").isNotNull() & blank("reference1"), unnamed)
    orders = orders.withColumn("_order", F.coalesce("_linked", unnamed, "soHeaderId")).drop("_apart")
    # Containers are first reduced to one row per request and booking, so an order meets
    # each booking of its requests once instead of every container of them.
    booked = t.lrContainer.groupBy("lrHeaderId", *_BOOKING).agg(F.collect_set("containerSeq").alias("_seqs"))
    carried = t.lrLineItem.select("lrHeaderId", F.col("soHeaderId").alias("_order")).distinct()
    volume = carried.join(booked, "lrHeaderId").groupBy("_order", *_BOOKING) \
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("_seqs")))).alias("volume"))
    return orders.join(volume, "_order", "left").select(
        "soHeaderId", "customer", "customerPO", "thirdPartyPO", "earlyShipDate", "lateShipDate", F.date_sub("earlyShipDate", 2).alias("bookingETD"),
        "destination", "volume", "soName", *_BOOKING, F.col("reference1").alias("customerSoName"))


def purchase_order_print_header(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    codes = t.md_MasterCategory
    heads = lookup(only(t.poHeader, ids), t.md_ShipToDestination, {"shipToId": "shipToId"}, shipTo="shipToLabel")
    heads = code_name(heads, codes, "shipVia", "_way")
    heads = config_value(heads, t.md_DefaultConfig, "companyId", "CargoReadyDate", "_days")
    company = party_addresses(t.md_Company, codes, "company", 1)
    suppliers = code_name(t.md_Supplier, codes, "paymentTerm", "_term")
    supplier = lookup(party_addresses(t.md_Supplier, codes, "supplier", 2), suppliers, {"id": "supplierId"}, _term="_term")
    heads = lookup(heads, company, {"companyId": "id"}, companyName="name", companyAddress="line1", telephoneNumber="phone", faxNumber="fax")
    heads = lookup(heads, supplier, {"supplierId": "id"}, supplierCompanyName="name", supplierAddress1="line1", supplierAddress2="line2",
                   paymentTerm="_term")
    return heads.select("poId", "companyName", "companyAddress", "telephoneNumber", "faxNumber", "supplierCompanyName", "supplierAddress1",
                        "supplierAddress2", "paymentTerm", "poName", "poDate", F.col("poReferenceId").alias("soName"),
                        list_range("reference1").alias("customerPo"), F.col("_way").alias("shipWay"), F.col("portOfLanding").alias("shipFrom"),
                        F.coalesce("shipTo", F.lit("")).alias("shipTo"),
                        F.date_add("poEarlyShipDate", F.col("_days").cast("int")).alias("cargoReadyDate"), F.col("poEarlyShipDate").alias("delivery"))


def purchase_order_print_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    lines = only(t.poLineItem, ids).select("podetailsId", "poId", "soLineItemId", "invID", "supplierSku", "itemReference1", "poItemDesc", "qty", "unitPrice")
    suppliers = code_name(t.md_Supplier, t.md_MasterCategory, "currencyCode", "_currency")
    heads = lookup(t.poHeader.select("poId", "supplierId", "poNote"), suppliers, {"supplierId": "supplierId"}, currency="_currency")
    lines = lines.join(heads.drop("supplierId"), "poId")
    lines = attribute(attribute(lines, t, 3194, "color"), t, 1123, "packaging")
    lines = lines.withColumns({"merchantSku": F.col("itemReference1"), "customerSku": F.col("itemReference1")}).drop("itemReference1", "invID")
    return ordinal(lines, ["soLineItemId", "podetailsId"], within=["poId"], name="itemNo").drop("soLineItemId")


def purchase_order_details(t: Tables, company_id=None, dates=(None, None), supplier_id=None, status=None) -> DataFrame:
    heads = keep_if(keep_if(keep_if(t.poHeader, "companyId", company_id), "supplierId", supplier_id), "poStatus", status)
    heads = between_if(heads, "poDate", *dates)
    suppliers = lookup(t.md_Supplier, t.md_Company, {"internal_branchId": "companyId"}, _short="companyShortCode")
    heads = lookup(heads, suppliers, {"supplierId": "supplierId"}, supplierName=F.coalesce("_short", "supplierCompanyName"))
    heads = lookup(heads, t.md_Company, {"companyId": "companyId"}, companyName="companyName")
    heads = lookup(heads, t.md_ShipToDestination, {"shipToId": "shipToId"}, shipToName="shipToName")
    heads = lookup(heads, t.md_Port, {"portOfDestination": "portId"}, POD="portName")
    heads = code_name(heads, t.md_MasterCategory, "poStatus", "_status")
    window = F.concat(F.col("poEarlyShipDate").cast("string"), F.lit(" - "), F.col("poLateShipDate").cast("string"))
    heads = heads.select("poId", "supplierName", "poName", "poDate", window.alias("shipWindow"), "customerCode", F.col("poReferenceId").alias("soName"),
                         F.col("reference1").alias("customerPo"), "shipToName", F.col("portOfLanding").alias("POL"), "POD",
                         F.col("_status").alias("poStatus"), "poNote", "companyName")
    lines = t.poLineItem.select("podetailsId", "poId", "soLineItemId", "supplierSku", "merchantSku", "poItemDesc", "qty", F.col("itemStatus").alias("_code"))
    if any(x not in (None, 0, "") for x in (company_id, supplier_id, status, *dates)):  # else the join with the headers at the end suffices
        lines = lines.join(heads.select("poId"), "poId", "left_semi")
    lines = code_name(lines, t.md_MasterCategory, "_code", "itemStatus")
    sku_of = t.soLineItem.join(t.soHeader.select("soHeaderId", "customerId"), "soHeaderId")
    skus = lookup(sku_of.select("soLineItemId", "customerId", "invID"), t.md_CustomerSku, {"customerId": "customerId", "invID": "invID"}, EAN="EAN")
    skus = shared_rows(skus.select("soLineItemId", "EAN"))  # the joins of order lines and those of PO lines are not on disk at once
    lines = shared_rows(lookup(lines, skus, {"soLineItemId": "soLineItemId"}, EAN="EAN").drop("soLineItemId", "_code"))  # numbered, then joined
    removed_rows(skus)
    lines = ordinal(lines, ["podetailsId"], within=["poId"], name="lineNum")
    return lines.join(heads, "poId")


def supplier_terms(t: Tables, module: str, ids: DataFrame | None = None) -> DataFrame:
    terms = t.md_SupplierTerm.where((F.col("statusFlag") == 1) & (F.col("module") == module)) \
        .select("companyId", "supplierId", "termRow", "termCondition")
    return only(t.poHeader, ids).select("poId", "companyId", "supplierId").join(terms, ["companyId", "supplierId"]) \
        .select("poId", "termRow", "termCondition")


def container_summary(t: Tables, company_id=None, dates=(None, None)) -> DataFrame:
    """Containers per order and month, with item types and the customer's monthly container total."""
    boxes = between_if(t.lrContainer, "lateShipDate", *dates)
    heads = keep_if(t.lrHeader, "companyId", company_id).join(boxes.select("lrHeaderId"), "lrHeaderId", "left_semi")
    heads = lookup(heads, t.md_Company, {"companyId": "companyId"}, isMarketing="isMarketing")
    all_boxes = code_name(t.lrContainer, t.md_MasterCategory, "containerTypeId", "containerType").select("lrContainerId", "lateShipDate", "containerType")
    lines = t.lrLineItem.select("lrHeaderId", "lrContainerId", "soHeaderId", "invID") \
        .join(heads.select("lrHeaderId", F.col("customerId").alias("_lrCustomer"), "isMarketing"), "lrHeaderId").join(all_boxes, "lrContainerId")
    lines = lookup(lines, lookup(t.md_Inventory, t.md_inventoryType, {"productType": "inventoryTypeId"}, _type="inventoryType"), {"invID": "invID"},
                   inventoryType="_type")
    orders = lookup(t.soHeader, t.md_ShipToDestination, {"shipToId": "shipToId"}, shipTo="shipToLabel")
    orders = resolve(orders, t.poHeader.select("poReferenceId", "poName", "poId"), {"soName": "poReferenceId"}, "poId", _po="poName")
    lines = lookup(lines, orders, {"soHeaderId": "soHeaderId"}, _soCustomer="customerId", soDate="soDate", _customerPo="customerPO", _third="thirdPartyPO",
                   shipTo="shipTo", _po="_po")
    lines = lines.withColumns({
        "customerId": F.when(F.col("_lrCustomer") == 0, F.col("_soCustomer")).otherwise(F.col("_lrCustomer")),
        "thirdPartyPo": F.when(F.col("isMarketing") == 1, F.col("_customerPo")).otherwise(F.col("_third")),
        "customerPo": F.coalesce("_po", "_customerPo"), "rptMonth": F.trunc("lateShipDate", "MM").cast("date")})
    lines = shared_checkpoint(lookup(lines, t.md_Customer, {"customerId": "customerId"}, customer="customerName"))  # read at three grains
    per_order = lines.groupBy("soHeaderId").agg(F.countDistinct("lrContainerId").alias("containerQty"),
                                                distinct_list("inventoryType", ", ").alias("inventoryTypeList"))
    rows = lines.select("soHeaderId", "customerId", "customer", "soDate", "lateShipDate", "customerPo", "thirdPartyPo", "containerType", "shipTo",
                        "rptMonth", "isMarketing").distinct().join(per_order, "soHeaderId")
    monthly = counted_types(rows.select("rptMonth", "customerId", "soHeaderId", "containerType", "containerQty").distinct(),
                            ["rptMonth", "customerId"], "containerType", F.sum("containerQty"), "totalContainer")
    month_name = F.concat(F.upper(F.date_format("rptMonth", "MMM")), F.lit(" "), F.year("rptMonth").cast("string"))
    return rows.join(monthly, ["rptMonth", "customerId"]).withColumn("rptMonthName", month_name).drop("customerId")


def request_print_header(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    company = party_addresses(t.md_Company, t.md_MasterCategory, "company", 1).withColumn("_phone", phone_line())
    return lookup(only(t.lrHeader, ids), company, {"companyId": "id"}, "inner", companyName="name", companyAddress="line1", companyPhone="_phone") \
        .select("lrHeaderId", "lrName", "lrDate", "companyName", "companyAddress", "companyPhone")


def request_print_lines(t: Tables, ids: DataFrame | None = None, carton_customers: Sequence[int] = ()) -> DataFrame:
    """Request lines with document lists per container and per request, type limits and type totals; requests of ``carton_customers`` show carton quantities."""
    boxes = only(t.lrContainer.where(F.col("containerStatus") != 2130), ids)
    boxes = code_name(boxes, t.md_MasterCategory, "containerTypeId", "containerType", "inner")
    limits = container_limits(t)
    boxes = lookup(boxes, limits, {"containerTypeId": "masterCategoryId"}, _cbm="cbm", _weight="weight")

    def number(c: str) -> Column:  # '67 m3', '26500 kg' -> the number
        return F.regexp_extract(c, r"^\s*([0-9.]+)", 1).try_cast("decimal(13,5)")

    no_seal = F.concat(F.coalesce("containerNo", F.lit("")), F.lit(" | "), F.coalesce("containerSealNo", F.lit("")))
    boxes = boxes.withColumns({"boxNo": F.when(blank("containerNo") & blank("containerSealNo"), "").otherwise(no_seal),
                               "containerCbm": F.coalesce(number("_cbm"), F.lit(0)).cast("int"),
                               "containerWeight": F.coalesce(number("_weight"), F.lit(0)).cast("int"),
                               "notes": F.when(~blank("notes"), F.col("notes"))})
    boxes = lookup(boxes, t.md_Port, {"portId": "portId"}, POD="portName")
    totals = counted_types(boxes, ["lrHeaderId"], "containerType", F.count(F.lit(1)), "totalContainer", times="X")
    box_lists = boxes.groupBy("lrHeaderId").agg(distinct_list(F.when(F.col("boxNo") != "", F.col("boxNo")), ", ").alias("summaryContainerNo"),
                                                distinct_list(F.col("containerSeq").cast("string"), ", ").alias("summaryContainerSeq"))

    # Rows are moved once per look-up: the needed columns only, long keys go first, and what a container or request has for all its lines comes last.
    lines = t.lrLineItem.where(F.col("itemStatus") != 2130).select("lrContainerId", "soHeaderId", "poId", "soLineItemId", "invID", "supplierSku", "qty", "qtyPerCarton")
    if ids is not None:
        lines = lines.join(boxes.select("lrContainerId"), "lrContainerId", "left_semi")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, customerSku="customerSku", merchantSku="merchantSku", soItemDesc=F.upper("soItemDesc")).drop("soLineItemId")
    lines = lookup(lines, t.md_Inventory, {"invID": "invID"}, cbm="cbm", grossWeight="grossWeight", netWeight="netWeight").drop("invID")
    lines = lookup(lines, t.poHeader, {"poId": "poId"}, poName="poName").drop("poId")
    orders = lookup(t.soHeader, t.md_ShipToDestination, {"shipToId": "shipToId"}, _label="shipToLabel")
    lines = lookup(lines, orders, {"soHeaderId": "soHeaderId"}, POL="portOfLanding", soName="soName", customerPO="customerPO", thirdPartyPo="thirdPartyPO",
                   shipToLabel="_label", _soCustomer="customerId").drop("soHeaderId")
    lines = shared_rows(lines)  # read at two grains

    # Names are gathered per container; those of a request are the names of its containers.
    named = {"soName": "SoName", "poName": "PoName", "customerPO": "CustomerPO", "thirdPartyPo": "ThirdPartyPo"}
    per_box = lines.groupBy("lrContainerId").agg(*[F.collect_set(c).alias(f"_{n}") for c, n in named.items()], F.min("_soCustomer").alias("_boxCustomer"))
    lists = [F.when(F.size(f"_{n}") > 0, F.array_join(F.sort_array(f"_{n}"), ", ")).alias(f"header{n}") for n in named.values()]
    per_line = boxes.join(per_box, "lrContainerId").select("lrContainerId", "lrHeaderId", "lrName", "containerSeq", "boxNo", "containerType", "containerCbm",
                                                           "containerWeight", "notes", "earlyShipDate", "lateShipDate", "POD", *lists)

    def entries(n: str) -> Column:
        return F.transform(f"_{n}", lambda v: F.struct(F.lit(n).alias("list"), v.alias("name")))

    names = F.flatten(F.array(*[entries(n) for n in named.values()]))
    gathered = boxes.select("lrContainerId", "lrHeaderId").join(per_box, "lrContainerId").select("lrHeaderId", "_boxCustomer", F.explode_outer(names).alias("_n"))
    per_request = gathered.groupBy("lrHeaderId").agg(*[distinct_list(F.when(F.col("_n.list") == n, F.col("_n.name")), ", ").alias(f"summary{n}") for n in named.values()],
                                                     F.min("_boxCustomer").alias("_anyCustomer"))
    heads = lookup(t.lrHeader, t.md_Company, {"companyId": "companyId"}, isMarketing="isMarketing")
    per_request = lookup(per_request, heads, {"lrHeaderId": "lrHeaderId"}, isMarketing="isMarketing", _lrCustomer="customerId")
    per_request = per_request.join(totals, "lrHeaderId", "left").join(box_lists, "lrHeaderId", "left")
    lines = lines.join(per_line, "lrContainerId").join(per_request, "lrHeaderId")
    buyer = F.when(F.col("isMarketing") == 0, F.col("_lrCustomer")).otherwise(F.col("_anyCustomer"))
    lines = lines.withColumn("needCartonMaterial", F.when(buyer.isin(*carton_customers), 1).otherwise(0))
    return lines.select("lrHeaderId", "lrName", "containerSeq", F.col("boxNo").alias("containerNo"), "headerCustomerPO", "headerThirdPartyPo", "headerSoName",
                        "headerPoName", "totalContainer", "notes", "earlyShipDate", "lateShipDate", "POL", "POD", "shipToLabel", "poName", "customerPO",
                        "thirdPartyPo", "supplierSku", "soItemDesc", "customerSku", "merchantSku", "qty", "cbm", "grossWeight", "netWeight", "containerType",
                        "containerCbm", "containerWeight", "soName", F.when(F.col("needCartonMaterial") == 1, F.col("qtyPerCarton")).alias("qtyPerCarton"),
                        "needCartonMaterial", "summarySoName", "summaryPoName", "summaryCustomerPO", "summaryThirdPartyPo", "summaryContainerNo",
                        "summaryContainerSeq", "isMarketing").distinct()


# What identifies one document of each shipping report type.
DOCUMENT_KEYS = {"DO": "bol", "CIPL": "lrHeaderId", "CI": "invoiceId"}


def _documents(t: Tables, report_type: str, ids: DataFrame | None) -> DataFrame:
    """Shipments with the key of the document they are printed on as ``documentKey``."""
    key = DOCUMENT_KEYS[report_type]
    ships = only(t.shipmentHeader, ids).withColumn("documentKey", F.col(key).cast("string"))
    return ships.where(~blank("documentKey"))


def shipping_print_header(t: Tables, report_type: str, ids: DataFrame | None = None) -> DataFrame:
    """Header per delivery order (DO), packing list (CIPL) or commercial invoice (CI)."""
    codes = t.md_MasterCategory
    ships = code_name(_documents(t, report_type, ids), codes, "containerTypeId", "_type")
    per_doc = ships.groupBy("documentKey").agg(F.sum("shipmentWeight").alias("totalShipmentWeight"), F.min("containerTypeId").alias("_typeId"),
                                               F.min("bol").alias("_bol"), F.min("shipmentDate").alias("_date"))
    types = counted_types(ships, ["documentKey"], "_type", F.count(F.lit(1)), "containerType")
    per_doc = per_doc.join(types, "documentKey", "left")
    per_doc = lookup(per_doc, container_limits(t), {"_typeId": "masterCategoryId"}, containerCbm="cbm", containerWeight="weight", dimension="dimension")
    company = lookup(party_addresses(t.md_Company, codes, "company", 1), t.md_CompanyBank.where(F.col("statusFlag") == 1), {"id": "companyId"}, _account="accountNumber")
    customer = party_addresses(t.md_Customer, codes, "customer", 2)
    ships = code_name(code_name(ships, codes, "paymentTermId", "paymentTerm"), codes, "vesselId", "vessel")
    ships = lookup(ships, t.md_haulier, {"haulierId": "haulierId"}, haulier="haulier")
    ships = config_value(ships, t.md_DefaultConfig, "companyId", "DefaultCurrency", "defaultCurrency")
    ships = lookup(ships, company, {"companyId": "id"}, "inner", companyName="name", accountNumber="_account", companyAddress="line1")
    ships = lookup(ships, customer, {"customerId": "id"}, "inner", customerName="name", customerAddress1="line1", customerAddress2="line2",
                   customerContactNumber="phone")
    ships = ships.join(per_doc, "documentKey")
    merged = report_type == "CIPL"
    return ships.select("documentKey", "companyName", "accountNumber", "companyAddress", "customerName", "customerAddress1", "customerAddress2",
                        "customerContactNumber", "invoiceId", F.col("_bol" if merged else "bol").alias("DO"), F.col("lrName").alias("PL"),
                        F.col("_date" if merged else "shipmentDate").alias("shipmentDate"), "invoiceDate", "ETD", "ETA", F.upper("pol").alias("pol"),
                        F.upper("pod").alias("pod"), "vessel", "haulier", "paymentTerm", F.upper("countryOfOrigin").alias("countryOfOrigin"),
                        "defaultCurrency", "containerType", "totalShipmentWeight", "containerCbm", "containerWeight", "dimension").distinct()


def shipping_print_lines(t: Tables, report_type: str, ids: DataFrame | None = None) -> DataFrame:
    """Shipped items per document with document totals; a packing list shows item types only.

    Costs stay on the (item, SKU, description, price) row they were summed on,
    and tax is added to the amount.
    """
    ships = _documents(t, report_type, ids).select("shipmentId", "documentKey")
    lines = t.shipmentLineItem.where(F.col("lineItemStatus") != 2150).select("shipmentId", "soLineItemId", "invId", "customerSku", "shipQty").join(ships, "shipmentId")
    lines = lookup(lines, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", soItemDesc=F.upper("soItemDesc"), csCost="csCost")
    items = lines.groupBy("documentKey", "invId", "customerSku", "soItemDesc", "csCost").agg(F.sum("shipQty").alias("shipQty"))
    items = lookup(items, t.md_Inventory, {"invId": "invID"}, _unit="measurement", _cbm="cbm", _type="productType")
    items = code_name(items, t.md_MasterCategory, "_unit", "measurement")
    items = lookup(items, t.md_inventoryType, {"_type": "inventoryTypeId"}, inventoryType="inventoryType")
    zero = F.lit(0)
    items = items.withColumns({"discount": zero, "tax": zero, "_cost": F.col("shipQty") * F.col("csCost")})
    items = shared_checkpoint(items.withColumn("ttlAmount", F.col("_cost") - F.col("shipQty") * F.col("discount") + F.col("shipQty") * F.col("tax")))
    totals = items.groupBy("documentKey").agg(
        F.sum("shipQty").alias("ttlShipQty"), F.min("measurement").alias("measurement"), F.sum(F.col("shipQty") * F.col("_cbm")).alias("totalShipmentCbm"),
        F.sum("_cost").alias("invCost"), F.sum(F.col("shipQty") * F.col("discount")).alias("invDiscount"), F.sum(F.col("shipQty") * F.col("tax")).alias("invTax"),
        F.sum("ttlAmount").alias("invAmount"))
    if report_type == "CIPL":
        rows = ordinal(items.select("documentKey", "inventoryType").distinct(), ["inventoryType"], within=["documentKey"])
    else:
        rows = items.select("documentKey", "invId", "customerSku", "soItemDesc", "shipQty", "csCost", "discount", "tax", "ttlAmount")
        rows = ordinal(rows, ["customerSku", "invId", "soItemDesc", "csCost"], within=["documentKey"])
    return rows.join(totals, "documentKey")


def invoice_summary(t: Tables, company_id=None, customers: list | None = None, month_start=None, supplier_prefix: str = "SUP-") -> DataFrame:
    """Invoiced shipments (of one month when given) with the supplier-side mirror invoice of marketing companies, numbered with ``supplier_prefix``."""
    ships = keep_if(t.shipmentHeader, "companyId", company_id)
    if month_start is not None:  # half-open range, so the scan can skip files
        first = F.trunc(F.lit(month_start).cast("date"), "MM")
        ships = ships.where((F.col("invoiceDate") >= first) & (F.col("invoiceDate") < F.add_months(first, 1)))
    who = t.md_Customer if customers is None else t.md_Customer.where(F.col("customerId").isin(customers))
    ships = lookup(ships, who, {"customerId": "customerId"}, "left" if customers is None else "inner", customerName="customerName")
    ships = lookup(ships, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing")
    types = t.md_MasterCategory.where((F.col("categoryParentID") == 3153) & (F.col("status") == 1))
    ships = code_name(ships, types, "containerTypeId", "containerType")
    ships = resolve(ships, t.poHeader.select("poReferenceId", "poId", "supplierId", "poName", "homeCurrencyCode", "foreignCurrencyCode"),
                    {"soName": "poReferenceId"}, "poId", _supplier="supplierId", poName="poName", currency="homeCurrencyCode", _foreign="foreignCurrencyCode")
    branches = lookup(t.md_Supplier, t.md_Company, {"internal_branchId": "companyId"}, "inner", _short="companyShortCode")
    ships = lookup(ships, branches, {"_supplier": "supplierId"}, supplierName="_short")
    shipped = t.shipmentLineItem.groupBy("shipmentId").agg(F.sum("shipQty").alias("totalShipQty"))
    ships = ships.join(shipped, "shipmentId")
    mirrors = t.lrHeader.where(F.col("ref_customerLrHeaderId").isNotNull()).select(F.col("ref_customerLrHeaderId").alias("_ref"), F.lit(1).alias("_mirror"))
    ships = ships.join(mirrors, F.col("lrHeaderId") == F.col("_ref"), "left")
    mirrored = (F.col("_mirror") == 1) & (F.col("_marketing") == 1)

    def mirror(c) -> Column:
        return F.when(mirrored, c)

    return ships.select("shipmentId", "customerName", "shipId", "invoiceId", F.concat("customerPO", F.coalesce("customerInvoiceNo", F.lit(""))).alias("csInvNPoNo"),
                        F.coalesce("customerInvoiceNo", F.lit("")).alias("customerInvoiceNo"), "invoiceDate", "customerPO", "poName", "pol", "pod", "ETA", "ETD",
                        F.lit("FOB").alias("tradeTerm"), "containerSeqNo", "containerType", "totalShipQty", F.lit("PCS").alias("UOM"), "currency",
                        F.col("InvoiceAmount").alias("invoiceAmount"), "supplierName", mirror(F.concat(F.lit(supplier_prefix), "invoiceId")).alias("supplierInvoiceId"),
                        mirror(F.col("invoiceDate")).alias("supplierInvoiceDate"), mirror(F.col("totalShipQty")).alias("supplierTotalShipQty"),
                        mirror(F.lit("PCS")).alias("supplierUOM"), mirror(F.col("_foreign")).alias("supplierCurrency"),
                        mirror(F.col("InvoiceAmount")).alias("supplierInvoiceAmount"))


def logistic_containers(t: Tables, company_id=None, report_date=None) -> DataFrame:
    """Shipped containers of a month (of every month when no date is given), numbered per month."""
    ships = keep_if(t.shipmentHeader, "companyId", company_id)
    if report_date is not None:
        first = F.trunc(F.lit(report_date).cast("date"), "MM")
        ships = ships.where((F.col("shipmentDate") >= first) & (F.col("shipmentDate") < F.add_months(first, 1)))
    ships = lookup(ships, t.md_haulier.where(F.col("statusFlag") == 1), {"haulierId": "haulierId"}, _haulier="haulier")
    types = t.md_MasterCategory.where((F.col("categoryParentID") == 3153) & (F.col("status") == 1))
    ships = code_name(ships, types, "containerTypeId", "containerType")
    boxes = t.lrContainer.select("lrContainerId", "lrHeaderId", F.col("containerSeq").alias("containerSeqNo"),
                                 F.concat(F.date_format("earlyShipDate", "MM/dd"), F.lit(" - "), F.date_format("lateShipDate", "MM/dd")).alias("shippingWindow"))
    # Shipments of a container are reduced to their distinct printed rows before they meet the container's orders.
    printed = ships.select("lrHeaderId", "forwarderBookingNo", "containerSeqNo", F.col("pod").alias("destination"), "containerNo", "containerSealNo",
                           "shipmentDate", "containerPullOutDate", F.upper("_haulier").alias("haulier"), "containerType").distinct()
    orders = t.lrLineItem.select("lrContainerId", "soHeaderId").distinct().join(t.soHeader.select("soHeaderId", "soName"), "soHeaderId") \
        .select("lrContainerId", "soName").distinct()
    rows = printed.join(boxes, ["lrHeaderId", "containerSeqNo"]).join(orders, "lrContainerId").drop("lrContainerId") \
        .withColumn("rptMonth", F.trunc("shipmentDate", "MM").cast("date")).distinct()
    order = ["shipmentDate", "lrHeaderId", "containerSeqNo", "soName", "forwarderBookingNo", "destination", "containerNo", "containerSealNo",
             "containerPullOutDate", "haulier", "containerType"]
    rows = ordinal(rows, order, within=["rptMonth"])
    return rows.withColumn("monthName", F.date_format("rptMonth", "MMM-yy")).drop("rptMonth")


def work_order_print(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Header rows (OH) and line rows (OL) of work orders with quantities at three grains and container totals."""
    codes = t.md_MasterCategory
    heads = only(t.workOrderHeader, ids)
    heads = lookup(heads, t.md_Warehouse, {"warehouseId": "warehouseId"}, warehouse=F.when(blank("locNo"), F.col("label")).otherwise(F.col("locNo")))
    company = party_addresses(t.md_Company, codes, "company", 1).withColumn("_phone", phone_line())
    heads = lookup(heads, company, {"companyId": "id"}, "inner", companyName="name", companyAddress="line1", companyPhone="_phone")
    orders = lookup(t.soHeader, t.md_Customer, {"customerId": "customerId"}, _customer="customerName")
    orders = lookup(orders, t.md_Port, {"portOfDestination": "portId"}, _pod="portName")
    raw = t.workOrderLineItem.select("workOrderHeaderId", "soHeaderId", "soLineItemId", "invId", "confirmQty")
    if ids is not None:
        raw = raw.join(heads.select("workOrderHeaderId"), "workOrderHeaderId", "left_semi")
    raw = lookup(raw, orders, {"soHeaderId": "soHeaderId"}, soName="soName", customerPo="customerPO", thirdPartyPo="thirdPartyPO", POD="_pod", _customer="_customer")
    raw = shared_rows(raw)  # read for buyers and lines
    buyers = shared_rows(raw.select("workOrderHeaderId", F.col("_customer").alias("headerCustomerName")).distinct())
    lines = lookup(raw, t.soLineItem, {"soLineItemId": "soLineItemId"}, "inner", customerSku="customerSku", merchantSku="merchantSku",
                   customerModelNo="itemReference1", EAN="itemReference2", itemDesc="soItemDesc")
    items = lines.groupBy("workOrderHeaderId", "soName", "customerPo", "POD", "thirdPartyPo", "invId", "customerSku", "merchantSku", "customerModelNo",
                          "EAN", "itemDesc").agg(F.sum("confirmQty").alias("totalQty"))
    items = shared_rows(items)  # read at four grains
    removed_rows(raw)
    per_order = items.groupBy("workOrderHeaderId").agg(F.sum("totalQty").alias("sumQty"))

    # '2x40HQ + 1x20GP' -> (2, 40HQ), (1, 20GP), kept where the type is a known container type.
    pattern = F.lit(r"([0-9]+)\s*x\s*([0-9A-Za-z]+)")
    notes = t.poHeader.where(~blank("poNote")).select("poName", F.explode(F.arrays_zip(
        F.regexp_extract_all("poNote", pattern, 1).alias("q"), F.regexp_extract_all("poNote", pattern, 2).alias("t"))).alias("m"))
    types = codes.where(F.col("categoryParentID") == 3153).select(F.replace("categoryName", F.lit(" "), F.lit("")).alias("containerType")).distinct()
    notes = notes.select("poName", F.col("m.q").cast("int").alias("_q"), F.col("m.t").alias("containerType")).join(types, "containerType")
    asked = items.where(F.col("invId").isNotNull()).select("workOrderHeaderId", F.col("customerPo").alias("poName")).distinct().join(notes, "poName")
    asked = asked.withColumn("containerType", F.concat(F.left("containerType", F.lit(2)), F.lit("'"), F.expr("substring(containerType, 3)")))
    totals = counted_types(asked, ["workOrderHeaderId"], "containerType", F.sum("_q"), "totalContainer")

    # What an item or its work order has is put together per item, so that the wide rows are moved once.
    printed = heads.select("workOrderHeaderId").distinct().join(totals, "workOrderHeaderId", "left")
    per_item = items.groupBy("workOrderHeaderId", "invId").agg(F.sum("totalQty").alias("sumQty")).join(printed, "workOrderHeaderId")
    per_item = lookup(per_item, t.md_Inventory, {"invId": "invID"}, modelNo="inventorySKU")
    per_item = shared_rows(attribute(per_item, t, 3194, "color", item="invId"))  # numbered, then joined
    models = ordinal(per_item.select("workOrderHeaderId", "modelNo").distinct(), ["modelNo"], within=["workOrderHeaderId"])
    per_item = per_item.join(models, ["workOrderHeaderId", "modelNo"], "left")
    items = items.join(per_item, ["workOrderHeaderId", "invId"])

    head_rows = heads.join(buyers, "workOrderHeaderId").join(per_order, "workOrderHeaderId", "left").join(totals, "workOrderHeaderId", "left").select(
        F.lit("OH").alias("recordType"), "workOrderHeaderId", "companyName", "companyAddress", "companyPhone", "workOrderName", "warehouse",
        "headerCustomerName", F.col("thirdParty").alias("headerThirdParty"), "workOrderDate", F.date_sub("shipDate", 8).alias("earlyShipDate"),
        "targetCompleteDate", "shipDate", "sumQty", "totalContainer", "revision")
    line_rows = items.select(
        F.lit("OL").alias("recordType"), "workOrderHeaderId", "rowNo", "modelNo", "EAN", "merchantSku", "customerModelNo", "itemDesc", "color", "soName",
        "customerPo", "POD", "thirdPartyPo", "totalQty", "sumQty", F.coalesce("totalContainer", F.lit("")).alias("totalContainer"))
    return head_rows.unionByName(line_rows, allowMissingColumns=True)


def work_order_report(t: Tables, company_id=None, statuses: list[int] | None = None, dates=(None, None)) -> DataFrame:
    """Work orders of the listed statuses with line details; packing comes from the buyer's PO item."""
    heads = between_if(keep_if(t.workOrderHeader, "companyId", company_id), "workOrderDate", *dates)
    heads = heads if statuses is None else heads.where(F.col("workOrderStatus").isin(statuses))
    heads = lookup(heads, t.md_Customer, {"customerId": "customerId"}, customerName="customerName")
    heads = code_name(heads, t.md_MasterCategory, "workOrderStatus", "_status")
    heads = lookup(heads, t.md_Warehouse, {"warehouseId": "warehouseId"}, warehouse=F.when(blank("locNo"), F.col("label")).otherwise(F.col("locNo")))
    lines = t.workOrderLineItem.select("workOrderLineItemId", "workOrderHeaderId", "soHeaderId", "soName", "soLineItemId", "invId", "confirmQty",
                                       F.col("workOrderItemStatus").alias("_code"))
    bought = lookup(t.soLineItem, t.poLineItem, {"ref_poLineItemId": "podetailsId"}, _poItem="invID")
    lines = lookup(lines, bought, {"soLineItemId": "soLineItemId"}, "inner", customerSku="customerSku", merchantSku="merchantSku", EAN="itemReference2",
                   customerModelNo="itemReference1", itemDesc="soItemDesc", _poItem="_poItem")
    lines = lookup(lines, t.md_Inventory, {"invId": "invID"}, modelNo="inventorySKU")
    orders = lookup(t.soHeader, t.md_Port, {"portOfDestination": "portId"}, _pod="portName")
    lines = lookup(lines, orders, {"soHeaderId": "soHeaderId"}, customerPo="customerPO", thirdPartyPo="thirdPartyPO", POD="_pod")
    lines = attribute(attribute(lines, t, 3194, "color", item="invId"), t, 1123, "packaging", item="_poItem")
    lines = code_name(lines, t.md_MasterCategory, "_code", "workOrderItemStatus")
    heads = heads.select("workOrderHeaderId", "workOrderName", "workOrderDate", F.date_sub("shipDate", 8).alias("cargoReadyDate"),
                         F.col("shipDate").alias("deliveryDate"), "targetCompleteDate", "customerName", "warehouse", F.col("_status").alias("workOrderStatus"))
    return heads.join(lines, "workOrderHeaderId").select(
        "workOrderLineItemId", "workOrderName", "workOrderDate", "cargoReadyDate", "deliveryDate", "targetCompleteDate", "customerName", "warehouse",
        "workOrderStatus", "soName", "customerPo", "POD", "thirdPartyPo", "modelNo", "customerSku", "EAN", "customerModelNo", "merchantSku", "itemDesc",
        "color", "packaging", "confirmQty", "workOrderItemStatus")
