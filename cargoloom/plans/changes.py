"""Change sets for master data and document lines: one rule set per table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ATTRIBUTE_PLACEHOLDERS, product_name
from ..functions.numbering import allocate_codes
from ..functions.text import blank, number_or_null, text_key
from ..operators.changes import ADD, DELETE, UPDATE, Applied, ChangeSpec, action_is, apply_changes
from ..operators.lookup import lookup
from ..operators.ordering import Falling, removed_rows, running_max, shared_rows
from ..operators.validate import Rule, differs, flag_groups, validate
from ..sources.tables import Tables
from .conversions import _with_totals, add_qty
from .transitions import LR, PO, SO, UNTAGGED


def _have(df: DataFrame, sets: dict) -> dict:
    have = {c.lower() for c in df.columns}
    return {k: v for k, v in sets.items() if k.lower() in have}


class Parties(NamedTuple):
    customers: DataFrame
    suppliers: DataFrame


def company_to_parties(t: Tables, companies: DataFrame) -> Parties:
    """Company fields copied to every customer and supplier row that stands for the company."""
    facts = t.md_Company.join(companies, "companyId", "left_semi").select(F.col("companyId").alias("_b"), *[F.col(c).alias(f"_{c}") for c in (
        "companyName", "companyShortCode", "address", "addressLine2", "city", "state", "postcode", "country", "telephoneNumber")])

    def copy(table: DataFrame, prefix: str, name: str, extra: dict) -> DataFrame:
        sets = {name: "_companyName", f"{prefix}Address": "_address", f"{prefix}AddressLine2": "_addressLine2", f"{prefix}City": "_city", f"{prefix}States": "_state",
                f"{prefix}Postcode": "_postcode", f"{prefix}Country": "_country", f"{prefix}ContactNumber": "_telephoneNumber", **extra}
        joined = table.join(facts, F.col("internal_branchId") == F.col("_b"))
        return joined.withColumns(_have(table, {k: F.col(v) for k, v in sets.items()})).select(*table.columns)

    return Parties(copy(t.md_Customer, "customer", "customerName", {"customerShortCode": "_companyShortCode"}), copy(t.md_Supplier, "supplier", "supplierCompanyName", {}))


def change_ports(t: Tables, changes: DataFrame) -> Applied:
    return apply_changes(t.md_Port, changes, ChangeSpec("portId", ("portType", "portName"), ("portType", "portName"), ("portType", "portName"), False, "statusFlag"))


class Rates(NamedTuple):
    added: DataFrame
    changed: DataFrame
    po_headers: DataFrame


def change_currency_rates(t: Tables, changes: DataFrame) -> Rates:
    """Each new rate updates the newest rate of its company and pair that still runs at its start, or is added; draft POs take the rate."""
    pair = ["companyId", "homeCurrency", "foreignCurrency"]
    columns = ["changeId", *pair, "startDate", "endDate", "foreignRate"]
    # Rates at their end and changes at their start are laid out from late to early per pair;
    # the highest rate id so far is then the newest rate still running at the change's start.
    asked = changes.select(*pair, F.col("startDate").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_id"), F.struct(*columns).alias("_change"))
    known = t.md_CurrencyRate.select(*pair, F.col("endDate").alias("_at"), F.lit(0).alias("_side"), F.col("rateId").cast("int").alias("_id"),
                                     F.lit(None).cast(asked.schema["_change"].dataType).alias("_change"))
    laid = running_max(known.unionByName(asked), [Falling("_at"), "_side", "_id", F.col("_change.changeId")], pair, rateId=F.col("_id"))
    newest = laid.where(F.col("_side") == 1).select("_change.*", "rateId")
    added = newest.where(F.col("rateId").isNull()).drop("rateId").withColumn("status", F.lit(1))
    last = newest.where(F.col("rateId").isNotNull()).groupBy(F.col("rateId").alias("_id")).agg(
        F.max_by(F.struct(F.col("startDate").alias("s"), F.col("endDate").alias("e"), F.col("foreignRate").alias("r")), "changeId").alias("n"))
    changed = t.md_CurrencyRate.join(last, F.col("rateId") == F.col("_id")).withColumns({"startDate": F.col("n.s"), "endDate": F.col("n.e"), "foreignRate": F.col("n.r")}).select(*t.md_CurrencyRate.columns)
    rate = changes.groupBy(*[F.col(c).alias(f"_{c}") for c in pair]).agg(F.max_by("foreignRate", "changeId").alias("_rate"))
    pos = t.poHeader.where(F.col("poStatus") == PO["draft"]).join(rate, (F.col("companyId") == F.col("_companyId")) & (F.col("homeCurrencyCode") == F.col("_homeCurrency"))
                                                                  & (F.col("foreignCurrencyCode") == F.col("_foreignCurrency"))) \
        .withColumn("foreignCurrencyRate", F.col("_rate")).select(*t.poHeader.columns)
    return Rates(added, changed, pos)


# Ship-to columns and the warehouse columns they copy for internal places.
_PLACE = {"shipToLabel": "label", "shipToAddressLine1": "address", "shipToCity": "city", "shipToPostCode": "postcode", "country": "countryId"}


def change_ship_tos(t: Tables, changes: DataFrame) -> Applied:
    """Location unique per customer; an internal place takes its address from the warehouse."""
    houses = t.md_Warehouse.where(F.col("status").cast("int") == 1)
    rows = lookup(changes, houses, {"warehouseId": "warehouseId"}, **{f"_w_{k}": v for k, v in _PLACE.items()}, _house="warehouseId")
    internal = F.coalesce("warehouseId", F.lit(0)) != 0
    rows = rows.withColumns({k: F.when(internal, F.col(f"_w_{k}")).otherwise(F.col(k)) for k in _PLACE})
    spec = ChangeSpec("shipToId", ("companyId", "customerId", "warehouseId", "locNo", "shipToName", "pod", *_PLACE), ("locNo", "shipToName"), ("locNo", "customerId", "companyId"))
    return apply_changes(t.md_ShipToDestination, rows, spec, [
        Rule("Warehouse {} is not set up", action_is(ADD, UPDATE) & internal & F.col("_house").isNull(), F.col("warehouseId")),
        Rule("An external place needs its address", action_is(ADD, UPDATE) & ~internal & (blank("shipToAddressLine1") | blank("shipToCity") | blank("shipToPostCode")))])


def change_customer_skus(t: Tables, changes: DataFrame) -> Applied:
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = lookup(changes, items, {"invID": "invID"}, _itemDesc="itemDesc", _itemName="productName")
    fallback = F.when(blank("_itemDesc"), F.col("_itemName")).otherwise(F.col("_itemDesc"))
    rows = rows.withColumn("itemDesc", F.when(blank("itemDesc"), fallback).otherwise(F.col("itemDesc")))
    spec = ChangeSpec("customerskuId", ("invID", "customerId", "companyId", "customerSku", "merchantSKU", "EAN", "itemDesc", "currencyCode", "csCost", "tagDivision"),
                      ("customerSku", "merchantSKU"), ("customerSku", "merchantSKU", "customerId", "companyId"), True, "statusflag")
    carton = [Rule("Quantity per carton is needed for carton material {}", action_is(ADD, UPDATE) & (F.coalesce("cartonMaterial", F.lit(0)) != 0) & (F.coalesce("qtyPerCarton", F.lit(0)) <= 0),
                   F.col("cartonMaterial"))] if "cartonMaterial" in changes.columns else []
    return apply_changes(t.md_CustomerSku, rows, spec, carton)


def change_supplier_skus(t: Tables, changes: DataFrame) -> Applied:
    rows = lookup(changes, t.md_Supplier, {"supplierId": "supplierId"}, _own="currencyCode")
    spec = ChangeSpec("supplierskuId", ("invId", "supplierId", "companyId", "supplierSku", "itemDesc", "currencyCode", "supCost", "moq", "isDefault"), ("supplierSku",),
                      ("supplierSku", "supplierId", "invId", "companyId"), False, "statusflag")
    return apply_changes(t.md_SupplierSku, rows, spec, [
        Rule("Supplier {} has no currency", F.col("_own").isNull(), F.col("supplierId")), Rule("Currency {} differs from the supplier's", F.col("_own") != F.col("currencyCode"), F.col("currencyCode"))])


class Categories(NamedTuple):
    added: DataFrame
    changed: DataFrame
    types: DataFrame
    items: DataFrame
    errors: DataFrame


def change_categories(t: Tables, changes: DataFrame) -> Categories:
    """Top categories: unique name; a factory's addition gets the next free code; deletion takes sub-categories and their types along."""
    rows = changes.withColumns({"prodCategoryName": F.upper("prodCategoryName"), "prodCategoryParentID": F.lit(1)})
    top = t.md_InventoryCategory.where(F.col("prodCategoryParentID") == 1)
    done = apply_changes(top, rows, ChangeSpec("prodCategoryId", ("companyId", "prodCategoryName", "prodCategoryCode", "prodCategoryParentID"), ("prodCategoryName",),
                                               ("prodCategoryName", "companyId"), True, "status"))
    added = lookup(done.added, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing")
    coded = added.where(F.col("_marketing") != 0)
    used = top.select(F.concat(F.lit("0."), "prodCategoryCode").alias("code"))
    free = allocate_codes(added.where(F.col("_marketing") == 0).withColumn("_p", F.lit("0")).withColumnRenamed("_p", "_prefix"), used, "code", "_prefix", ["changeId"], 3)
    free = free.withColumn("prodCategoryCode", F.substring_index("newCode", ".", -1)).select(*coded.columns)
    gone = done.changed.where(F.col("status") == 0).select(F.col("prodCategoryId").alias("prodCategoryParentID")).distinct()
    subs = t.md_InventoryCategory.join(gone, "prodCategoryParentID", "left_semi").withColumn("status", F.lit(0)).select(*t.md_InventoryCategory.columns)
    types = t.md_inventoryType.join(subs.select("prodCategoryId").distinct(), "prodCategoryId", "left_semi").withColumn("status", F.lit(0)).select(*t.md_inventoryType.columns)
    return Categories(coded.unionByName(free).drop("_marketing"), done.changed.unionByName(subs), types, t.md_Inventory.limit(0), done.errors)


def change_sub_categories(t: Tables, changes: DataFrame) -> Categories:
    """Sub-categories: unique name below the parent; a factory's addition without code gets ``parent.nnn``; the buffer flag goes down to the items."""
    rows = changes.withColumn("prodCategoryName", F.upper("prodCategoryName"))
    subs = t.md_InventoryCategory.where(F.col("prodCategoryParentID") != 1)
    done = apply_changes(subs, rows, ChangeSpec("prodCategoryId", ("companyId", "prodCategoryName", "prodCategoryCode", "prodCategoryParentID", "isBuffer"), ("prodCategoryName",),
                                                ("prodCategoryName", "companyId", "prodCategoryParentID"), True, "status"),
                         [Rule("A parent category is required", action_is(ADD) & (F.coalesce("prodCategoryParentID", F.lit(0)) == 0))])
    added = lookup(lookup(done.added, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing"),
                   t.md_InventoryCategory.where(F.col("prodCategoryParentID") == 1), {"prodCategoryParentID": "prodCategoryId"}, _prefix="prodCategoryCode")
    needs = (F.col("_marketing") == 0) & blank("prodCategoryCode")
    used = t.md_InventoryCategory.select("prodCategoryCode").unionByName(added.where(~blank("prodCategoryCode")).select("prodCategoryCode"))
    free = allocate_codes(added.where(needs), used, "prodCategoryCode", "_prefix", ["changeId"], 3)
    free = free.withColumn("prodCategoryCode", F.col("newCode")).drop("newCode")
    flags = done.changed.where(F.col("status") == 1).select(F.col("prodCategoryId").alias("productSubCategory"), F.col("isBuffer").alias("_buffer")).distinct()
    items = t.md_Inventory.join(flags, "productSubCategory").where(F.col("isBuffer") != F.col("_buffer")).withColumn("isBuffer", F.col("_buffer")).select(*t.md_Inventory.columns)
    return Categories(added.where(~needs).unionByName(free).drop("_marketing", "_prefix"), done.changed, t.md_inventoryType.limit(0), items, done.errors)


def _name_values(t: Tables, attributes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Placeholder values per item from its attribute rows (invID, categoryId, value)."""
    marks = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in ATTRIBUTE_PLACEHOLDERS.items()]))
    named = lookup(attributes, t.md_MasterCategory, {"categoryId": "categoryId"}, "inner", _name="categoryName").withColumn("_mark", F.element_at(marks, F.upper("_name")))
    names = list(dict.fromkeys(ATTRIBUTE_PLACEHOLDERS.values()))
    return named.groupBy(F.col("invID").alias("_i")).agg(*[F.max(F.when(F.col("_mark") == m, F.upper("value"))).alias(f"_a_{m}") for m in names]), names


def named_items(t: Tables, items: DataFrame, attributes: DataFrame) -> DataFrame:
    """Items with the product name their type's template gives; items of types without template keep theirs."""
    values, names = _name_values(t, attributes)
    rows = items.join(values, F.col("invID") == F.col("_i"), "left").drop("_i")
    rows = lookup(rows, t.md_inventoryType, {"productType": "inventoryTypeId"}, _template="namingConvention", _type="inventoryType")
    parts = {m: F.col(f"_a_{m}") for m in names} | {"modelno": F.upper("modelNo"), "inventorytype": F.upper("_type")}
    parts |= {k.lower(): F.col(k) for k in ("netLength", "netWidth", "netHeight") if k in items.columns}
    return rows.withColumn("productName", F.when(blank("_template"), F.col("productName")).otherwise(product_name(F.col("_template"), parts))).select(*items.columns)


def change_products(t: Tables, changes: DataFrame) -> Applied:
    """Items: category, sub-category, type and unit must exist, weights must be numbers; added items get a code, all get their name."""
    categories = t.md_InventoryCategory.where(F.col("status") == 1)
    rows = lookup(changes, categories.where(F.col("prodCategoryParentID") == 1), {"productCategory": "prodCategoryId"}, _cat="prodCategoryId")
    rows = lookup(rows, categories, {"productSubCategory": "prodCategoryId", "productCategory": "prodCategoryParentID"}, _sub="prodCategoryId", _prefix="prodCategoryCode")
    rows = lookup(rows, t.md_inventoryType.where(F.col("status") == 1), {"productType": "inventoryTypeId"}, _type="inventoryTypeId")
    rows = lookup(rows, t.md_MasterCategory.where(F.col("categoryParentID") == 1069), {"measurement": "categoryId"}, _unit="categoryId")
    rows = rows.withColumns({"_grossText": F.col("grossWeight").cast("string"), "_netText": F.col("netWeight").cast("string"),
                             "grossWeight": number_or_null("grossWeight").cast("bigint"), "netWeight": number_or_null("netWeight").cast("bigint")})
    edit = action_is(ADD, UPDATE)
    spec = ChangeSpec("invID", ("companyId", "itemCode", "productCategory", "productSubCategory", "productType", "modelNo", "inventorySKU", "productName", "itemDesc", "grossWeight", "netWeight",
                                "measurement"), ("inventorySKU", "modelNo"), status="status")
    done = apply_changes(t.md_Inventory, rows, spec, [
        Rule("Category {} is not set up", edit & F.col("_cat").isNull(), F.col("productCategory")), Rule("Sub-category {} is not set up", edit & F.col("_sub").isNull(), F.col("productSubCategory")),
        Rule("Type {} is not set up", edit & F.col("_type").isNull(), F.col("productType")), Rule("Unit {} is not set up", edit & F.col("_unit").isNull(), F.col("measurement")),
        Rule("Gross weight {} is not a number", edit & F.col("grossWeight").isNull(), F.col("_grossText")), Rule("Net weight {} is not a number", edit & F.col("netWeight").isNull(), F.col("_netText"))])
    added = lookup(done.added, categories, {"productSubCategory": "prodCategoryId"}, _prefix="prodCategoryCode")
    blank_code = added.where(blank("itemCode"))
    used = t.md_Inventory.select("itemCode").unionByName(added.where(~blank("itemCode")).select("itemCode"))
    coded = allocate_codes(blank_code, used, "itemCode", "_prefix", ["changeId"], 4).withColumn("itemCode", F.col("newCode")).drop("newCode")
    added = added.where(~blank("itemCode")).unionByName(coded).drop("_prefix")
    named = lookup(added, t.md_inventoryType, {"productType": "inventoryTypeId"}, _template="namingConvention", _tname="inventoryType")
    named = named.withColumn("productName", F.when(blank("_template"), F.col("productName")).otherwise(
        product_name(F.col("_template"), {"modelno": F.upper("modelNo"), "inventorytype": F.upper("_tname")}))).drop("_template", "_tname")
    return Applied(named, named_items(t, done.changed, t.inventory_attributes), done.deleted, done.errors)


class Attributes(NamedTuple):
    attributes: Applied
    items: DataFrame


def change_product_attributes(t: Tables, changes: DataFrame) -> Attributes:
    """Attribute rows added, changed or removed; the names of their items are made again from the rows that result."""
    known = t.md_MasterCategory.where(F.col("categoryParentID") == 18)
    rows = lookup(changes, known, {"categoryId": "categoryId"}, _known_attr="categoryId")
    done = apply_changes(t.inventory_attributes, rows, ChangeSpec("attributesId", ("invID", "categoryId", "value"), ("value",), ("invID", "categoryId"), False),
                         [Rule("Attribute {} is not set up", action_is(ADD, UPDATE) & F.col("_known_attr").isNull(), F.col("categoryId"))])
    gone = done.changed.select("attributesId").unionByName(done.deleted.select("attributesId"))
    after = t.inventory_attributes.select("attributesId", "invID", "categoryId", "value").join(gone, "attributesId", "left_anti").drop("attributesId") \
        .unionByName(done.changed.select("invID", "categoryId", "value")).unionByName(done.added.select("invID", "categoryId", "value"))
    touched = done.changed.select("invID").unionByName(done.deleted.select("invID")).unionByName(done.added.select("invID")).distinct()
    items = t.md_Inventory.join(touched, "invID", "left_semi")
    return Attributes(done, named_items(t, items, after.join(touched, "invID", "left_semi")))


def change_bom_details(t: Tables, changes: DataFrame) -> Applied:
    """Components by (item, component): added when absent, changed or removed when present."""
    own = t.rawBom.groupBy("invId", "rawBomInvId").agg(F.min("rawBomId").alias("_bom"))
    rows = lookup(changes.drop("rawBomId") if "rawBomId" in changes.columns else changes, own, {"invId": "invId", "rawBomInvId": "rawBomInvId"}, rawBomId="_bom")
    items = t.md_Inventory.where(F.col("status") == 1)
    rows = lookup(lookup(rows, items, {"invId": "invID"}, _item="invID", companyId="companyId"), items, {"rawBomInvId": "invID"}, _part="invID")
    spec = ChangeSpec("rawBomId", ("companyId", "invId", "rawBomInvId", "rawBomQty"), (), ("invId", "rawBomInvId"), False)
    return apply_changes(t.rawBom, rows, spec, [Rule("Item {} is not set up", F.col("_item").isNull(), F.col("invId")), Rule("Component {} is not set up", F.col("_part").isNull(), F.col("rawBomInvId"))])


class Warehouses(NamedTuple):
    applied: Applied
    ship_tos: DataFrame


def change_warehouses(t: Tables, changes: DataFrame) -> Warehouses:
    """Location and label unique per company, deleted only when empty; changed addresses go to the ship-tos of the warehouse."""
    filled = t.inventoryBalanceWH.where(F.col("balanceQty") > 0).select("warehouseId").distinct()
    rows = lookup(changes, filled, {"warehouseId": "warehouseId"}, _filled="warehouseId")
    locations = t.md_Warehouse.groupBy("companyId", text_key("locNo").alias("_l")).agg(F.min("warehouseId").alias("_locId"))
    rows = rows.join(locations.withColumnRenamed("companyId", "_lc"), (F.col("companyId") == F.col("_lc")) & (text_key("locNo") == F.col("_l")), "left").drop("_lc", "_l")
    spec = ChangeSpec("warehouseId", ("companyId", "locNo", "label", "address", "addressLine2", "city", "state", "postcode", "countryId", "phone"), ("label",), ("label", "companyId"), True, "status")
    done = apply_changes(t.md_Warehouse, rows, spec, [
        Rule("Location {} is missing or taken", action_is(ADD) & (blank("locNo") | F.col("_locId").isNotNull()), F.col("locNo")),
        Rule("Warehouse {} holds stock", action_is(DELETE) & F.col("_filled").isNotNull(), F.col("warehouseId"))])
    facts = done.changed.where(F.col("status") == 1).select(F.col("warehouseId").alias("_w"), *[F.col(v).alias(f"_{k}") for k, v in _PLACE.items()])
    places = t.md_ShipToDestination.join(facts, F.col("warehouseId") == F.col("_w")).withColumns({k: F.col(f"_{k}") for k in _PLACE}).select(*t.md_ShipToDestination.columns)
    return Warehouses(done, places)


# --- document headers and lines ---------------------------------------------------------------------------------

class OrdersEdited(NamedTuple):
    headers: DataFrame
    po_headers: DataFrame
    errors: DataFrame


def edit_sales_orders(t: Tables, changes: DataFrame, as_of) -> OrdersEdited:
    """Header edits (soHeaderId, customerPO, shipToId, earlyShipDate, lateShipDate, soNote) of draft, confirmed or reopened orders; a reopened order's new date goes to its POs."""
    today = F.lit(as_of).cast("date")
    new = changes.select("soHeaderId", *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c != "soHeaderId"])
    rows = lookup(new.join(t.soHeader, "soHeaderId"), t.md_ShipToDestination, {"_n_shipToId": "shipToId"}, _pod="pod")
    checked = validate(rows, [Rule("{} is not open for edits", ~F.col("soStatus").isin(SO["draft"], SO["confirmed"], SO["reopened"]), F.col("soName")),
                              Rule("{} has a ship date in the past", (F.col("_n_earlyShipDate") < today) | (F.col("_n_lateShipDate") < today), F.col("soName"))], "soHeaderId", ["soHeaderId"])
    good = checked.accepted
    reopened = F.col("soStatus") == SO["reopened"]
    moved = F.col("_n_earlyShipDate") != F.col("earlyShipDate")
    pos = good.where(reopened & moved).select(F.col("soName").alias("poReferenceId"), F.col("_n_earlyShipDate").alias("_d"))
    po_heads = t.poHeader.join(pos, "poReferenceId").withColumns({"poEarlyShipDate": F.col("_d"), "poLateShipDate": F.date_add("_d", 7)}).select(*t.poHeader.columns)
    sets = {c: F.col(f"_n_{c}") for c in changes.columns if c != "soHeaderId"}
    sets |= {"portOfDestination": F.col("_pod"), "lastUpdatedDate": F.when(reopened & (moved | (F.col("soNote") != F.col("_n_soNote"))), today).otherwise(F.col("lastUpdatedDate"))}
    return OrdersEdited(good.withColumns(sets).select(*t.soHeader.columns), po_heads, checked.errors.select("soHeaderId", "ruleNo", "rule", "key"))


class LinesEdited(NamedTuple):
    added: DataFrame
    changed: DataFrame
    deleted: DataFrame
    headers: DataFrame
    errors: DataFrame


def _priced_lines(t: Tables, lines: DataFrame) -> DataFrame:
    """Requested lines with the facts of their order and customer SKU, NULL where there is none (``_unpriced``)."""
    rows = lookup(lines, t.soHeader, {"soHeaderId": "soHeaderId"}, companyId="companyId", customerId="customerId", _orderStatus="soStatus")
    skus = t.md_CustomerSku.where(F.col("statusflag") == 1)
    rows = lookup(rows, skus, {"customerskuId": "customerskuId", "companyId": "companyId", "customerId": "customerId"}, invID="invID", customerSku="customerSku", merchantSku="merchantSKU",
                  EAN="EAN", _skuCost="csCost", _cur="currencyCode", soItemDesc="itemDesc")
    rows = lookup(rows, t.md_MasterCategory, {"_cur": "categoryId"}, currencyCode="categoryName")
    return rows.withColumn("isItemPriceChanged", F.when(F.col("csCost") != F.col("_skuCost"), 1).otherwise(0))


def _unpriced() -> list[Rule]:
    order, sku = F.col("_orderStatus").isNull(), F.col("invID").isNull()
    return [Rule("Order {} does not exist", order, F.col("soHeaderId")), Rule("Customer SKU {} is not set up", ~order & sku, F.col("customerskuId")),
            Rule("Customer SKU {} has no currency", ~sku & F.col("currencyCode").isNull(), F.col("customerSku"))]


_LINE = ["soHeaderId", "invID", "customerSku", "merchantSku", "EAN", "currencyCode", "csCost", "odrQty", "soItemDesc", "itemNote", "tagDivision"]


def add_sales_order_lines(t: Tables, lines: DataFrame, as_of) -> LinesEdited:
    """New lines (changeId, soHeaderId, customerskuId, csCost, odrQty, itemNote, tagDivision); a cancelled line of the SKU is revived, a live one is an error."""
    rows = _priced_lines(t, lines)
    own = t.soLineItem.groupBy(F.col("soHeaderId").alias("_h"), F.col("customerSku").alias("_s")).agg(
        F.max(F.when(F.col("soLineItemStatus") != SO["cancelled"], 1).otherwise(0)).alias("_live"), F.min("soLineItemId").alias("_line"))
    rows = rows.join(own, (F.col("soHeaderId") == F.col("_h")) & (F.col("customerSku") == F.col("_s")), "left").drop("_h", "_s")
    priced = shared_rows(rows)  # read for the currencies and the rules
    rows = flag_groups(priced, [(["soHeaderId"], {"_currencies": differs("currencyCode")})])
    checked = validate(rows, [Rule("SKU {} is on the order already", F.col("_live") == 1, F.col("customerSku")), Rule("An order has one currency", F.col("_currencies")), *_unpriced()], "changeId", ["soHeaderId"])
    removed_rows(priced)
    good = checked.accepted
    added = good.where(F.col("_line").isNull()).select("changeId", *_LINE).withColumns({"poQty": F.lit(0), "shpQty": F.lit(0), "soLineItemStatus": F.lit(SO["draft"])})
    news = ["csCost", "odrQty", "merchantSku", "EAN", "itemNote", "tagDivision"]
    again = good.where(F.col("_line").isNotNull()).groupBy("_line").agg(F.max_by(F.struct(*[F.col(c).alias(f"_n_{c}") for c in news]), "changeId").alias("_c"))
    revived = t.soLineItem.join(again, F.col("soLineItemId") == F.col("_line")).select(*t.soLineItem.columns, "_c.*") \
        .withColumns({**{c: F.col(f"_n_{c}") for c in news}, "soLineItemStatus": F.lit(SO["draft"])}).select(*t.soLineItem.columns)
    touched = good.where(F.col("_orderStatus") != SO["draft"]).select("soHeaderId").distinct()
    heads = t.soHeader.join(touched, "soHeaderId", "left_semi").withColumn("lastUpdatedDate", F.lit(as_of).cast("date"))
    return LinesEdited(added, revived, t.soLineItem.limit(0), heads, checked.errors)


def replace_sales_order_lines(t: Tables, lines: DataFrame, as_of) -> LinesEdited:
    """The whole line set of orders (changeId, soHeaderId, soLineItemId or NULL, ...).

    Matched open lines are updated and unmatched requested lines added; lines
    left out are deleted in a draft order and cancelled otherwise.  A factory
    order whose live lines all have a division is confirmed.
    """
    rows = _priced_lines(t, lines)
    on_order = t.soLineItem.select(F.col("soHeaderId").alias("_h"), F.col("customerSku").alias("_s")).distinct().withColumn("_on", F.lit(True))
    rows = rows.join(on_order, (F.col("soHeaderId") == F.col("_h")) & (F.col("customerSku") == F.col("_s")), "left").drop("_h", "_s")
    priced = shared_rows(rows)  # read for the currencies and the rules
    rows = flag_groups(priced, [(["soHeaderId"], {"_currencies": differs("currencyCode")})])
    checked = validate(rows, [Rule("SKU {} is on the order already", F.col("soLineItemId").isNull() & F.col("_on"), F.col("customerSku")), Rule("An order has one currency", F.col("_currencies")), *_unpriced()],
                       "changeId", ["soHeaderId"])
    removed_rows(priced)
    good = checked.accepted
    added = good.where(F.col("soLineItemId").isNull()).select("changeId", *_LINE).withColumns({"poQty": F.lit(0), "shpQty": F.lit(0), "soLineItemStatus": F.lit(SO["draft"])})
    news = ["csCost", "odrQty", "merchantSku", "EAN", "itemNote", "tagDivision"]
    given = good.where(F.col("soLineItemId").isNotNull()).groupBy(F.col("soLineItemId").alias("_l")).agg(F.max_by(F.struct(*[F.col(c).alias(f"_n_{c}") for c in news]), "changeId").alias("_c"))
    orders = good.select("soHeaderId", "_orderStatus").distinct()
    own = t.soLineItem.join(orders, "soHeaderId").join(given, F.col("soLineItemId") == F.col("_l"), "left")
    columns = t.soLineItem.columns
    open_line = F.col("soLineItemStatus").isin(SO["reopened"], SO["draft"])
    matched = own.where(F.col("_l").isNotNull() & open_line).withColumns({**{c: F.col(f"_c._n_{c}") for c in news}, "soLineItemStatus": F.lit(SO["draft"])})
    left_out = own.where(F.col("_l").isNull())
    draft = F.col("_orderStatus") == SO["draft"]
    cancelled = left_out.where(~draft).withColumns({"soLineItemStatus": F.lit(SO["cancelled"]), "odrQty": F.lit(0)})
    deleted = left_out.where(draft).select(*columns)
    changed = matched.select(*columns).unionByName(cancelled.select(*columns))
    kept = own.where(F.col("_l").isNotNull()).select("soHeaderId", F.when(open_line, F.col("_c._n_tagDivision")).otherwise(F.col("tagDivision")).alias("_tag"), "soLineItemStatus") \
        .where(F.col("soLineItemStatus") != SO["cancelled"]).drop("soLineItemStatus").unionByName(added.select("soHeaderId", F.col("tagDivision").alias("_tag")))
    tagged = kept.groupBy("soHeaderId").agg(F.bool_and(F.col("_tag") != UNTAGGED).alias("_tagged"))
    heads = t.soHeader.join(orders.select("soHeaderId"), "soHeaderId", "left_semi").join(tagged, "soHeaderId", "left")
    heads = lookup(heads, t.md_Company, {"companyId": "companyId"}, _marketing="isMarketing")
    auto = (F.col("_marketing") == 0) & F.coalesce("_tagged", F.lit(False))
    was_draft = F.col("soStatus") == SO["draft"]
    heads = heads.withColumn("lastUpdatedDate", F.when(~was_draft, F.lit(as_of).cast("date")).otherwise(F.col("lastUpdatedDate"))) \
        .withColumns({"soName": F.when(auto, F.replace("soName", F.lit("tempSO_"), F.lit(""))).otherwise(F.col("soName")), "apiStatus": F.when(auto, "_NEW_").otherwise(F.col("apiStatus")),
                      "soStatus": F.when(auto, SO["confirmed"]).otherwise(F.col("soStatus"))}).select(*t.soHeader.columns)
    return LinesEdited(added, changed, deleted, heads, checked.errors)


class PoLinesEdited(NamedTuple):
    applied: Applied
    so_lines: DataFrame
    headers: DataFrame


def edit_purchase_order_lines(t: Tables, changes: DataFrame) -> PoLinesEdited:
    """PO line changes (changeId, actionType, podetailsId, poId, unitPrice, qty, itemNote): quantity within the order, home cost and totals, PO quantity of the order line follows."""
    rows = lookup(changes, t.poHeader, {"poId": "poId"}, _rate="foreignCurrencyRate")
    link = t.poLineItem.select("podetailsId", F.col("soLineItemId").alias("_so"), F.col("qty").alias("_oldQty"))
    rows = lookup(lookup(rows, link, {"podetailsId": "podetailsId"}, _so="_so", _oldQty="_oldQty"), t.soLineItem, {"_so": "soLineItemId"}, _odr="odrQty")
    done = apply_changes(t.poLineItem, rows, ChangeSpec("podetailsId", ("poId", "unitPrice", "qty", "itemNote")), [
        Rule("{} asks for more than its order", action_is(UPDATE) & (F.col("qty") > F.col("_odr")), F.col("podetailsId")), Rule("PO {} does not exist", F.col("_rate").isNull(), F.col("poId"))])
    lines = lookup(done.changed, t.poHeader, {"poId": "poId"}, _rate="foreignCurrencyRate").withColumn("homeCurrencyCost", F.col("unitPrice") * F.col("_rate")).drop("_rate")
    moved = lookup(done.changed.select("podetailsId", "soLineItemId", "qty"), link, {"podetailsId": "podetailsId"}, _oldQty="_oldQty").where(F.col("qty") != F.col("_oldQty"))
    sums = moved.groupBy(F.col("soLineItemId").alias("_l")).agg(F.sum("qty").alias("_q"))
    so_lines = t.soLineItem.join(sums, F.col("soLineItemId") == F.col("_l")).withColumn("poQty", F.col("_q").cast("int")).select(*t.soLineItem.columns)
    touched = done.changed.select("poId").unionByName(done.deleted.select("poId")).unionByName(done.added.select("poId")).distinct()
    after = t.poLineItem.join(touched, "poId", "left_semi").join(done.changed.select("podetailsId").unionByName(done.deleted.select("podetailsId")), "podetailsId", "left_anti") \
        .select("poId", "unitPrice", "qty", "itemStatus").unionByName(done.changed.select("poId", "unitPrice", "qty", "itemStatus")) \
        .unionByName(done.added.select("poId", "unitPrice", "qty", F.lit(PO["draft"]).alias("itemStatus")))
    totals = after.where(F.col("itemStatus") != PO["cancelled"]).groupBy("poId").agg(F.sum(F.col("unitPrice") * F.col("qty")).alias("_net"))
    heads = _with_totals(t.poHeader.join(touched, "poId", "left_semi"), totals)
    return PoLinesEdited(Applied(done.added, lines, done.deleted, done.errors), so_lines, heads)


class RequestLinesEdited(NamedTuple):
    added: DataFrame
    changed: DataFrame
    deleted: DataFrame
    po_lines: DataFrame
    errors: DataFrame


def edit_request_lines(t: Tables, changes: DataFrame) -> RequestLinesEdited:
    """Request line changes (changeId, actionType, lrDetailsId, lrHeaderId, lrContainerId, poDetailsId, qty, itemNote).

    Adding a PO line that the container has already adds to that line; the
    quantity asked over all requests may not pass the PO quantity, and the PO
    line's requested quantity follows the difference.
    """
    own = t.lrLineItem.groupBy(F.col("lrContainerId").alias("_c"), F.col("poDetailsId").alias("_p")).agg(F.min("lrDetailsId").alias("_has"))
    rows = changes.join(own, (F.col("lrContainerId") == F.col("_c")) & (F.col("poDetailsId") == F.col("_p")), "left").drop("_c", "_p")
    grows = action_is(ADD) & F.col("_has").isNotNull()
    rows = rows.withColumn("lrDetailsId", F.when(grows, F.col("_has")).otherwise(F.col("lrDetailsId")))
    line = t.lrLineItem.select(F.col("lrDetailsId").alias("_l"), F.col("poDetailsId").alias("_line_po"), F.col("qty").alias("_old"), F.col("itemNote").alias("_oldNote"), F.col("itemStatus").alias("_state"))
    met = shared_rows(rows.join(line, F.col("lrDetailsId") == F.col("_l"), "left").drop("_l"))  # the joins before and after are not on disk at once
    rows = met.withColumns({"_po": F.coalesce("_line_po", "poDetailsId"), "_new": F.when(action_is(DELETE), 0).when(grows, F.col("_old") + F.col("qty")).otherwise(F.col("qty"))})
    rows = rows.withColumn("_diff", F.col("_new") - F.coalesce("_old", F.lit(0)))
    rows = lookup(rows, t.poLineItem, {"_po": "podetailsId"}, _qty="qty", _lrQty="lrQty", _order="poId", _soLine="soLineItemId", _sku="supplierSku", _inv="invID")
    wanted = shared_rows(rows)  # summed, then joined
    removed_rows(met)
    asked = wanted.groupBy(F.col("_po").alias("_g")).agg(F.sum("_diff").alias("_sum"))
    rows = wanted.join(asked, F.col("_po") == F.col("_g"), "left").drop("_g")
    checked = validate(rows, [
        Rule("Line {} is not open for edits", F.col("_state").isNotNull() & ~F.col("_state").isin(LR["draft"], LR["rejected"], LR["reopened"]), F.col("lrDetailsId")),
        Rule("Line {} does not exist", action_is(UPDATE, DELETE) & F.col("_state").isNull(), F.col("lrDetailsId")),
        Rule("PO line {} is asked beyond its quantity", (F.col("_diff") > 0) & (F.col("_lrQty") + F.col("_sum") > F.col("_qty")), F.col("_po")),
        Rule("PO line {} does not exist", action_is(ADD) & F.col("_qty").isNull(), F.col("_po"))], "changeId", ["changeId"])
    removed_rows(wanted)
    good = checked.accepted
    added = good.where(action_is(ADD) & F.col("_has").isNull()).join(t.lrHeader.select("lrHeaderId", "lrName"), "lrHeaderId").select(
        "changeId", "lrHeaderId", "lrName", "lrContainerId", F.col("_soLine").alias("soLineItemId"), F.col("_order").alias("poId"), "poDetailsId", F.col("_sku").alias("supplierSku"), F.col("_inv").alias("invID"),
        "qty", "itemNote", F.lit(0).alias("confirmQty"), F.lit(LR["draft"]).alias("itemStatus"))
    added = lookup(added, t.soLineItem, {"soLineItemId": "soLineItemId"}, soHeaderId="soHeaderId")
    note = F.when(blank("itemNote"), F.col("_oldNote")).when(blank("_oldNote") | ~grows, F.col("itemNote")).otherwise(F.concat("_oldNote", F.lit(", "), "itemNote"))
    edits = good.where(grows | action_is(UPDATE)).groupBy(F.col("lrDetailsId").alias("_l")).agg(F.sum("_diff").alias("_d"), F.max_by(note, "changeId").alias("_n"))
    changed = t.lrLineItem.join(edits, F.col("lrDetailsId") == F.col("_l")).withColumns({"qty": (F.col("qty") + F.col("_d")).cast("int"), "itemNote": F.col("_n")}).select(*t.lrLineItem.columns)
    deleted = t.lrLineItem.join(good.where(action_is(DELETE)).select("lrDetailsId"), "lrDetailsId", "left_semi")
    po_lines = add_qty(t.poLineItem, good, "podetailsId", "lrQty", "_diff", changes_key="_po")
    return RequestLinesEdited(added, changed, deleted, po_lines, checked.errors.select("changeId", "ruleNo", "rule", "key"))


def _or_old(new: str, old: str):
    return F.when(blank(new), F.col(old)).otherwise(F.col(new))


def edit_containers(t: Tables, changes: DataFrame) -> DataFrame:
    """Container fields (lrHeaderId, containerSeq, containerNo, containerSealNo, containerTypeId): a blank number keeps the old one, other blanks clear."""
    new = changes.select("lrHeaderId", "containerSeq", *[F.col(c).alias(f"_n_{c}") for c in ("containerNo", "containerSealNo", "containerTypeId")])
    return t.lrContainer.join(new, ["lrHeaderId", "containerSeq"]).withColumns({
        "containerNo": _or_old("_n_containerNo", "containerNo"), "containerSealNo": F.coalesce("_n_containerSealNo", F.lit("")), "containerTypeId": F.col("_n_containerTypeId")}).select(*t.lrContainer.columns)


class Booked(NamedTuple):
    containers: DataFrame
    headers: DataFrame
    errors: DataFrame


def book_containers(t: Tables, bookings: DataFrame) -> Booked:
    """Booking details (requestId, lrHeaderId, containerSeq, forwarderId, forwarderBookingNo, forwarderBookingDate, ETD, ETA, portId) onto containers and their mirrors.

    The containers of a request must share ship date and port; a booking number makes the loading request ready to load.
    """
    news = ["forwarderId", "forwarderBookingNo", "forwarderBookingDate", "ETD", "ETA", "portId"]
    rows = bookings.select("requestId", "lrHeaderId", "containerSeq", *[F.col(c).alias(f"_n_{c}") for c in news]).join(t.lrContainer, ["lrHeaderId", "containerSeq"])
    rows = flag_groups(rows, [(["requestId"], {"_dates": differs("earlyShipDate"), "_ports": differs("_n_portId")})])
    checked = validate(rows, [Rule("Containers of {} have different ship dates", F.col("_dates"), F.col("lrName")), Rule("Containers of {} have different ports", F.col("_ports"), F.col("lrName"))],
                       "lrContainerId", ["requestId"])
    given = checked.accepted.groupBy(F.col("lrContainerId").alias("_id")).agg(F.max(F.struct(*[F.col(f"_n_{c}") for c in news])).alias("_b"))
    columns = t.lrContainer.columns

    def put(key: str) -> DataFrame:
        return t.lrContainer.join(given, F.col(key) == F.col("_id")).withColumns({c: F.col(f"_b._n_{c}") for c in news}).select(*columns)

    own = put("lrContainerId")
    boxes = own.unionByName(put("ref_lrContainerId").join(own, "lrContainerId", "left_anti"))
    booked = boxes.where(~blank("forwarderBookingNo")).select("lrHeaderId").distinct()
    heads = t.lrHeader.join(booked, "lrHeaderId", "left_semi").withColumn("apiStatus", F.lit("_READYLOAD_"))
    return Booked(boxes, heads, checked.errors)


def edit_shipment_freight(t: Tables, changes: DataFrame) -> DataFrame:
    """Freight (shipmentId, containerNo, containerSealNo, haulierId, vesselId, ETD, ETA) onto shipments; haulier and vessel also onto the other shipments of the request."""
    news = ["containerNo", "containerSealNo", "haulierId", "vesselId", "ETD", "ETA"]
    new = changes.select("shipmentId", *[F.col(c).alias(f"_n_{c}") for c in news])
    shared = new.join(t.shipmentHeader.select("shipmentId", "lrHeaderId"), "shipmentId").groupBy(F.col("lrHeaderId").alias("_lr")).agg(
        F.max_by(F.struct(F.col("_n_haulierId").alias("h"), F.col("_n_vesselId").alias("v")), "shipmentId").alias("_s"))
    rows = t.shipmentHeader.join(shared, F.col("lrHeaderId") == F.col("_lr")).join(new.withColumn("_own", F.lit(True)), "shipmentId", "left")
    own = F.col("_own").isNotNull()
    return rows.withColumns({"containerNo": F.when(own, _or_old("_n_containerNo", "containerNo")).otherwise(F.col("containerNo")),
                             "containerSealNo": F.when(own, F.coalesce("_n_containerSealNo", F.lit(""))).otherwise(F.col("containerSealNo")),
                             "ETD": F.when(own, F.col("_n_ETD")).otherwise(F.col("ETD")), "ETA": F.when(own, F.col("_n_ETA")).otherwise(F.col("ETA")),
                             "haulierId": F.col("_s.h"), "vesselId": F.col("_s.v")}).select(*t.shipmentHeader.columns)


class ShipmentsEdited(NamedTuple):
    headers: DataFrame
    errors: DataFrame


def edit_shipments(t: Tables, changes: DataFrame) -> ShipmentsEdited:
    """Partial updates (shipmentId, customerInvoiceNo, pickupAddrId, shipToId, pol, pod, note; NULL keeps): ship-from and ship-to must belong to the shipment's company."""
    news = ["customerInvoiceNo", "pickupAddrId", "shipToId", "pol", "pod", "note"]
    rows = changes.select("shipmentId", *[F.col(c).alias(f"_n_{c}") for c in news]).join(t.shipmentHeader, "shipmentId")
    rows = lookup(rows, t.md_Warehouse, {"_n_pickupAddrId": "warehouseId"}, _fromCompany="companyId")
    rows = lookup(rows, t.md_ShipToDestination, {"_n_shipToId": "shipToId"}, _toCompany="companyId")
    checked = validate(rows, [Rule("Ship-from {} is another company's", F.col("_fromCompany") != F.col("companyId"), F.col("_n_pickupAddrId")),
                              Rule("Ship-to {} is another company's", F.col("_toCompany") != F.col("companyId"), F.col("_n_shipToId"))], "shipmentId", ["shipmentId"])
    out = checked.accepted.withColumns({c: F.coalesce(f"_n_{c}", c) for c in news})
    return ShipmentsEdited(out.select(*t.shipmentHeader.columns), checked.errors.select("shipmentId", "ruleNo", "rule", "key"))
