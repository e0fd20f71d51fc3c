"""Change sets over whole tables; the change rows are one SQL text that both engines run."""

from pyspark.sql import functions as F

from ..plans import changes as M
from . import register

AS_OF = "1998-01-01"
_ACTION = "CASE {k} % 5 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' WHEN 2 THEN 'delete' WHEN 3 THEN 'Reactivate' ELSE 'UPDATE' END"


def _act(k):
    return _ACTION.format(k=k)


def _blank(x):
    return f"coalesce(trim(CAST({x} AS VARCHAR)), '') = ''"


class Oracle:
    """SQL counterpart of applying a change set; ``extra`` adds columns to ``r``, ``rules`` are (condition, key)."""

    def __init__(self, target, key, changes, columns, required=(), unique=(), text=(), on_update=True, status=None, extra="", rules=(), joins="", ctes=""):
        live = f"x.{status} = 1" if status else "true"
        value = lambda a, c: f"lower(rtrim({a}.{c}))" if c in text else f"{a}.{c}"
        checks = [("act NOT IN ('add', 'update', 'delete', 'reactivate')", "actionType")]
        if required:
            checks.append((f"act IN ('add', 'update') AND ({' OR '.join('(' + _blank(c) + ')' for c in required)})", "''"))
        if unique:
            checks.append(("taken", "concat_ws(' / ', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in unique) + ")"))
        checks.append(("act <> 'add' AND NOT known", key))
        self.rules = checks + list(rules)
        bad = " OR ".join(f"coalesce({c}, false)" for c, _ in self.rules)
        self.target, self.key, self.columns, self.status = target, key, columns, status
        taken = "r0 AS (SELECT c.*, act0 AS act, x.{key} IS NOT NULL AS known FROM c LEFT JOIN (SELECT DISTINCT {key} FROM {target}) x ON x.{key} = c.{key}), r AS (SELECT *, false AS taken FROM r0)".format(key=key, target=target)
        if unique:
            names = [f"u{i}" for i in range(len(unique))]
            keys = lambda a: ", ".join(f"{value(a, c)} AS {n}" for c, n in zip(unique, names))
            same = lambda a, b: " AND ".join(f"{a}.{n} = {b}.{n}" for n in names)
            others = " OR ".join(f"coalesce({c}, false)" for c, k in self.rules if c != "taken")
            changes_key = "act IN ('add', 'update')" if on_update else "act = 'add'"
            own = f"act = 'add' OR lo <> r.{key} OR hi <> r.{key}" if on_update else "true"
            mine = f"coalesce(r1.act = 'update' AND w.act = 'update' AND w.{key} = r1.{key}, false)"
            taken = f"""st AS (SELECT {keys('x')}, min(x.{key}) AS lo, max(x.{key}) AS hi FROM {target} x WHERE {live} GROUP BY {', '.join(str(i + 1) for i in range(len(names)))}),
            r00 AS (SELECT c.*, act0 AS act, x.{key} IS NOT NULL AS known, {keys('c')} FROM c LEFT JOIN (SELECT DISTINCT {key} FROM {target}) x ON x.{key} = c.{key}),
            r0 AS (SELECT r00.*, lo, hi FROM r00 LEFT JOIN st ON {same('r00', 'st')}),
            r1 AS (SELECT r.*, coalesce({changes_key} AND lo IS NOT NULL AND ({own}), false) AS stored, {others} AS others FROM r0 r),
            cl AS (SELECT * FROM r1 WHERE {changes_key} AND NOT others AND NOT stored), fi AS (SELECT {', '.join(names)}, min(changeId) AS cid FROM cl GROUP BY ALL),
            r AS (SELECT r1.* EXCLUDE ({', '.join(names)}, lo, hi, stored, others), r1.stored OR coalesce(r1.{changes_key} AND fi.cid < r1.changeId AND NOT ({mine}), false) AS taken
                  FROM r1 LEFT JOIN fi ON {same('r1', 'fi')} LEFT JOIN cl w ON w.changeId = fi.cid AND {same('w', 'fi')})"""
        self.sql = f"""WITH {ctes}c0 AS ({changes}), c AS (SELECT c0.* {extra}, lower(trim(actionType)) AS act0 FROM c0 {joins}), {taken},
            ok AS (SELECT * FROM r WHERE NOT ({bad})),
            la AS (SELECT * FROM ok WHERE act <> 'add' QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY changeId DESC) = 1)"""

    def errors(self):
        return self.sql + " " + " UNION ALL ".join(f"SELECT changeId, {i} AS ruleNo, CAST({k} AS VARCHAR) AS \"key\" FROM r WHERE {c}" for i, (c, k) in enumerate(self.rules, 1))

    def added(self, **instead):
        status = f", 1 AS {self.status}" if self.status else ""
        return f"{self.sql} SELECT changeId, {', '.join(f'{instead[c]} AS {c}' if c in instead else c for c in self.columns)}{status} FROM ok WHERE act = 'add'"

    def _changed(self):
        cols = ", ".join(f"CASE WHEN la.act = 'update' THEN la.{c} ELSE x.{c} END AS {c}" for c in self.columns)
        status = f", CASE la.act WHEN 'delete' THEN 0 WHEN 'reactivate' THEN 1 ELSE x.{self.status} END AS {self.status}" if self.status else ""
        return f"SELECT x.{self.key}, {cols}{status} FROM la JOIN {self.target} x ON x.{self.key} = la.{self.key}" + ("" if self.status else " WHERE la.act <> 'delete'")

    def changed(self):
        return f"{self.sql} {self._changed()}"

    def deleted(self):
        return f"{self.sql} SELECT {self.key} FROM la WHERE act = 'delete'"

    def fields(self):
        return [self.key, *self.columns, *([self.status] if self.status else [])]


def _register(name, run, o, added=True):
    register(f"{name}_errors", lambda t: run(t).errors.drop("rule"), o.errors())
    register(f"{name}_changed", lambda t: run(t).changed.select(*o.fields()), o.changed())
    if added:
        register(f"{name}_added", lambda t: run(t).added.select("changeId", *o.columns, *([o.status] if o.status else [])), o.added())


# --- parties
parties = lambda t: M.company_to_parties(t, t.md_Company.select("companyId"))
register("company_to_customers", lambda t: parties(t).customers.select("customerId", "customerName", "customerShortCode", "customerAddress", "customerCity", "customerCountry"), """
SELECT c.customerId, x.companyName AS customerName, x.companyShortCode AS customerShortCode, x.address AS customerAddress, x.city AS customerCity, x.country AS customerCountry
FROM md_Customer c JOIN md_Company x ON x.companyId = c.internal_branchId""")
register("company_to_suppliers", lambda t: parties(t).suppliers.select("supplierId", "supplierCompanyName", "supplierAddress", "supplierPostcode"), """
SELECT s.supplierId, x.companyName AS supplierCompanyName, x.address AS supplierAddress, x.postcode AS supplierPostcode FROM md_Supplier s JOIN md_Company x ON x.companyId = s.internal_branchId""")

# --- ports
_PORTS = f"""SELECT s_suppkey AS changeId, CASE WHEN s_suppkey % 31 = 30 THEN 'Rename' ELSE {_act('s_suppkey')} END AS actionType, CAST(1 + s_suppkey % 7 AS INT) AS portId, 'pod' AS portType,
    CASE WHEN s_suppkey % 15 = 0 THEN 'ANTWERP' WHEN s_suppkey % 11 = 0 THEN '' ELSE concat('Port ', s_suppkey % 40) END AS portName FROM {{supplier}}"""
_register("change_ports", lambda t: M.change_ports(t, t.sql(_PORTS)),
          Oracle("md_Port", "portId", _PORTS, ["portType", "portName"], ["portType", "portName"], ["portType", "portName"], {"portType", "portName"}, False, "statusFlag"))

# --- currency rates
_RATES = """SELECT changeId, companyId, homeCurrency, foreignCurrency, startDate, endDate, foreignRate FROM (
    SELECT CAST(year(o_orderdate) * 10 + 1 + o_custkey % 3 AS BIGINT) AS changeId, CAST(1 + o_custkey % 3 AS INT) AS companyId, CASE WHEN o_custkey % 3 = 1 THEN 'MYR' ELSE 'SGD' END AS homeCurrency,
           CASE WHEN year(o_orderdate) % 2 = 0 THEN 'USD' ELSE 'EUR' END AS foreignCurrency, make_date(CAST(year(o_orderdate) + 1 AS INT), 2, 1) AS startDate,
           make_date(CAST(year(o_orderdate) + 1 AS INT), 9, 30) AS endDate, CAST(1500000 + count(*) % 77 AS BIGINT) AS foreignRate FROM {orders} GROUP BY o_custkey % 3, year(o_orderdate)) q"""
rates = lambda t: M.change_currency_rates(t, t.sql(_RATES))
_RT = f"""WITH c AS ({_RATES}), m AS (SELECT c.*, (SELECT max(rateId) FROM md_CurrencyRate k WHERE k.companyId = c.companyId AND k.homeCurrency = c.homeCurrency AND k.foreignCurrency = c.foreignCurrency
    AND k.endDate >= c.startDate) AS rateId FROM c)"""
register("change_currency_rates_added", lambda t: rates(t).added, _RT + """ SELECT changeId, companyId, homeCurrency, foreignCurrency, CAST(startDate AS VARCHAR) AS startDate, CAST(endDate AS VARCHAR) AS endDate,
    foreignRate, 1 AS status FROM m WHERE rateId IS NULL""")
register("change_currency_rates_changed", lambda t: rates(t).changed.select("rateId", "startDate", "endDate", "foreignRate"), _RT + """
SELECT rateId, CAST(arg_max(startDate, changeId) AS VARCHAR) AS startDate, CAST(arg_max(endDate, changeId) AS VARCHAR) AS endDate, arg_max(foreignRate, changeId) AS foreignRate FROM m WHERE rateId IS NOT NULL GROUP BY rateId""")
register("change_currency_rates_pos", lambda t: rates(t).po_headers.select("poId", "foreignCurrencyRate"), _RT + """
SELECT p.poId, arg_max(c.foreignRate, c.changeId) AS foreignCurrencyRate FROM poHeader p JOIN c ON c.companyId = p.companyId AND c.homeCurrency = p.homeCurrencyCode AND c.foreignCurrency = p.foreignCurrencyCode
WHERE p.poStatus = 1079 GROUP BY p.poId""")

# --- ship-tos
_SHIPTO = f"""SELECT c_custkey AS changeId, {_act('c_custkey')} AS actionType, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 29 = 1 THEN -1 ELSE c_custkey END AS shipToId,
    CAST(1 + c_custkey % 3 AS INT) AS companyId, c_custkey AS customerId, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN 9 ELSE 1 + c_custkey % 4 END AS INT) AS warehouseId,
    CASE WHEN c_custkey % 10 = 0 THEN concat('l', 1 + c_custkey % 4) WHEN c_custkey % 13 = 0 THEN '' ELSE concat('N', c_custkey) END AS locNo, 'New store' AS shipToName, concat('N-', c_custkey) AS shipToLabel,
    'New Road' AS shipToAddressLine1, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'Town' END AS shipToCity, 'P1' AS shipToPostCode, CAST(5 AS INT) AS country, CAST(2 AS INT) AS pod FROM {{customer}}"""
_PLACE = ["shipToLabel", "shipToAddressLine1", "shipToCity", "shipToPostCode", "country"]
_W = {"shipToLabel": "w.label", "shipToAddressLine1": "w.address", "shipToCity": "w.city", "shipToPostCode": "w.postcode", "country": "w.countryId"}
_SHIPTO_SQL = f"""SELECT q.* REPLACE ({', '.join(f'CASE WHEN coalesce(q.warehouseId, 0) <> 0 THEN {_W[c]} ELSE q.{c} END AS {c}' for c in _PLACE)}), w.warehouseId AS house
    FROM ({_SHIPTO}) q LEFT JOIN md_Warehouse w ON w.warehouseId = q.warehouseId AND w.status = 1"""
_register("change_ship_tos", lambda t: M.change_ship_tos(t, t.sql(_SHIPTO)),
          Oracle("md_ShipToDestination", "shipToId", _SHIPTO_SQL, ["companyId", "customerId", "warehouseId", "locNo", "shipToName", "pod", *_PLACE], ["locNo", "shipToName"], ["locNo", "customerId", "companyId"],
                 {"locNo"}, rules=[("act IN ('add', 'update') AND coalesce(warehouseId, 0) <> 0 AND house IS NULL", "warehouseId"),
                                   (f"act IN ('add', 'update') AND coalesce(warehouseId, 0) = 0 AND (({_blank('shipToAddressLine1')}) OR ({_blank('shipToCity')}) OR ({_blank('shipToPostCode')}))", "''")]))

# --- SKUs
_CSKU = f"""SELECT p_partkey AS changeId, {_act('p_partkey')} AS actionType, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('13-', p_partkey) END AS customerskuId, p_partkey AS invID, CAST(13 AS BIGINT) AS customerId,
    2 AS companyId, CASE WHEN p_partkey % 10 = 0 THEN concat('cs-13-', p_partkey) WHEN p_partkey % 21 = 0 THEN '' ELSE concat('X-', p_partkey) END AS customerSku, concat('ms-', p_partkey) AS merchantSKU, 'E' AS EAN,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'given' END AS itemDesc, 1120 AS currencyCode, CAST(p_size * 200 AS BIGINT) AS csCost, 3235 AS tagDivision,
    CASE WHEN p_partkey % 8 = 1 THEN p_partkey ELSE 0 END AS cartonMaterial, CAST(p_size % 4 AS INT) AS qtyPerCarton FROM {{part}}"""
_CSKU_SQL = f"""SELECT q.* REPLACE (CASE WHEN q.itemDesc <> '' THEN q.itemDesc WHEN coalesce(i.itemDesc, '') = '' THEN i.productName ELSE i.itemDesc END AS itemDesc) FROM ({_CSKU}) q LEFT JOIN md_Inventory i ON i.invID = q.invID AND i.status = 1"""
_register("change_customer_skus", lambda t: M.change_customer_skus(t, t.sql(_CSKU)),
          Oracle("md_CustomerSku", "customerskuId", _CSKU_SQL, ["invID", "customerId", "companyId", "customerSku", "merchantSKU", "EAN", "itemDesc", "currencyCode", "csCost", "tagDivision"], ["customerSku", "merchantSKU"],
                 ["customerSku", "merchantSKU", "customerId", "companyId"], {"customerSku", "merchantSKU"}, True, "statusflag",
                 rules=[("act IN ('add', 'update') AND coalesce(cartonMaterial, 0) <> 0 AND coalesce(qtyPerCarton, 0) <= 0", "cartonMaterial")]))
_SSKU = f"""SELECT p_partkey AS changeId, {_act('p_partkey')} AS actionType, concat(p_partkey, '-', p_partkey % 9) AS supplierskuId, p_partkey AS invId, p_partkey % 9 AS supplierId, CAST(1 + p_partkey % 9 % 3 AS INT) AS companyId,
    CASE WHEN p_partkey % 10 = 0 THEN concat('ss-', p_partkey % 9, '-', p_partkey) WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat('Y-', p_partkey) END AS supplierSku, 'd' AS itemDesc,
    CAST(CASE WHEN p_partkey % 19 = 0 THEN 1199 ELSE 1120 + p_partkey % 9 % 3 END AS INT) AS currencyCode, CAST(p_size * 50 AS BIGINT) AS supCost, 1 AS isDefault FROM {{part}}"""
_register("change_supplier_skus", lambda t: M.change_supplier_skus(t, t.sql(_SSKU)),
          Oracle("md_SupplierSku", "supplierskuId", _SSKU, ["invId", "supplierId", "companyId", "supplierSku", "itemDesc", "currencyCode", "supCost", "isDefault"], ["supplierSku"],
                 ["supplierSku", "supplierId", "invId", "companyId"], {"supplierSku"}, False, "statusflag", extra=", s.currencyCode AS own", joins="LEFT JOIN md_Supplier s ON s.supplierId = c0.supplierId",
                 rules=[("own IS NULL", "supplierId"), ("own <> currencyCode", "currencyCode")]))

# --- categories
_CAT = f"""SELECT s_suppkey AS changeId, {_act('s_suppkey')} AS actionType, CAST(11 + s_suppkey % 7 AS INT) AS prodCategoryId, CAST(1 + s_suppkey % 3 AS INT) AS companyId, CASE WHEN s_suppkey % 23 = 0 THEN '' ELSE concat('cat ', s_suppkey % 60) END AS prodCategoryName,
    concat('C', s_suppkey % 90) AS prodCategoryCode FROM {{supplier}}"""
cats = lambda t: M.change_categories(t, t.sql(_CAT))
_co = Oracle("topCategory", "prodCategoryId", f"SELECT q.* REPLACE (upper(prodCategoryName) AS prodCategoryName), 1 AS prodCategoryParentID FROM ({_CAT}) q", ["companyId", "prodCategoryName", "prodCategoryCode", "prodCategoryParentID"],
             ["prodCategoryName"], ["prodCategoryName", "companyId"], {"prodCategoryName"}, True, "status", ctes="topCategory AS (SELECT * FROM md_InventoryCategory WHERE prodCategoryParentID = 1), ")
register("change_categories_errors", lambda t: cats(t).errors.drop("rule"), _co.errors())
register("change_categories_added", lambda t: cats(t).added.select("changeId", "companyId", "prodCategoryName", "prodCategoryCode"), _co.sql + """
, ad AS (SELECT ok.*, row_number() OVER (PARTITION BY companyId = 2 ORDER BY changeId) AS k FROM ok WHERE act = 'add'),
fr AS (SELECT num, row_number() OVER (ORDER BY num) AS k FROM range(1, 3000) g(num) WHERE num NOT IN (SELECT CAST(prodCategoryCode AS INT) FROM topCategory))
SELECT changeId, companyId, prodCategoryName, CASE WHEN companyId = 2 THEN lpad(CAST(fr.num AS VARCHAR), 3, '0') ELSE prodCategoryCode END AS prodCategoryCode FROM ad LEFT JOIN fr ON fr.k = ad.k""")
register("change_categories_changed", lambda t: cats(t).changed.select("prodCategoryId", "prodCategoryName", "status"), _co.sql + f""", ch AS ({_co._changed()})
SELECT prodCategoryId, prodCategoryName, status FROM ch UNION ALL SELECT s.prodCategoryId, s.prodCategoryName, 0 FROM md_InventoryCategory s JOIN ch ON ch.prodCategoryId = s.prodCategoryParentID AND ch.status = 0""")
register("change_categories_types", lambda t: cats(t).types.select("inventoryTypeId", "status"), _co.sql + f""", ch AS ({_co._changed()})
SELECT y.inventoryTypeId, 0 AS status FROM md_inventoryType y JOIN md_InventoryCategory s ON s.prodCategoryId = y.prodCategoryId JOIN ch ON ch.prodCategoryId = s.prodCategoryParentID AND ch.status = 0""")
_SUB = f"""SELECT s_suppkey AS changeId, {_act('s_suppkey')} AS actionType, CAST((11 + s_suppkey % 6) * 10 + s_suppkey % 4 AS INT) AS prodCategoryId, CAST(11 + s_suppkey % 6 AS INT) AS prodCategoryParentID, CAST(1 + s_suppkey % 3 AS INT) AS companyId,
    concat('sub ', s_suppkey % 70) AS prodCategoryName, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('Z', s_suppkey) END AS prodCategoryCode, CAST(s_suppkey % 2 AS INT) AS isBuffer FROM {{supplier}}"""
subs = lambda t: M.change_sub_categories(t, t.sql(_SUB))
_so = Oracle("subCategory", "prodCategoryId", f"SELECT q.* REPLACE (upper(prodCategoryName) AS prodCategoryName) FROM ({_SUB}) q", ["companyId", "prodCategoryName", "prodCategoryCode", "prodCategoryParentID", "isBuffer"],
             ["prodCategoryName"], ["prodCategoryName", "companyId", "prodCategoryParentID"], {"prodCategoryName"}, True, "status", rules=[("act = 'add' AND coalesce(prodCategoryParentID, 0) = 0", "''")],
             ctes="subCategory AS (SELECT * FROM md_InventoryCategory WHERE prodCategoryParentID <> 1), ")
register("change_sub_categories_errors", lambda t: subs(t).errors.drop("rule"), _so.errors())
register("change_sub_categories_changed", lambda t: subs(t).changed.select(*_so.fields()), _so.changed())
register("change_sub_categories_added", lambda t: subs(t).added.select("changeId", "prodCategoryName", "prodCategoryCode"), _so.sql + """
, ad AS (SELECT ok.*, p.prodCategoryCode AS px, companyId = 2 AND ok.prodCategoryCode = '' AS need, row_number() OVER (PARTITION BY companyId = 2 AND ok.prodCategoryCode = '', p.prodCategoryCode ORDER BY changeId) AS k
         FROM ok LEFT JOIN (SELECT prodCategoryId, prodCategoryCode FROM md_InventoryCategory WHERE prodCategoryParentID = 1) p ON p.prodCategoryId = ok.prodCategoryParentID WHERE act = 'add')
SELECT changeId, prodCategoryName, CASE WHEN need THEN px || '.' || lpad(CAST(k AS VARCHAR), 3, '0') ELSE prodCategoryCode END AS prodCategoryCode FROM ad""")
register("change_sub_categories_items", lambda t: subs(t).items.select("invID", "isBuffer"), _so.sql + f""", ch AS ({_so._changed()})
SELECT i.invID, ch.isBuffer FROM md_Inventory i JOIN ch ON ch.prodCategoryId = i.productSubCategory AND ch.status = 1 WHERE i.isBuffer <> ch.isBuffer""")

# --- products and attributes
_PROD = f"""SELECT p_partkey AS changeId, {_act('p_partkey')} AS actionType, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey END AS invID, CAST(1 + p_partkey % 3 AS INT) AS companyId, '' AS itemCode, cat AS productCategory,
    CASE WHEN p_partkey % 37 = 0 THEN 999 ELSE cat * 10 + sub END AS productSubCategory, (cat * 10 + sub) * 100 + brandNo AS productType, concat('q', p_size) AS modelNo, concat('P-', p_partkey) AS inventorySKU, 'plain' AS productName,
    'desc' AS itemDesc, CASE WHEN p_partkey % 41 = 0 THEN 'heavy' ELSE CAST(p_size * 3 AS VARCHAR(20)) END AS grossWeight, CAST(p_size AS VARCHAR(20)) AS netWeight, 1070 AS measurement FROM partShape"""
prods = lambda t: M.change_products(t, t.sql(_PROD))
_po = Oracle("md_Inventory", "invID", _PROD, ["companyId", "itemCode", "productCategory", "productSubCategory", "productType", "modelNo", "inventorySKU", "productName", "itemDesc", "grossWeight", "netWeight", "measurement"],
             ["inventorySKU", "modelNo"], status="status", rules=[(f"act IN ('add', 'update') AND NOT EXISTS (SELECT 1 FROM md_InventoryCategory x WHERE x.prodCategoryParentID = 1 AND x.prodCategoryId = productCategory)", "productCategory"),
             ("act IN ('add', 'update') AND NOT EXISTS (SELECT 1 FROM md_InventoryCategory x WHERE x.prodCategoryParentID = productCategory AND x.prodCategoryId = productSubCategory)", "productSubCategory"),
             ("act IN ('add', 'update') AND NOT EXISTS (SELECT 1 FROM md_inventoryType x WHERE x.inventoryTypeId = productType)", "productType"),
             ("act IN ('add', 'update') AND measurement NOT IN (1070, 1071)", "measurement"), ("act IN ('add', 'update') AND try_cast(grossWeight AS DECIMAL(18,4)) IS NULL", "grossWeight"),
             ("act IN ('add', 'update') AND try_cast(netWeight AS DECIMAL(18,4)) IS NULL", "netWeight")])
_NAME = """replace(replace(replace(regexp_replace(regexp_replace({t}, '\\[modelno\\]', {m}, 'gi'), '\\[color\\]', {c}, 'gi'), '[space]', ' '), '[,]', ','), '+', '')"""
register("change_products_errors", lambda t: prods(t).errors.drop("rule"), _po.errors())
register("change_products_added", lambda t: prods(t).added.select("changeId", "itemCode", "productName", "grossWeight"), _po.sql + f"""
, ad AS (SELECT ok.*, s.prodCategoryCode AS px, y.namingConvention AS tm, row_number() OVER (PARTITION BY s.prodCategoryCode ORDER BY changeId) AS k FROM ok LEFT JOIN md_InventoryCategory s ON s.prodCategoryId = ok.productSubCategory
         LEFT JOIN md_inventoryType y ON y.inventoryTypeId = ok.productType WHERE act = 'add'),
fr AS (SELECT px, num, row_number() OVER (PARTITION BY px ORDER BY num) AS k FROM (SELECT DISTINCT px FROM ad), range(1, 5000) g(num) WHERE px || '.' || lpad(CAST(num AS VARCHAR), 4, '0') NOT IN (SELECT itemCode FROM md_Inventory))
SELECT changeId, ad.px || '.' || lpad(CAST(num AS VARCHAR), 4, '0') AS itemCode, CASE WHEN tm = '' THEN productName ELSE {_NAME.format(t='tm', m='upper(modelNo)', c="''")} END AS productName, CAST(grossWeight AS BIGINT) AS grossWeight
FROM ad JOIN fr ON fr.px = ad.px AND fr.k = ad.k""")
_po.columns = [c for c in _po.columns if not c.endswith("Weight")]  # weights arrive as text
register("change_products_changed", lambda t: prods(t).changed.select("invID", "modelNo", "productName", "status"), _po.sql + f""", ch AS ({_po._changed()})
SELECT ch.invID, ch.modelNo, CASE WHEN y.namingConvention = '' THEN ch.productName ELSE {_NAME.format(t='y.namingConvention', m='upper(ch.modelNo)', c='upper(a.value)')} END AS productName, ch.status
FROM ch JOIN md_inventoryType y ON y.inventoryTypeId = ch.productType LEFT JOIN inventory_attributes a ON a.invID = ch.invID AND a.categoryId = 3194""")
_ATTR = """SELECT p_partkey AS changeId, CASE p_partkey % 4 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' WHEN 2 THEN 'Delete' ELSE 'Update' END AS actionType, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey * 10 + 1 END AS attributesId,
    p_partkey AS invID, CASE WHEN p_partkey % 8 = 0 THEN 3186 WHEN p_partkey % 43 = 0 THEN 77 ELSE 3194 END AS categoryId, CASE WHEN p_partkey % 31 = 0 THEN '' ELSE 'violet' END AS value FROM {part}"""
attrs = lambda t: M.change_product_attributes(t, t.sql(_ATTR))
_ao = Oracle("inventory_attributes", "attributesId", _ATTR, ["invID", "categoryId", "value"], ["value"], ["invID", "categoryId"], on_update=False,
             rules=[("act IN ('add', 'update') AND categoryId NOT IN (3194, 1123, 3186)", "categoryId")])
register("change_product_attributes_errors", lambda t: attrs(t).attributes.errors.drop("rule"), _ao.errors())
register("change_product_attributes_deleted", lambda t: attrs(t).attributes.deleted.select("attributesId"), _ao.deleted())
register("change_product_attributes_items", lambda t: attrs(t).items.select("invID", "productName"), _ao.sql + f"""
, af AS (SELECT x.invID, x.categoryId, CASE WHEN la.act = 'update' THEN la.value ELSE x.value END AS value FROM inventory_attributes x LEFT JOIN la ON la.attributesId = x.attributesId WHERE coalesce(la.act, '') <> 'delete'
         UNION ALL SELECT invID, categoryId, value FROM ok WHERE act = 'add'),
tc AS (SELECT invID FROM la UNION SELECT invID FROM ok WHERE act = 'add')
SELECT i.invID, CASE WHEN y.namingConvention = '' THEN i.productName ELSE {_NAME.format(t='y.namingConvention', m='upper(i.modelNo)', c="coalesce(upper(a.v), '')")} END AS productName
FROM md_Inventory i JOIN tc ON tc.invID = i.invID JOIN md_inventoryType y ON y.inventoryTypeId = i.productType LEFT JOIN (SELECT invID, max(value) AS v FROM af WHERE categoryId = 3194 GROUP BY 1) a ON a.invID = i.invID""")

# --- components, warehouses
_BOM = """SELECT p_partkey AS changeId, CASE p_partkey % 4 WHEN 0 THEN 'Add' WHEN 1 THEN 'Update' WHEN 2 THEN 'Delete' ELSE 'Add' END AS actionType, p_partkey AS invId, p_partkey + 1 AS rawBomInvId, CAST(7 AS INT) AS rawBomQty FROM {part}"""
_BOM_SQL = f"""SELECT q.*, (SELECT min(rawBomId) FROM rawBom b WHERE b.invId = q.invId AND b.rawBomInvId = q.rawBomInvId) AS rawBomId, i.companyId, i.invID AS item, j.invID AS part FROM ({_BOM}) q
    LEFT JOIN md_Inventory i ON i.invID = q.invId AND i.status = 1 LEFT JOIN md_Inventory j ON j.invID = q.rawBomInvId AND j.status = 1"""
_bo = Oracle("rawBom", "rawBomId", _BOM_SQL, ["companyId", "invId", "rawBomInvId", "rawBomQty"], (), ["invId", "rawBomInvId"], on_update=False, rules=[("item IS NULL", "invId"), ("part IS NULL", "rawBomInvId")])
_register("change_bom_details", lambda t: M.change_bom_details(t, t.sql(_BOM)), _bo)
register("change_bom_details_deleted", lambda t: M.change_bom_details(t, t.sql(_BOM)).deleted.select("rawBomId"), _bo.deleted())
_WH = f"""SELECT s_suppkey AS changeId, {_act('s_suppkey')} AS actionType, CAST(1 + s_suppkey % 5 AS INT) AS warehouseId, CAST(1 + s_suppkey % 3 AS INT) AS companyId, CASE WHEN s_suppkey % 15 = 0 THEN 'l1' ELSE concat('N', s_suppkey) END AS locNo,
    CASE WHEN s_suppkey % 9 = 1 THEN 'Main' ELSE concat('Lab', s_suppkey) END AS label, 'Addr' AS address, '' AS addressLine2, 'City' AS city, '' AS state, 'P9' AS postcode, 7 AS countryId, '1' AS phone FROM {{supplier}}"""
_wo = Oracle("md_Warehouse", "warehouseId", _WH, ["companyId", "locNo", "label", "address", "addressLine2", "city", "state", "postcode", "countryId", "phone"], ["label"], ["label", "companyId"], {"label"}, True, "status",
             rules=[(f"act = 'add' AND (({_blank('locNo')}) OR EXISTS (SELECT 1 FROM md_Warehouse x WHERE x.companyId = r.companyId AND lower(x.locNo) = lower(r.locNo)))", "locNo"),
                    ("act = 'delete' AND EXISTS (SELECT 1 FROM inventoryBalanceWH x WHERE x.warehouseId = r.warehouseId AND x.balanceQty > 0)", "warehouseId")])
houses = lambda t: M.change_warehouses(t, t.sql(_WH))
_register("change_warehouses", lambda t: houses(t).applied, _wo)
register("change_warehouses_ship_tos", lambda t: houses(t).ship_tos.select("shipToId", "shipToLabel", "shipToAddressLine1", "country"), _wo.sql + f""", ch AS ({_wo._changed()})
SELECT d.shipToId, ch.label AS shipToLabel, ch.address AS shipToAddressLine1, ch.countryId AS country FROM md_ShipToDestination d JOIN ch ON ch.warehouseId = d.warehouseId AND ch.status = 1""")

# --- order headers and lines
_EDIT = """SELECT o_orderkey AS soHeaderId, 'edited' AS customerPO, o_custkey AS shipToId, CAST(o_orderdate + INTERVAL 50 DAY AS DATE) AS earlyShipDate, CAST(o_orderdate + INTERVAL 57 DAY AS DATE) AS lateShipDate,
    CASE WHEN o_orderkey % 3 = 0 THEN 'note' ELSE 'new note' END AS soNote FROM {orders}"""
edit = lambda t: M.edit_sales_orders(t, t.sql(_EDIT), AS_OF)
_ED = f"""WITH r AS (SELECT h.*, e.customerPO AS n1, e.shipToId AS n2, e.earlyShipDate AS n3, e.lateShipDate AS n4, e.soNote AS n5 FROM ({_EDIT}) e JOIN soHeader h ON h.soHeaderId = e.soHeaderId),
g AS (SELECT * FROM r WHERE soStatus IN (1105, 1106, 2144) AND n3 >= DATE '{AS_OF}' AND n4 >= DATE '{AS_OF}')"""
register("edit_sales_orders_errors", lambda t: edit(t).errors.drop("rule"), _ED + f"""
SELECT soHeaderId, 1 AS ruleNo, soName AS "key" FROM r WHERE soStatus NOT IN (1105, 1106, 2144) UNION ALL SELECT soHeaderId, 2, soName FROM r WHERE n3 < DATE '{AS_OF}' OR n4 < DATE '{AS_OF}'""")
register("edit_sales_orders_headers", lambda t: edit(t).headers.select("soHeaderId", "customerPO", "earlyShipDate", "portOfDestination", "soNote", "lastUpdatedDate"), _ED + f"""
SELECT g.soHeaderId, n1 AS customerPO, CAST(n3 AS VARCHAR) AS earlyShipDate, d.pod AS portOfDestination, n5 AS soNote,
       CASE WHEN soStatus = 2144 AND (n3 <> earlyShipDate OR soNote <> n5) THEN '{AS_OF}' ELSE CAST(lastUpdatedDate AS VARCHAR) END AS lastUpdatedDate FROM g LEFT JOIN md_ShipToDestination d ON d.shipToId = g.n2""")
register("edit_sales_orders_pos", lambda t: edit(t).po_headers.select("poId", "poEarlyShipDate", "poLateShipDate"), _ED + """
SELECT p.poId, CAST(n3 AS VARCHAR) AS poEarlyShipDate, CAST(CAST(n3 + INTERVAL 7 DAY AS DATE) AS VARCHAR) AS poLateShipDate FROM poHeader p JOIN g ON g.soName = p.poReferenceId AND g.soStatus = 2144 AND g.n3 <> g.earlyShipDate""")

_LINES = """SELECT concat(l_orderkey, '-', l_partkey) AS changeId, l_orderkey AS soHeaderId, concat(o_custkey, '-', l_partkey) AS customerskuId, {line} AS soLineItemId, CAST(min(floor(l_extendedprice * 100 / l_quantity)) AS BIGINT) AS csCost,
    CAST(5 AS INT) AS odrQty, 'typed' AS itemNote, CAST(3235 + l_orderkey % 2 AS INT) AS tagDivision FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey {where} GROUP BY l_orderkey, l_partkey, o_custkey"""
# lines of an order are asked for again under the customer's own SKU text
_ADD = _LINES.format(line="CAST(NULL AS VARCHAR(40))", where="")
_LID = "min(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey))"
_FULL = _LINES.format(line=f"CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE {_LID} END", where="WHERE l_linenumber < 5")
_PRICED = """p AS (SELECT c.*, h.soStatus, k.invID, k.customerSku, k.merchantSKU, k.EAN, CASE WHEN c.csCost <> k.csCost THEN 1 ELSE 0 END AS isItemPriceChanged, m.categoryName AS currencyCode, k.itemDesc AS soItemDesc
    FROM c LEFT JOIN soHeader h ON h.soHeaderId = c.soHeaderId LEFT JOIN md_CustomerSku k ON k.statusflag = 1 AND k.customerskuId = c.customerskuId AND k.companyId = h.companyId AND k.customerId = h.customerId
    LEFT JOIN md_MasterCategory m ON m.categoryId = k.currencyCode)"""
_UNPRICED = [("soStatus IS NULL", "soHeaderId"), ("soStatus IS NOT NULL AND invID IS NULL", "customerskuId"), ("invID IS NOT NULL AND currencyCode IS NULL", "customerSku")]
_UNPRICED_ANY = " OR ".join(f"({c})" for c, _ in _UNPRICED)
_UNPRICED_ERR = "".join(f" UNION ALL SELECT soHeaderId, changeId, {n} AS ruleNo, CAST({k} AS VARCHAR) FROM r WHERE {c}" for n, (c, k) in enumerate(_UNPRICED, 3))


def _own_sku(t):
    """Order lines of even orders carry the customer's own SKU text, as orders loaded from files do."""
    lines, heads = t.soLineItem, t.soHeader.select("soHeaderId", "customerId")
    text = F.when(F.col("soHeaderId") % 2 == 0, F.concat(F.lit("CS-"), F.col("customerId").cast("string"), F.lit("-"), F.col("invID").cast("string"))).otherwise(F.col("customerSku"))
    return t.replace(soLineItem=lines.join(heads, "soHeaderId").withColumn("customerSku", text).select(*lines.columns))


_SL = """sl AS (SELECT s.* REPLACE (CASE WHEN s.soHeaderId % 2 = 0 THEN 'CS-' || h.customerId || '-' || s.invID ELSE s.customerSku END AS customerSku) FROM soLineItem s JOIN soHeader h ON h.soHeaderId = s.soHeaderId)"""
add = lambda t: M.add_sales_order_lines(_own_sku(t), t.sql(_ADD), AS_OF)
_AD = f"""WITH c AS ({_ADD}), {_PRICED}, {_SL},
o AS (SELECT soHeaderId, customerSku, bool_or(soLineItemStatus <> 1107) AS live, min(soLineItemId) AS line FROM sl GROUP BY ALL),
r AS (SELECT p.*, coalesce(o.live, false) AS live, o.line FROM p LEFT JOIN o ON o.soHeaderId = p.soHeaderId AND o.customerSku = p.customerSku),
g AS (SELECT * FROM r WHERE soHeaderId NOT IN (SELECT soHeaderId FROM r WHERE live OR {_UNPRICED_ANY}))"""
register("add_sales_order_lines_errors", lambda t: add(t).errors.drop("rule"), _AD + """ SELECT soHeaderId, changeId, 1 AS ruleNo, customerSku AS "key" FROM r WHERE live""" + _UNPRICED_ERR)
register("add_sales_order_lines_added", lambda t: add(t).added.select("changeId", "soHeaderId", "invID", "customerSku", "currencyCode", "csCost", "odrQty", "soLineItemStatus"), _AD + """
SELECT changeId, soHeaderId, invID, customerSku, currencyCode, csCost, odrQty, 1105 AS soLineItemStatus FROM g WHERE line IS NULL""")
register("add_sales_order_lines_revived", lambda t: add(t).changed.select("soLineItemId", "odrQty", "itemNote", "soLineItemStatus"), _AD + """
SELECT line AS soLineItemId, odrQty, itemNote, 1105 AS soLineItemStatus FROM g WHERE line IS NOT NULL""")
register("add_sales_order_lines_headers", lambda t: add(t).headers.select("soHeaderId", "lastUpdatedDate"), _AD + f" SELECT DISTINCT soHeaderId, '{AS_OF}' AS lastUpdatedDate FROM g WHERE soStatus <> 1105")

full = lambda t: M.replace_sales_order_lines(t, t.sql(_FULL), AS_OF)
_FU = f"""WITH c AS ({_FULL}), {_PRICED},
r AS (SELECT p.*, p.soLineItemId IS NULL AND EXISTS (SELECT 1 FROM soLineItem s WHERE s.soHeaderId = p.soHeaderId AND s.customerSku = p.customerSku) AS dup FROM p),
g AS (SELECT * FROM r WHERE soHeaderId NOT IN (SELECT soHeaderId FROM r WHERE dup OR {_UNPRICED_ANY})), od AS (SELECT DISTINCT soHeaderId, soStatus FROM g),
w AS (SELECT s.*, od.soStatus, g.soLineItemId AS hit, g.odrQty AS nq, g.tagDivision AS nt FROM soLineItem s JOIN od ON od.soHeaderId = s.soHeaderId LEFT JOIN g ON g.soLineItemId = s.soLineItemId)"""
register("replace_sales_order_lines_errors", lambda t: full(t).errors.drop("rule"), _FU + """ SELECT soHeaderId, changeId, 1 AS ruleNo, customerSku AS "key" FROM r WHERE dup""" + _UNPRICED_ERR)
register("replace_sales_order_lines_added", lambda t: full(t).added.select("changeId", "soHeaderId", "customerSku", "odrQty", "soLineItemStatus"), _FU + """
SELECT changeId, soHeaderId, customerSku, odrQty, 1105 AS soLineItemStatus FROM g WHERE soLineItemId IS NULL""")
register("replace_sales_order_lines_changed", lambda t: full(t).changed.select("soLineItemId", "odrQty", "soLineItemStatus"), _FU + """
SELECT soLineItemId, nq AS odrQty, 1105 AS soLineItemStatus FROM w WHERE hit IS NOT NULL AND soLineItemStatus IN (2144, 1105) UNION ALL SELECT soLineItemId, 0, 1107 FROM w WHERE hit IS NULL AND soStatus <> 1105""")
register("replace_sales_order_lines_deleted", lambda t: full(t).deleted.select("soLineItemId"), _FU + " SELECT soLineItemId FROM w WHERE hit IS NULL AND soStatus = 1105")
register("replace_sales_order_lines_headers", lambda t: full(t).headers.select("soHeaderId", "soStatus", "apiStatus", "lastUpdatedDate"), _FU + f"""
, kp AS (SELECT soHeaderId, CASE WHEN soLineItemStatus IN (2144, 1105) THEN nt ELSE tagDivision END AS tag FROM w WHERE hit IS NOT NULL AND soLineItemStatus <> 1107
         UNION ALL SELECT soHeaderId, tagDivision FROM g WHERE soLineItemId IS NULL),
tg AS (SELECT soHeaderId, bool_and(tag <> 3234) AS tagged FROM kp GROUP BY 1)
SELECT h.soHeaderId, CASE WHEN x.isMarketing = 0 AND coalesce(tagged, false) THEN 1106 ELSE h.soStatus END AS soStatus, CASE WHEN x.isMarketing = 0 AND coalesce(tagged, false) THEN '_NEW_' ELSE h.apiStatus END AS apiStatus,
       CASE WHEN h.soStatus <> 1105 THEN '{AS_OF}' ELSE CAST(h.lastUpdatedDate AS VARCHAR) END AS lastUpdatedDate
FROM soHeader h JOIN od ON od.soHeaderId = h.soHeaderId LEFT JOIN tg ON tg.soHeaderId = h.soHeaderId LEFT JOIN md_Company x ON x.companyId = h.companyId""")

# --- PO lines, request lines
_POL = """SELECT podetailsId AS changeId, CASE WHEN qty % 4 = 0 THEN 'Update' WHEN qty % 4 = 1 THEN 'Delete' ELSE 'Add' END AS actionType, CASE WHEN qty % 4 IN (0, 1) THEN podetailsId END AS podetailsId, poId,
    unitPrice + 10 AS unitPrice, CAST(CASE WHEN qty % 8 = 0 THEN qty + 1 ELSE qty - 1 END AS INT) AS qty, 'fixed' AS itemNote FROM poLineItem"""
pol = lambda t: M.edit_purchase_order_lines(t, t.sql(_POL))
_pl = Oracle("poLineItem", "podetailsId", f"SELECT q.*, h.foreignCurrencyRate AS rate, s.odrQty AS odr FROM ({_POL}) q LEFT JOIN poHeader h ON h.poId = q.poId LEFT JOIN poLineItem l ON l.podetailsId = q.podetailsId LEFT JOIN soLineItem s ON s.soLineItemId = l.soLineItemId",
             ["poId", "unitPrice", "qty", "itemNote"], rules=[("act = 'update' AND qty > odr", "podetailsId"), ("rate IS NULL", "poId")])
_register("edit_purchase_order_lines", lambda t: pol(t).applied, _pl)
register("edit_purchase_order_lines_deleted", lambda t: pol(t).applied.deleted.select("podetailsId"), _pl.deleted())
register("edit_purchase_order_lines_order_lines", lambda t: pol(t).so_lines.select("soLineItemId", "poQty"), _pl.sql + f""", ch AS ({_pl._changed()})
SELECT l.soLineItemId, CAST(ch.qty AS INT) AS poQty FROM ch JOIN poLineItem l ON l.podetailsId = ch.podetailsId WHERE l.qty <> ch.qty""")
register("edit_purchase_order_lines_headers", lambda t: pol(t).headers.select("poId", "poNetTotal", "poGrossTotal"), _pl.sql + f""", ch AS ({_pl._changed()}),
af AS (SELECT l.poId, coalesce(ch.unitPrice, l.unitPrice) AS p, coalesce(ch.qty, l.qty) AS q, l.itemStatus AS s FROM poLineItem l LEFT JOIN ch ON ch.podetailsId = l.podetailsId
       WHERE l.podetailsId NOT IN (SELECT podetailsId FROM la WHERE act = 'delete') UNION ALL SELECT poId, unitPrice, qty, 1079 FROM ok WHERE act = 'add'),
tc AS (SELECT poId FROM ch UNION SELECT l.poId FROM la JOIN poLineItem l ON l.podetailsId = la.podetailsId WHERE act = 'delete' UNION SELECT poId FROM ok WHERE act = 'add')
SELECT tc.poId, coalesce(CAST(sum(CASE WHEN s <> 1086 THEN p * q END) AS BIGINT), 0) AS poNetTotal, coalesce(CAST(sum(CASE WHEN s <> 1086 THEN p * q END) AS BIGINT), 0) AS poGrossTotal
FROM tc LEFT JOIN af ON af.poId = tc.poId GROUP BY tc.poId""")
_LRL = """SELECT lrDetailsId AS changeId, CASE WHEN qty % 3 = 0 THEN 'Add' WHEN qty % 3 = 1 THEN 'Update' ELSE 'Delete' END AS actionType, CASE WHEN qty % 3 = 0 THEN NULL ELSE lrDetailsId END AS lrDetailsId, lrHeaderId,
    CASE WHEN qty % 6 = 0 THEN lrContainerId + 7 ELSE lrContainerId END AS lrContainerId, poDetailsId, CAST(CASE WHEN qty % 5 = 0 THEN 90 ELSE 2 END AS INT) AS qty, 'more' AS itemNote FROM lrLineItem"""
lrl = lambda t: M.edit_request_lines(t, t.sql(_LRL))
_LL = f"""WITH c AS ({_LRL}), h AS (SELECT lrContainerId, poDetailsId, min(lrDetailsId) AS has FROM lrLineItem GROUP BY ALL),
r0 AS (SELECT c.* REPLACE (CASE WHEN actionType = 'Add' AND h.has IS NOT NULL THEN h.has ELSE c.lrDetailsId END AS lrDetailsId), h.has FROM c LEFT JOIN h ON h.lrContainerId = c.lrContainerId AND h.poDetailsId = c.poDetailsId),
r1 AS (SELECT r0.*, l.qty AS old, l.itemNote AS oldNote, l.itemStatus AS state, coalesce(l.poDetailsId, r0.poDetailsId) AS po FROM r0 LEFT JOIN lrLineItem l ON l.lrDetailsId = r0.lrDetailsId),
r2 AS (SELECT r1.*, CASE WHEN actionType = 'Delete' THEN 0 WHEN actionType = 'Add' AND has IS NOT NULL THEN old + qty ELSE qty END - coalesce(old, 0) AS diff FROM r1),
r AS (SELECT r2.*, p.lrQty AS plr, p.qty AS pq, sum(diff) OVER (PARTITION BY po) AS total FROM r2 LEFT JOIN poLineItem p ON p.podetailsId = r2.po),
g AS (SELECT * FROM r WHERE NOT (state IS NOT NULL AND state NOT IN (2132, 2134, 2145)) AND NOT (actionType <> 'Add' AND state IS NULL) AND NOT coalesce(diff > 0 AND plr + total > pq, false) AND NOT (actionType = 'Add' AND pq IS NULL))"""
register("edit_request_lines_errors", lambda t: lrl(t).errors.drop("rule"), _LL + """
SELECT changeId, 1 AS ruleNo, lrDetailsId AS "key" FROM r WHERE state IS NOT NULL AND state NOT IN (2132, 2134, 2145) UNION ALL SELECT changeId, 2, lrDetailsId FROM r WHERE actionType <> 'Add' AND state IS NULL
UNION ALL SELECT changeId, 3, po FROM r WHERE diff > 0 AND plr + total > pq UNION ALL SELECT changeId, 4, po FROM r WHERE actionType = 'Add' AND pq IS NULL""")
register("edit_request_lines_added", lambda t: lrl(t).added.select("changeId", "lrName", "lrContainerId", "poId", "soHeaderId", "supplierSku", "qty"), _LL + """
SELECT g.changeId, h.lrName, g.lrContainerId, p.poId, s.soHeaderId, p.supplierSku, g.qty FROM g JOIN lrHeader h ON h.lrHeaderId = g.lrHeaderId JOIN poLineItem p ON p.podetailsId = g.poDetailsId LEFT JOIN soLineItem s ON s.soLineItemId = p.soLineItemId
WHERE g.actionType = 'Add' AND g.has IS NULL""")
register("edit_request_lines_changed", lambda t: lrl(t).changed.select("lrDetailsId", "qty", "itemNote"), _LL + """
SELECT lrDetailsId, CAST(old + diff AS INT) AS qty, CASE WHEN actionType = 'Add' AND oldNote <> '' THEN oldNote || ', ' || itemNote ELSE itemNote END AS itemNote FROM g WHERE actionType = 'Update' OR (actionType = 'Add' AND has IS NOT NULL)""")
register("edit_request_lines_deleted", lambda t: lrl(t).deleted.select("lrDetailsId"), _LL + " SELECT lrDetailsId FROM g WHERE actionType = 'Delete'")
register("edit_request_lines_po_lines", lambda t: lrl(t).po_lines.select("podetailsId", "lrQty"), _LL + " SELECT po AS podetailsId, CAST(plr + sum(diff) AS INT) AS lrQty FROM g WHERE pq IS NOT NULL GROUP BY po, plr")

# --- containers, bookings, shipments
_BOX = """SELECT lrHeaderId, containerSeq, CASE WHEN containerSeq = 1 THEN '' ELSE concat('BX', lrHeaderId) END AS containerNo, CASE WHEN lrHeaderId % 8 = 0 THEN NULL ELSE 'S1' END AS containerSealNo, 3155 AS containerTypeId FROM lrContainer"""
register("edit_containers", lambda t: M.edit_containers(t, t.sql(_BOX)).select("lrContainerId", "containerNo", "containerSealNo", "containerTypeId"), f"""
SELECT x.lrContainerId, CASE WHEN c.containerNo = '' THEN x.containerNo ELSE c.containerNo END AS containerNo, coalesce(c.containerSealNo, '') AS containerSealNo, c.containerTypeId
FROM lrContainer x JOIN ({_BOX}) c ON c.lrHeaderId = x.lrHeaderId AND c.containerSeq = x.containerSeq""")
_BOOK = """SELECT concat(lrHeaderId, '-', CASE WHEN lrHeaderId % 40 = 0 THEN '' ELSE CAST(earlyShipDate AS VARCHAR(20)) END) AS requestId, lrHeaderId, containerSeq, 3301 AS forwarderId, CASE WHEN lrHeaderId % 12 = 0 THEN '' ELSE concat('NB', lrHeaderId) END AS forwarderBookingNo, lateShipDate AS forwarderBookingDate,
    ETD, ETA, CAST(CASE WHEN lrHeaderId % 40 = 0 THEN containerSeq ELSE 3 END AS INT) AS portId FROM lrContainer WHERE lrHeaderId % 8 = 0"""
book = lambda t: M.book_containers(t, t.sql(_BOOK))
_BK = f"""WITH c AS ({_BOOK}), r AS (SELECT c.*, x.lrContainerId, x.lrName, min(c.portId) OVER (PARTITION BY requestId) <> max(c.portId) OVER (PARTITION BY requestId) AS ports,
    min(x.earlyShipDate) OVER (PARTITION BY requestId) <> max(x.earlyShipDate) OVER (PARTITION BY requestId) AS dates
    FROM c JOIN lrContainer x ON x.lrHeaderId = c.lrHeaderId AND x.containerSeq = c.containerSeq), g AS (SELECT * FROM r WHERE NOT ports AND NOT dates),
b AS (SELECT x.lrContainerId, x.lrHeaderId, g.forwarderBookingNo, g.portId FROM lrContainer x JOIN g ON g.lrContainerId = x.lrContainerId
      UNION SELECT x.lrContainerId, x.lrHeaderId, g.forwarderBookingNo, g.portId FROM lrContainer x JOIN g ON g.lrContainerId = x.ref_lrContainerId)"""
register("book_containers_containers", lambda t: book(t).containers.select("lrContainerId", "forwarderBookingNo", "portId"), _BK + " SELECT lrContainerId, forwarderBookingNo, portId FROM b")
register("book_containers_headers", lambda t: book(t).headers.select("lrHeaderId", "apiStatus"), _BK + " SELECT DISTINCT lrHeaderId, '_READYLOAD_' AS apiStatus FROM b WHERE forwarderBookingNo <> ''")
register("book_containers_errors", lambda t: book(t).errors.drop("rule"), _BK + """ SELECT requestId, lrContainerId, 1 AS ruleNo, lrName AS "key" FROM r WHERE dates
UNION ALL SELECT requestId, lrContainerId, 2, lrName FROM r WHERE ports""")
_FRT = """SELECT shipmentId, CASE WHEN shipmentId % 3 = 0 THEN '' ELSE 'NEWBOX' END AS containerNo, NULL AS containerSealNo, CAST(1 + shipmentId % 2 AS INT) AS haulierId, 3402 AS vesselId, ETA AS ETD, ETA FROM shipmentHeader WHERE shipmentStatus = 2150"""
_FRT_SPARK = _FRT.replace("NULL AS containerSealNo", "CAST(NULL AS VARCHAR(20)) AS containerSealNo")
register("edit_shipment_freight", lambda t: M.edit_shipment_freight(t, t.sql(_FRT_SPARK)).select("shipmentId", "containerNo", "containerSealNo", "haulierId", "vesselId", "ETD"), f"""
WITH c AS ({_FRT}), s AS (SELECT h.lrHeaderId, arg_max(c.haulierId, c.shipmentId) AS hl, arg_max(c.vesselId, c.shipmentId) AS vs FROM c JOIN shipmentHeader h ON h.shipmentId = c.shipmentId GROUP BY 1)
SELECT h.shipmentId, CASE WHEN c.shipmentId IS NULL OR c.containerNo = '' THEN h.containerNo ELSE c.containerNo END AS containerNo, CASE WHEN c.shipmentId IS NULL THEN h.containerSealNo ELSE '' END AS containerSealNo,
       s.hl AS haulierId, s.vs AS vesselId, CAST(CASE WHEN c.shipmentId IS NULL THEN h.ETD ELSE c.ETD END AS VARCHAR) AS ETD FROM shipmentHeader h JOIN s ON s.lrHeaderId = h.lrHeaderId LEFT JOIN c ON c.shipmentId = h.shipmentId""")
_SHE = """SELECT shipmentId, CASE WHEN shipmentId % 2 = 0 THEN NULL ELSE 'CI-new' END AS customerInvoiceNo, pickupAddrId, CASE WHEN shipmentId % 5 = 0 THEN shipToId + 1 ELSE shipToId END AS shipToId, 'Klang' AS pol, CAST(NULL AS VARCHAR(20)) AS pod,
    'ok' AS note FROM shipmentHeader"""
ships = lambda t: M.edit_shipments(t, t.sql(_SHE))
_SE = f"""WITH r AS (SELECT h.*, c.customerInvoiceNo AS n1, c.shipToId AS n2, w.companyId AS fc, d.companyId AS tc FROM ({_SHE}) c JOIN shipmentHeader h ON h.shipmentId = c.shipmentId
    LEFT JOIN md_Warehouse w ON w.warehouseId = c.pickupAddrId LEFT JOIN md_ShipToDestination d ON d.shipToId = c.shipToId)"""
register("edit_shipments_headers", lambda t: ships(t).headers.select("shipmentId", "customerInvoiceNo", "shipToId", "pol", "pod", "note"), _SE + """
SELECT shipmentId, coalesce(n1, customerInvoiceNo) AS customerInvoiceNo, n2 AS shipToId, 'Klang' AS pol, pod, 'ok' AS note FROM r WHERE NOT (coalesce(fc <> companyId, false) OR coalesce(tc <> companyId, false))""")
register("edit_shipments_errors", lambda t: ships(t).errors.drop("rule"), _SE + """
SELECT shipmentId, 1 AS ruleNo, CAST(pickupAddrId AS VARCHAR) AS "key" FROM r WHERE fc <> companyId UNION ALL SELECT shipmentId, 2, CAST(n2 AS VARCHAR) FROM r WHERE tc <> companyId""")
