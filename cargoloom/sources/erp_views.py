"""Order-to-shipment tables derived from the star-schema Parquet tables.

Every view is one SQL text that Spark and DuckDB both run, so a registered
query and its oracle start from the same rows.  Rules kept here:

* no double -> decimal casts; money, weight and volume are integers (cents,
  grams, cubic cm) and currency rates are integers in millionths;
* no clock functions;
* line keys are built from the natural key, never from a global row number,
  so no view needs a single-task window;
* ``{orders}``-style names are the driver tables, bare names are other views.
"""

from __future__ import annotations

import re

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_LINE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_LR = "(l_orderkey - l_orderkey % 4)"
_WO = "(l_orderkey - l_orderkey % 5)"
_SUPPLIER = "(o_custkey % 3 + 3 * (o_orderkey % 3))"  # a supplier of the order's company
_CENTS = "CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT)"

# The document states, units, currencies and other codes every
# enriched view resolves (id, name, parent id).
_CODES = """
    (1105, 'Draft', 1104), (1106, 'Confirmed', 1104), (6237, 'Approved', 1104),
    (2125, 'In Production', 1104), (2144, 'Reopen', 1104), (1107, 'Cancel', 1104), (1108, 'Closed', 1104),
    (1079, 'Draft', 1076), (1080, 'Confirmed', 1076), (1085, 'Approved', 1076), (1078, 'Rejected', 1076),
    (1077, 'Released', 1076), (2143, 'On Hold', 1076), (1086, 'Cancelled', 1076), (1087, 'Closed', 1076),
    (2132, 'Draft', 2128), (2133, 'Confirmed', 2128), (2129, 'Approved', 2128), (2134, 'Rejected', 2128),
    (2135, 'Released', 2128), (2145, 'Reopened', 2128), (2130, 'Cancelled', 2128), (2131, 'Closed', 2128),
    (5230, 'Open', 5229), (5231, 'Closed', 5229), (5236, 'Cancelled', 5229),
    (2149, 'Open', 2148), (2150, 'Cancelled', 2148), (3159, 'Received', 3158),
    (2142, 'Pending', 1089), (1091, 'Confirmed', 1089), (1090, 'Closed', 1089),
    (1070, 'PCS', 1069), (1071, 'SET', 1069),
    (1120, 'USD', 1119), (1121, 'SGD', 1119), (1122, 'MYR', 1119),
    (1131, 'NET 30', 1130), (1132, 'NET 60', 1130),
    (2152, 'SHIP', 2151), (2153, 'REVSHIP', 2151), (2154, 'ADJ', 2151), (2155, 'SHIPADJ', 2151),
    (3154, '20GP', 3153), (3155, '40GP', 3153), (3156, '40HQ', 3153),
    (3194, 'color', 18), (1123, 'packing', 18), (3186, 'customer', 18),
    (3234, 'Untagged', 3233), (3235, 'Division A', 3233), (3236, 'Division B', 3233),
    (3301, 'Blue Line', 3300), (3302, 'Red Line', 3300), (3401, 'Vessel One', 3400), (3402, 'Vessel Two', 3400)
"""

_SO_STATUS = ("CASE {k} % 7 WHEN 0 THEN 1105 WHEN 1 THEN 1106 WHEN 2 THEN 6237 WHEN 3 THEN 2125 "
              "WHEN 4 THEN 2144 WHEN 5 THEN 1107 ELSE 1108 END")
_PO_STATUS = ("CASE WHEN {k} % 32 BETWEEN 8 AND 11 OR {k} % 32 BETWEEN 16 AND 19 THEN 1077 ELSE CASE {k} % 8 WHEN 0 THEN 1079 WHEN 1 THEN 1080 WHEN 2 THEN 1085 WHEN 3 THEN 1078 "
              "WHEN 4 THEN 1077 WHEN 5 THEN 2143 WHEN 6 THEN 1086 ELSE 1087 END END")
_LR_STATUS = ("CASE {k} % 32 WHEN 0 THEN 2132 WHEN 4 THEN 2133 WHEN 8 THEN 2129 WHEN 12 THEN 2134 "
              "WHEN 16 THEN 2135 WHEN 20 THEN 2145 WHEN 24 THEN 2130 ELSE 2131 END")

VIEWS: dict[str, str] = {
    "md_MasterCategory": f"""
        SELECT categoryId, categoryName, categoryParentID, 1 AS status
        FROM (VALUES {_CODES}) AS t(categoryId, categoryName, categoryParentID)
        UNION ALL
        SELECT CAST(n_nationkey AS INT), n_name, 2, 1 FROM {{nation}}""",
    "md_MasterCategoryAttribute": """
        SELECT * FROM (VALUES
            (1, 3154, 'CBM', '28 m3', 1), (2, 3155, 'CBM', '58 m3', 1), (3, 3156, 'CBM', '67 m3', 1),
            (4, 3154, 'WEIGHT', '21000 kg', 1), (5, 3155, 'WEIGHT', '26000 kg', 1), (6, 3156, 'WEIGHT', '26500 kg', 1),
            (7, 3154, 'DIMENSION', '20 ft', 1), (8, 3155, 'DIMENSION', '40 ft', 1), (9, 3156, 'DIMENSION', '40 ft high', 1)
        ) AS t(attributeId, masterCategoryId, attributeName, attributeValue, statusFlag)""",
    "md_Company": """
        SELECT * FROM (VALUES
            (1, 'Harbour Marketing', 'HBM', 1, '1 Quay Street', 'Level 2', 'Singapore', '', '018956', 3, '6501', '6511'),
            (2, 'Northern Works', 'NOW', 0, '22 Mill Road', '', 'Johor', 'Johor', '81100', 22, '6502', '6512'),
            (3, 'Lakeside Trading', 'LKT', 1, '5 Dock Lane', 'Unit 9', 'Hull', 'Yorkshire', 'HU1', 7, '6503', '')
        ) AS t(companyId, companyName, companyShortCode, isMarketing, address, addressLine2, city, state, postcode, country, telephoneNumber, faxNumber)""",
    "md_Warehouse": """
        SELECT * FROM (VALUES
            (1, 1, 'L1', 'MAIN', 'Quay 1', '', 'Singapore', '', '018956', 3, '6501', 1),
            (2, 2, 'L2', 'L2', 'Mill 2', '', 'Johor', 'Johor', '81100', 22, '6502', 1),
            (3, 3, 'L3', 'LAKE', 'Dock 3', 'Bay 3', 'Hull', 'Yorkshire', 'HU1', 7, '6503', 1),
            (4, 1, 'L4', 'ANNEX', 'Quay 4', '', 'Singapore', '', '018957', 3, '6504', 1)
        ) AS t(warehouseId, companyId, locNo, label, address, addressLine2, city, state, postcode, countryId, phone, status)""",
    "md_Port": """
        SELECT * FROM (VALUES (1, 'POD', 'Antwerp', 1), (2, 'POD', 'Busan', 1), (3, 'POD', 'Cadiz', 1),
            (4, 'POD', 'Durban', 1), (5, 'POD', 'Ennore', 1)) AS t(portId, portType, portName, statusFlag)""",
    "md_haulier": """
        SELECT * FROM (VALUES (1, 'Swift Haul', 1), (2, 'Stone Haul', 1)) AS t(haulierId, haulier, statusFlag)""",
    "md_User": """
        SELECT DISTINCT user_id AS userId, concat('user', user_id) AS userName, CAST(1 + user_id % 3 AS INT) AS companyId,
               CASE WHEN user_id % 6 = 4 THEN 0 ELSE 1 END AS status FROM {events}""",
    "md_Role": """
        SELECT * FROM (VALUES (1, 'planning'), (2, 'loading'), (3, 'sales')) AS t(roleId, roleName)""",
    "companyRole": """
        SELECT * FROM (VALUES (11, 1, 1), (12, 1, 2), (13, 1, 3), (21, 2, 1), (22, 2, 2), (23, 2, 3), (31, 3, 1), (32, 3, 2), (33, 3, 3))
            AS t(companyRoleId, companyId, roleId)""",
    "userRole": """
        SELECT DISTINCT user_id * 2 AS userRoleId, user_id AS userId, CAST(10 * (1 + user_id % 3) + 1 + user_id % 2 AS INT) AS userrolecompanyroleid FROM {events}
        UNION ALL
        SELECT DISTINCT user_id * 2 + 1, user_id, CAST(10 * (1 + user_id % 3) + 3 AS INT) FROM {events} WHERE user_id % 4 < 3""",
    "companyRoleFunction": """
        SELECT * FROM (VALUES (1, 11, 1018, 1, 1, 0), (2, 13, 1018, 0, 1, 0), (3, 21, 1018, 1, 0, 1), (4, 22, 1020, 1, 1, 1),
            (5, 31, 1018, 0, 0, 0), (6, 33, 1018, 0, 1, 1)) AS t(companyRoleFunctionId, companyRoleId, menuLevel2Id, functionAdd, functionEdit, functionDelete)""",
    "md_DefaultConfig": """
        SELECT * FROM (VALUES (1, 0, 'CargoReadyDate', '14'), (2, 2, 'CargoReadyDate', '10'), (3, 0, 'DefaultCurrency', 'SGD'),
            (4, 2, 'DefaultCurrency', 'MYR'), (5, 0, 'VesselBooking', 'FOB'), (6, 1, 'PackingUnit', 'CTN'))
            AS t(configId, companyId, configName, configValue)""",
    "md_CompanyBank": """
        SELECT * FROM (VALUES (1, 1, '100-200', 1), (2, 2, '300-400', 1)) AS t(bankId, companyId, accountNumber, statusFlag)""",
    "md_termNCondition": """
        SELECT * FROM (VALUES (1, 0, 'SO', 1, 'Payment before loading', 1), (1, 0, 'SO', 2, 'Goods remain ours until paid', 1),
            (2, 0, 'SO', 1, 'Ex works', 1), (2, 4, 'SO', 1, 'Free on board', 1), (3, 0, 'PI', 1, 'Valid for 30 days', 1), (1, 9, 'SO', 1, 'Old', 0))
            AS t(companyId, customerId, module, termRow, termText, statusFlag)""",
    "md_SupplierTerm": """
        SELECT * FROM (VALUES (1, 0, 'PO', 1, 'Deliver on time', 1), (1, 1, 'PO', 1, 'Label every carton', 1), (2, 2, 'PO', 1, 'Old clause', 0),
            (2, 3, 'PO', 1, 'Send samples', 1), (2, 3, 'PO', 2, 'Send papers', 1)) AS t(companyId, supplierId, module, termRow, termCondition, statusFlag)""",
    "md_reportAdditionalRemarks": """
        SELECT * FROM (VALUES (1, 0, 'SO', 1, 'Marks', 'Check marks and numbers', 1), (2, 0, 'SO', 1, 'Packing', 'Pack in export cartons', 1),
            (2, 4, 'SO', 1, 'Packing', 'Pallets only', 1), (3, 0, 'SO', 1, 'Shipment', 'No part shipment', 1), (3, 0, 'SO', 2, 'Old', 'Gone', 0))
            AS t(companyId, customerId, module, lineNum, remarksName, remarks, statusFlag)""",
    "md_InventoryHTSCode": """
        SELECT * FROM (VALUES (11, '9403.20'), (12, '9403.60'), (13, '9404.10'), (15, '9405.10')) AS t(HTSCode_prodCategoryId, HTSCode)""",
    "md_CurrencyRate": """
        SELECT CAST(year(o_orderdate) * 10 + 1 + o_custkey % 3 AS INT) AS rateId, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               make_date(CAST(year(o_orderdate) AS INT), 1, 1) AS startDate,
               make_date(CAST(year(o_orderdate) AS INT), CASE WHEN o_custkey % 3 = 2 AND year(o_orderdate) % 2 = 0 THEN 6 ELSE 12 END, 30) AS endDate,
               CASE WHEN o_custkey % 3 = 1 THEN 'MYR' ELSE 'SGD' END AS homeCurrency, 'USD' AS foreignCurrency,
               CAST(1300000 + count(*) % 97 * 1000 AS BIGINT) AS foreignRate, 1 AS status
        FROM {orders} GROUP BY o_custkey % 3, year(o_orderdate)
        UNION ALL
        SELECT CAST(year(o_orderdate) * 10 + 5 AS INT), 1, make_date(CAST(year(o_orderdate) AS INT), 4, 1), make_date(CAST(year(o_orderdate) AS INT), 5, 31),
               'SGD', 'USD', CAST(1400000 + count(*) % 89 * 1000 AS BIGINT), CASE WHEN year(o_orderdate) % 3 = 0 THEN 0 ELSE 1 END
        FROM {orders} GROUP BY year(o_orderdate)""",
    "md_SequenceNumber": """
        SELECT * FROM (VALUES (1, 1, 'PO', 'P1-yy-xxxxx', 41, 99999), (2, 2, 'PO', 'P2-yy-xxxxx', 7, 99999), (3, 3, 'PO', 'P3yyxxxxx', 99990, 99999),
            (4, 1, 'WO', 'W1-yy-xxxxx', 1, 99999), (5, 2, 'WO', 'W2-yy-xxxxx', 1, 99999), (6, 3, 'WO', 'W3-yy-xxxxx', 500, 99999),
            (7, 1, 'SO', 'S1-yy-xxxxx', 1, 99999), (8, 2, 'SO', 'S2-yy-xxxxx', 1, 99999), (9, 3, 'SO', 'S3-yy-xxxxx', 1, 99999),
            (10, 1, 'SHIP', 'H1-yy-xxxxx', 1, 99999), (11, 2, 'SHIP', 'H2-yy-xxxxx', 1, 99999), (12, 3, 'SHIP', 'H3-yy-xxxxx', 1, 99999),
            (13, 1, 'BOL', 'B1-yy-xxxxx', 1, 99999), (14, 2, 'BOL', 'B2-yy-xxxxx', 1, 99999), (15, 3, 'BOL', 'B3-yy-xxxxx', 1, 99999),
            (16, 1, 'INV', 'I1-yy-xxxxx', 1, 99999), (17, 2, 'INV', 'I2-yy-xxxxx', 1, 99999), (18, 3, 'INV', 'I3-yy-xxxxx', 1, 99999),
            (19, 1, 'LR', 'L1-yy-xxxxx', 1, 99999), (20, 2, 'LR', 'L2-yy-xxxxx', 1, 99999), (21, 3, 'LR', 'L3-yy-xxxxx', 1, 99999))
            AS t(Id, csID, condition, ItemFormat, NextNum, MaxNum)""",
    "md_EmailCategory": """
        SELECT * FROM (VALUES (1, 'New SO', 1), (2, 'Cancel SO', 1), (3, 'Reopen SO', 1), (4, 'Released LR', 1), (5, 'Ready LR', 1), (6, 'New WO', 1),
            (7, 'Shipment ASN', 1), (8, 'Shipment RTG', 1)) AS t(emailCategoryId, actionName, status)""",
    "md_EmailList": """
        SELECT DISTINCT user_id * 10 + user_id % 8 AS emailListId, CAST(1 + user_id % 3 AS INT) AS companyId, CAST(1 + user_id % 8 AS INT) AS emailCategoryId,
               concat('user', user_id, '@example.test') AS emailAddress, CASE WHEN user_id % 5 = 4 THEN 0 ELSE 1 END AS status
        FROM {events}""",
    "md_Customer": """
        SELECT c_custkey AS customerId, CAST(1 + c_custkey % 3 AS INT) AS companyId,
               CASE WHEN c_custkey % 10 = 3 THEN CAST(1 + (c_custkey + 2) % 3 AS INT) ELSE 0 END AS internal_branchId,
               CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey - c_custkey % 10 END AS parent_customerId,
               c_name AS customerName, concat('C', c_custkey) AS customerShortCode,
               concat(c_mktsegment, ' Street') AS customerAddress,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('Unit ', c_custkey % 50) END AS customerAddressLine2,
               concat('City ', c_nationkey) AS customerCity,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('State ', c_nationkey) END AS customerStates,
               concat('P', c_custkey % 1000) AS customerPostcode, CAST(c_nationkey AS INT) AS customerCountry,
               concat('T', c_custkey) AS customerContactNumber, CAST(1131 + c_custkey % 2 AS INT) AS paymentTerm, 1 AS status
        FROM {customer}""",
    "md_Supplier": """
        SELECT s_suppkey AS supplierId, CAST(1 + s_suppkey % 3 AS INT) AS companyId,
               CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS internal_branchId, s_name AS supplierCompanyName,
               concat('Works ', s_suppkey) AS supplierAddress, '' AS supplierAddressLine2, concat('City ', s_nationkey) AS supplierCity,
               '' AS supplierStates, concat('S', s_suppkey) AS supplierPostcode, CAST(s_nationkey AS INT) AS supplierCountry,
               concat('T', s_suppkey) AS supplierContactNumber, CAST(1120 + s_suppkey % 3 AS INT) AS currencyCode,
               CAST(1131 + s_suppkey % 2 AS INT) AS paymentTerm, CASE WHEN s_suppkey % 13 = 12 THEN 0 ELSE 1 END AS status
        FROM {supplier}""",
    "partShape": """
        SELECT p_partkey, p_name, p_brand, p_type, p_size,
               CASE p_type WHEN 'ECONOMY' THEN 11 WHEN 'MEDIUM' THEN 12 WHEN 'PROMO' THEN 13
                           WHEN 'STANDARD' THEN 14 WHEN 'LARGE' THEN 15 ELSE 16 END AS cat,
               CAST(p_size % 3 AS INT) AS sub, CAST(replace(p_brand, 'Brand#', '') AS INT) AS brandNo
        FROM {part}""",
    "md_Inventory": """
        SELECT p_partkey AS invID, CAST(1 + p_partkey % 3 AS INT) AS companyId, CASE WHEN p_partkey % 4 = 1 THEN concat('00', sub, '.', lpad(CAST(p_partkey % 40 AS VARCHAR(20)), 4, '0'))
                    ELSE concat('IT', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0')) END AS itemCode,
               cat AS productCategory, cat * 10 + sub AS productSubCategory, (cat * 10 + sub) * 100 + brandNo AS productType,
               concat('M', p_size) AS modelNo, concat('SKU-', p_partkey) AS inventorySKU, p_name AS productName,
               concat(p_type, ' ', p_name) AS itemDesc, CAST(p_size * 9 AS BIGINT) AS netWeight, CAST(p_size * 10 AS BIGINT) AS grossWeight,
               CAST(p_size * 5 AS BIGINT) AS cbm, CAST(1070 + p_partkey % 2 AS INT) AS measurement, concat('G', p_size) AS glCode,
               CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS isVirtual, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS isBuffer,
               CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1 END AS status, concat('img/', p_partkey, '.png') AS thumbnailImage
        FROM partShape""",
    "md_InventoryCategory": """
        SELECT DISTINCT cat AS prodCategoryId, 0 AS companyId, p_type AS prodCategoryName, concat('0', cat) AS prodCategoryCode,
               1 AS prodCategoryParentID, 1 AS status, 0 AS isBuffer FROM partShape
        UNION ALL
        SELECT DISTINCT cat * 10 + sub, 0, concat(p_type, ' group ', sub), concat('00', sub), cat, 1, CASE WHEN sub = 2 THEN 1 ELSE 0 END FROM partShape""",
    "md_inventoryType": """
        SELECT DISTINCT (cat * 10 + sub) * 100 + brandNo AS inventoryTypeId, concat(p_type, ' ', p_brand) AS inventoryType,
               concat('T', brandNo) AS inventoryCode, 1 AS status, cat * 10 + sub AS prodCategoryId,
               CASE WHEN sub = 0 THEN '[ModelNo][space][Color]+[,]+[packing]' WHEN sub = 1 THEN '[COLOR]-[modelno]' ELSE '' END AS namingConvention
        FROM partShape""",
    "inventory_attributes": """
        SELECT p_partkey * 10 + 1 AS attributesId, p_partkey AS invID, 3194 AS categoryId, split_part(p_name, ' ', 1) AS value FROM {part}
        UNION ALL
        SELECT p_partkey * 10 + 2, p_partkey, 1123, concat('BOX-', p_size % 5) FROM {part} WHERE p_size % 4 <> 0""",
    "md_CustomerSku": """
        SELECT concat(o_custkey, '-', l_partkey) AS customerskuId, l_partkey AS invID, o_custkey AS customerId,
               CAST(1 + o_custkey % 3 AS INT) AS companyId, concat('CS-', o_custkey, '-', l_partkey) AS customerSku, concat('MS-', l_partkey) AS merchantSKU,
               concat('EAN', l_partkey) AS EAN, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('Item ', l_partkey) END AS itemDesc,
               1120 AS currencyCode, min(CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT)) AS csCost,
               CAST(3234 + l_partkey % 3 AS INT) AS tagDivision, CASE WHEN (o_custkey + l_partkey) % 9 = 0 OR l_partkey % 23 = 0 THEN 0 ELSE 1 END AS statusflag
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey <> 13 GROUP BY o_custkey, l_partkey
        UNION ALL
        SELECT concat('13-', p_partkey), p_partkey, CAST(13 AS BIGINT), 2, concat('CS-13-', p_partkey), concat('MS-', p_partkey), concat('EAN', p_partkey), concat('Item ', p_partkey),
               1120, CAST(p_size * 100 AS BIGINT), CAST(3234 + p_partkey % 3 AS INT), CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE 1 END
        FROM {part}""",
    "supplierOffer": f"""
        SELECT l_partkey AS part, {_SUPPLIER} AS supplier, min({_CENTS}) AS cents
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY l_partkey, {_SUPPLIER}
        UNION ALL
        SELECT l_partkey, l_suppkey, min({_CENTS}) FROM {{lineitem}} WHERE l_suppkey >= 9 GROUP BY l_partkey, l_suppkey""",
    "md_SupplierSku": """
        SELECT concat(part, '-', supplier) AS supplierskuId, part AS invId, supplier AS supplierId, CAST(1 + supplier % 3 AS INT) AS companyId,
               concat('SS-', supplier, '-', part) AS supplierSku, concat('Part ', part) AS itemDesc, CAST(1120 + supplier % 3 AS INT) AS currencyCode, cents AS supCost,
               CASE WHEN (part + supplier) % 2 = 0 THEN 1 ELSE 0 END AS isDefault, CASE WHEN (part + supplier) % 37 = 0 OR part % 23 = 0 THEN 0 ELSE 1 END AS statusflag
        FROM supplierOffer""",
    "md_ShipToDestination": """
        SELECT c_custkey AS shipToId, CAST(1 + c_custkey % 3 AS INT) AS companyId, c_custkey AS customerId, CAST(1 + c_custkey % 4 AS INT) AS warehouseId,
               concat('L', 1 + c_custkey % 4) AS locNo, concat('Store ', c_custkey) AS shipToName, concat('ST-', c_custkey % 100) AS shipToLabel,
               concat(c_mktsegment, ' Road') AS shipToAddressLine1, concat('City ', c_nationkey) AS shipToCity, concat('P', c_custkey % 1000) AS shipToPostCode,
               CAST(c_nationkey AS INT) AS country, CAST(1 + c_custkey % 5 AS INT) AS pod
        FROM {customer}""",
    "soHeader": f"""
        SELECT o_orderkey AS soHeaderId, CAST(1 + o_custkey % 3 AS INT) AS companyId, o_custkey AS customerId, {_SUPPLIER} AS supplierId,
               concat('SO-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS soName, CAST(o_orderdate AS DATE) AS soDate,
               CASE WHEN o_orderkey % 5 = 0 THEN concat('PO', o_orderkey % 5000, ', PO', o_orderkey % 4000)
                    WHEN o_orderkey % 4 = 1 THEN concat('P-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0'))
                    ELSE concat('PO', o_orderkey % 5000) END AS customerPO,
               CASE WHEN o_custkey % 10 = 3 THEN concat('SO-', lpad(CAST(o_orderkey - o_orderkey % 10 AS VARCHAR(20)), 9, '0')) ELSE '' END AS reference1,
               'Singapore' AS portOfLanding, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 3 DAY AS DATE) END AS lastUpdatedDate,
               CAST(3401 + o_custkey % 2 AS INT) AS shipWay,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('TP', o_custkey % 7) ELSE '' END AS thirdParty,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('TPO', o_orderkey % 900) ELSE '' END AS thirdPartyPO, o_custkey AS shipToId,
               CAST(1 + o_custkey % 5 AS INT) AS portOfDestination, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS earlyShipDate,
               CAST(o_orderdate + INTERVAL 37 DAY AS DATE) AS lateShipDate, CASE WHEN o_orderkey % 3 = 0 THEN 'note' ELSE '' END AS soNote,
               CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('L', 1 + o_custkey % 4) END AS locNo, 'FOB' AS vesselBooking,
               CASE o_orderkey % 8 WHEN 0 THEN '_NEW_' WHEN 1 THEN '_CXL_' WHEN 2 THEN '_REOP_' WHEN 3 THEN '_ACK_' ELSE '' END AS apiStatus,
               CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS revised, {_SO_STATUS.format(k='o_orderkey')} AS soStatus
        FROM {{orders}}""",
    "soLineItem": f"""
        SELECT {_LINE_ID} AS soLineItemId, l_orderkey AS soHeaderId, l_partkey AS invID, l_suppkey AS supplierId,
               concat('CS-', l_partkey) AS customerSku, concat('MS-', l_partkey) AS merchantSku, concat('EAN', l_partkey) AS EAN, 'USD' AS currencyCode,
               {_CENTS} AS csCost, CAST(l_quantity AS INT) AS odrQty,
               CAST(CASE WHEN l_orderkey % 7 IN (0, 2) THEN 0 WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 2) END AS INT) AS poQty,
               CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 4) END AS INT) AS processQty,
               CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN floor(l_quantity / 3) ELSE 0 END AS INT) AS shpQty,
               CASE WHEN l_linenumber = 7 THEN 1107 WHEN l_linenumber = 6 THEN 1108 WHEN l_orderkey % 7 = 2 THEN 6237 WHEN l_linenumber = 5 THEN 1105 WHEN l_linestatus = 'F' THEN 2125 ELSE 1106 END AS soLineItemStatus,
               CAST(3234 + l_linenumber % 3 AS INT) AS tagDivision, CASE WHEN l_linenumber = 1 THEN '' ELSE concat('Desc ', l_partkey) END AS soItemDesc,
               concat('R', l_suppkey) AS itemReference1, concat('E', l_partkey) AS itemReference2, '' AS itemNote,
               CASE WHEN l_linenumber % 2 = 0 OR l_orderkey % 32 BETWEEN 8 AND 11 THEN {_LINE_ID} END AS ref_poLineItemId
        FROM {{lineitem}}""",
    "poHeader": f"""
        SELECT o_orderkey AS poId, CAST(1 + o_custkey % 3 AS INT) AS companyId, {_SUPPLIER} AS supplierId,
               concat('P-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS poName, CAST(o_orderdate + INTERVAL 5 DAY AS DATE) AS poDate,
               concat('SO-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS poReferenceId, o_custkey AS shipToId, CAST(3401 + o_custkey % 3 AS INT) AS shipVia, 'Singapore' AS portOfLanding,
               CAST(1 + o_custkey % 5 AS INT) AS portOfDestination, concat('PO', o_orderkey % 5000, ', PO', o_orderkey % 4000) AS reference1,
               CAST(o_orderdate + INTERVAL 20 DAY AS DATE) AS poEarlyShipDate, CAST(o_orderdate + INTERVAL 27 DAY AS DATE) AS poLateShipDate,
               {_PO_STATUS.format(k='o_orderkey')} AS poStatus, CAST(floor(o_totalprice * 100) AS BIGINT) AS poGrossTotal,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('2x40HQ + 1x20GP lot ', o_orderkey % 10) WHEN o_orderkey % 3 = 1 THEN '1x40GP' ELSE '' END AS poNote,
               concat('C', o_custkey) AS customerCode, 'USD' AS foreignCurrencyCode, 'SGD' AS homeCurrencyCode, 1350000 AS foreignCurrencyRate,
               CAST(1 + o_custkey % 4 AS INT) AS warehouseId, concat('L', 1 + o_custkey % 4) AS locNo, 'FOB' AS vesselBooking
        FROM {{orders}}""",
    "poLineItem": f"""
        SELECT {_LINE_ID} AS podetailsId, l_orderkey AS poId, {_LINE_ID} AS soLineItemId, l_partkey AS invID, l_suppkey AS skuSupplierId,
               concat('CS-13-', l_partkey) AS supplierSku, concat('MS-', l_partkey) AS merchantSku, concat('EAN', l_partkey) AS EAN,
               CASE WHEN l_linenumber = 1 THEN '' ELSE concat('PO item ', l_partkey) END AS poItemDesc, 'USD' AS currencyCode,
               CAST(floor(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unitPrice, CAST(l_quantity AS INT) AS qty,
               CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN floor(l_quantity / 3) ELSE 0 END AS INT) AS rcvQty,
               CAST(CASE WHEN l_orderkey % 16 = 4 THEN 0 WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 3) END AS INT) AS lrQty,
               CASE l_linenumber WHEN 7 THEN 1086 WHEN 6 THEN 1087 ELSE {_PO_STATUS.format(k='l_orderkey')} END AS itemStatus,
               concat('Remark ', l_suppkey % 5) AS itemNote, concat('R', l_suppkey) AS itemReference1
        FROM {{lineitem}}""",
    # As an order conversion finds them: some orders have no PO yet, and some have gained lines since theirs was made.
    "poHeaderBeforeConversion": """
        SELECT * FROM poHeader WHERE poId % 9 <> 5""",
    "poLineItemBeforeConversion": """
        SELECT * FROM poLineItem WHERE poId % 9 <> 5 AND NOT (poId % 9 = 2 AND CAST(split_part(podetailsId, '-', 2) AS INT) IN (1, 4))""",
    "lrHeader": f"""
        SELECT o_orderkey - o_orderkey % 4 AS lrHeaderId, min(CAST(1 + o_custkey % 3 AS INT)) AS companyId, min(o_custkey) AS customerId,
               min({_SUPPLIER}) AS supplierId, concat('LR-', lpad(CAST(o_orderkey - o_orderkey % 4 AS VARCHAR(20)), 9, '0')) AS lrName,
               min(CAST(o_orderdate + INTERVAL 22 DAY AS DATE)) AS lrDate, min(CAST(o_orderdate + INTERVAL 25 DAY AS DATE)) AS lrShipDate, '' AS lrNote,
               CASE WHEN (o_orderkey - o_orderkey % 4) % 8 = 4 THEN o_orderkey - o_orderkey % 4 - 4 END AS ref_customerLrHeaderId,
               CASE (o_orderkey - o_orderkey % 4) % 12 WHEN 0 THEN '_REL_' WHEN 4 THEN '_READYLOAD_' ELSE '' END AS apiStatus,
               {_LR_STATUS.format(k='(o_orderkey - o_orderkey % 4)')} AS lrStatus
        FROM {{orders}} GROUP BY o_orderkey - o_orderkey % 4""",
    "lrContainer": f"""
        SELECT (o_orderkey - o_orderkey % 4) * 10 + 1 + o_orderkey % 2 AS lrContainerId, o_orderkey - o_orderkey % 4 AS lrHeaderId,
               concat('LR-', lpad(CAST(o_orderkey - o_orderkey % 4 AS VARCHAR(20)), 9, '0')) AS lrName,
               CAST(3154 + min(o_custkey) % 3 AS INT) AS containerTypeId, CAST(1 + o_orderkey % 2 AS INT) AS containerSeq,
               concat('CN', o_orderkey - o_orderkey % 4, '-', 1 + o_orderkey % 2) AS containerNo, concat('SEAL', min(o_orderkey)) AS containerSealNo,
               CASE WHEN (o_orderkey - o_orderkey % 4) % 8 = 4 THEN (o_orderkey - o_orderkey % 4 - 4) * 10 + 1 + o_orderkey % 2 END AS ref_lrContainerId,
               min(CAST(o_orderdate + INTERVAL 24 DAY AS DATE)) AS earlyShipDate, min(CAST(o_orderdate + INTERVAL 31 DAY AS DATE)) AS lateShipDate,
               CAST(1 + min(o_custkey) % 5 AS INT) AS portId, CAST(3301 + min(o_custkey) % 3 AS INT) AS forwarderId, CAST(1 + min(o_custkey) % 3 AS INT) AS haulierId,
               CASE WHEN min(o_custkey) % 4 = 0 THEN '' ELSE concat('FB', min(o_orderkey) % 3000) END AS forwarderBookingNo,
               min(CAST(o_orderdate + INTERVAL 23 DAY AS DATE)) AS forwarderBookingDate, min(CAST(o_orderdate + INTERVAL 28 DAY AS DATE)) AS ETD,
               min(CAST(o_orderdate + INTERVAL 48 DAY AS DATE)) AS ETA, concat('note ', min(o_orderkey) % 6) AS notes, {_LR_STATUS.format(k='(o_orderkey - o_orderkey % 4)')} AS containerStatus
        FROM {{orders}} GROUP BY o_orderkey - o_orderkey % 4, o_orderkey % 2""",
    "lrLineItem": f"""
        SELECT {_LINE_ID} AS lrDetailsId, {_LR} AS lrHeaderId, {_LR} * 10 + 1 + l_orderkey % 2 AS lrContainerId, l_orderkey AS soHeaderId,
               {_LINE_ID} AS soLineItemId, l_orderkey AS poId, {_LINE_ID} AS poDetailsId, concat('CS-13-', l_partkey) AS supplierSku, l_partkey AS invID,
               CAST(l_quantity AS INT) AS qty, CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 2) END AS INT) AS processQty,
               concat('ln ', l_linenumber) AS itemNote, CAST(floor(l_quantity / 5) AS INT) AS cartonQty, CAST(5 AS INT) AS qtyPerCarton, CAST(NULL AS VARCHAR(40)) AS ref_lrLineItemId, CAST(0 AS INT) AS confirmQty,
               CASE WHEN l_linenumber = 7 THEN 2130 ELSE {_LR_STATUS.format(k=_LR)} END AS itemStatus
        FROM {{lineitem}}""",
    "shipmentHeader": """
        SELECT o_orderkey AS shipmentId, CAST(1 + o_custkey % 3 AS INT) AS companyId, o_custkey AS customerId, concat('SH', o_orderkey) AS shipId,
               CAST(o_orderdate + INTERVAL 32 DAY AS DATE) AS shipmentDate, CASE WHEN o_orderkey % 11 = 0 THEN 2150 ELSE 2149 END AS shipmentStatus,
               o_orderkey - o_orderkey % 4 AS lrHeaderId, concat('LR-', lpad(CAST(o_orderkey - o_orderkey % 4 AS VARCHAR(20)), 9, '0')) AS lrName,
               concat('BOL-', (o_orderkey - o_orderkey % 4) * 10 + 1 + o_orderkey % 2) AS bol,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('INV-', o_orderkey) END AS invoiceId, CAST(o_orderdate + INTERVAL 33 DAY AS DATE) AS invoiceDate,
               o_orderkey AS soHeaderId, concat('SO-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) AS soName, concat('PO', o_orderkey % 5000) AS customerPO,
               CASE WHEN o_orderkey % 2 = 0 THEN concat('CI', o_orderkey) END AS customerInvoiceNo, CAST(floor(o_totalprice * 100) AS BIGINT) AS InvoiceAmount,
               'Singapore' AS countryOfOrigin, CAST(1 + o_custkey % 4 AS INT) AS pickupAddrId, o_custkey AS shipToId, 'Singapore' AS pol, CAST(1 + o_custkey % 5 AS INT) AS podPortId,
               concat('Port ', o_custkey % 5) AS pod, CAST(1131 + o_custkey % 2 AS INT) AS paymentTermId, CAST(3154 + o_custkey % 3 AS INT) AS containerTypeId,
               CAST(1 + o_orderkey % 2 AS INT) AS containerSeqNo, concat('CN', o_orderkey - o_orderkey % 4, '-', 1 + o_orderkey % 2) AS containerNo,
               concat('SEAL', o_orderkey % 7) AS containerSealNo, CAST(3301 + o_custkey % 3 AS INT) AS forwarderId, CAST(1 + o_custkey % 3 AS INT) AS haulierId,
               CAST(3401 + o_custkey % 3 AS INT) AS vesselId, concat('FB', o_orderkey % 3000) AS forwarderBookingNo,
               CAST(o_orderdate + INTERVAL 34 DAY AS DATE) AS ETD, CAST(o_orderdate + INTERVAL 55 DAY AS DATE) AS ETA,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL 31 DAY AS DATE) END AS containerPullOutDate,
               CAST(o_orderkey % 6 AS INT) AS numberOfPallets, CAST(o_orderkey % 900 AS BIGINT) AS shipmentWeight, CAST(o_orderkey % 1800 AS BIGINT) AS bolTotalShipmentWeight,
               CASE CASE WHEN CAST(floor(o_orderkey / 4) AS BIGINT) % 7 = 0 THEN o_orderkey % 4 ELSE CAST(floor(o_orderkey / 4) AS BIGINT) % 4 END
                    WHEN 0 THEN '_NEW_' WHEN 1 THEN '_RTG_' WHEN 2 THEN '_ASN_' ELSE '_INV_' END AS apiStatus, '' AS note
        FROM {orders}""",
    "shipmentLineItem": f"""
        SELECT {_LINE_ID} AS shipmentLineItemId, l_orderkey AS shipmentId, {_LINE_ID} AS soLineItemId, {_LINE_ID} AS lrDetailsId, l_partkey AS invId,
               concat('CS-', l_partkey) AS customerSku, concat('MS-', l_partkey) AS merchantSku, CAST(l_quantity AS INT) AS shipmentQty,
               CAST(floor(l_quantity * (1 - l_discount)) AS INT) AS shipQty, CASE WHEN l_linestatus = 'O' THEN 2149 ELSE 2150 END AS lineItemStatus,
               CASE WHEN l_linenumber = 1 THEN 'fragile' ELSE '' END AS lineItemNotes, CAST(round(l_discount * 100) AS BIGINT) AS discountPct, CAST(round(l_tax * 100) AS BIGINT) AS taxPct
        FROM {{lineitem}}""",
    "workOrderHeader": """
        SELECT o_orderkey - o_orderkey % 5 AS workOrderHeaderId, min(CAST(1 + o_custkey % 3 AS INT)) AS companyId, min(o_custkey) AS customerId,
               concat('WO-', lpad(CAST(o_orderkey - o_orderkey % 5 AS VARCHAR(20)), 9, '0')) AS workOrderName, min(CAST(o_orderdate AS DATE)) AS workOrderDate,
               CAST(1 + min(o_custkey) % 4 AS INT) AS warehouseId, min(CAST(o_orderdate + INTERVAL 28 DAY AS DATE)) AS shipDate,
               min(CAST(o_orderdate + INTERVAL 21 DAY AS DATE)) AS targetCompleteDate, CASE WHEN min(o_custkey) % 4 = 0 THEN concat('TP', min(o_custkey) % 7) ELSE '' END AS thirdParty,
               CASE WHEN (o_orderkey - o_orderkey % 5) % 3 = 0 THEN 5231 ELSE 5230 END AS workOrderStatus, CAST(min(o_custkey) % 3 AS INT) AS revision,
               CASE WHEN (o_orderkey - o_orderkey % 5) % 4 = 0 THEN '_NEW_' ELSE '' END AS apiStatus, CAST(min(o_custkey) % 5 AS INT) AS createBy,
               CAST(min(o_custkey) % 7 AS INT) AS updateBy, '' AS workOrderNote
        FROM {orders} GROUP BY o_orderkey - o_orderkey % 5""",
    "workOrderLineItem": f"""
        SELECT {_LINE_ID} AS workOrderLineItemId, {_WO} AS workOrderHeaderId, l_orderkey AS soHeaderId, {_LINE_ID} AS soLineItemId, l_partkey AS invId,
               concat('SO-', lpad(CAST(l_orderkey AS VARCHAR(20)), 9, '0')) AS soName, CAST(l_quantity AS INT) AS qty,
               CAST(floor(l_quantity * (1 - l_discount)) AS INT) AS confirmQty, CAST(floor(l_quantity / 2) AS INT) AS produceQty,
               CASE WHEN l_linenumber = 7 THEN 5236 WHEN {_WO} % 3 = 0 THEN 5231 ELSE 5230 END AS workOrderItemStatus, '' AS workOrderItemNote
        FROM {{lineitem}}""",
    "rawBom": """
        SELECT p_partkey * 10 + 1 AS rawBomId, CAST(1 + p_partkey % 3 AS INT) AS companyId, p_partkey AS invId, p_partkey + 1 AS rawBomInvId,
               CAST(1 + p_size % 3 AS INT) AS rawBomQty, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END AS status FROM {part} WHERE p_size <> 10 AND p_size < 40
        UNION ALL
        SELECT p_partkey * 10 + 2, CAST(1 + p_partkey % 3 AS INT), p_partkey, p_partkey + 2, CAST(1 + p_size % 2 AS INT), 1 FROM {part} WHERE p_size < 25 AND p_size <> 10""",
    "procurementProcess": f"""
        SELECT {_LINE_ID} AS procurementProcessId, CAST(1 + o_custkey % 3 AS INT) AS companyId, l_orderkey AS soHeaderId, {_LINE_ID} AS soLineItemId, l_partkey + 1 AS invId,
               CAST(l_quantity AS INT) AS processQty, l_partkey AS rawBomInvId, CAST(2 AS INT) AS rawBomQty, CAST(l_quantity * 2 AS BIGINT) AS rawBomTotalQty,
               CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 ELSE 0 END AS BIGINT) AS poQty, CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS BIGINT) AS lockQty,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS status
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "inventoryMovement": """
        SELECT event_id AS inventoryMovementId, CAST(1 + user_id % 4 AS INT) AS warehouseId, CAST(1 + user_id % 3 AS INT) AS companyId, user_id AS invId,
               CASE event_type WHEN 'purchase' THEN 'SHIP' WHEN 'view' THEN 'DO' WHEN 'signup' THEN 'PROD' WHEN 'click' THEN 'REVSHIP' ELSE 'SHIPADJ' END AS action,
               concat('K', event_id % 700) AS actionKey, CAST(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * floor(value) AS INT) AS qty,
               CASE WHEN event_type = 'error' THEN 'recount' ELSE '' END AS reason, CAST(user_id % 7 AS INT) AS enterBy, ts AS enterDate
        FROM {events}""",
    "inventoryBalanceWH": """
        SELECT CAST(1 + user_id % 4 AS INT) AS warehouseId, CAST(1 + user_id % 3 AS INT) AS companyId, user_id AS invId,
               CAST(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(floor(value) AS BIGINT)) AS BIGINT) AS balanceQty,
               CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS lockQty
        FROM {events} GROUP BY user_id
        UNION ALL
        SELECT CAST(1 + (user_id + 1) % 4 AS INT), CAST(1 + user_id % 3 AS INT), user_id, CAST(count(*) AS BIGINT), CAST(0 AS BIGINT)
        FROM {events} WHERE event_type = 'view' GROUP BY user_id
        UNION ALL
        SELECT 1, 1, p_partkey, CASE WHEN p_partkey % 19 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(100000 + p_partkey AS BIGINT) END, CAST(0 AS BIGINT)
        FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {events} WHERE user_id = p_partkey) 
        UNION ALL
        SELECT 2, 2, p_partkey, CASE WHEN p_partkey % 19 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(100000 + p_partkey AS BIGINT) END, CAST(0 AS BIGINT)
        FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {events} WHERE user_id = p_partkey) 
        UNION ALL
        SELECT 3, 3, p_partkey, CASE WHEN p_partkey % 19 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(100000 + p_partkey AS BIGINT) END, CAST(0 AS BIGINT)
        FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {events} WHERE user_id = p_partkey)""",
    "inventoryBalanceWh_Lock": f"""
        SELECT {_LINE_ID} AS warehouseBalanceLockId, CAST(1 + l_partkey % 3 AS INT) AS companyId, l_orderkey AS soHeaderId, {_LINE_ID} AS soLineItemId,
               CAST(1 + l_partkey % 4 AS INT) AS warehouseId, l_partkey AS invid, CAST(l_quantity AS BIGINT) AS lockQty, CAST(floor(l_quantity / 4) AS BIGINT) AS releaseQty
        FROM {{lineitem}} WHERE l_returnflag = 'A'""",
    "poReceivedHeader": f"""
        SELECT o_orderkey AS poRcvHeaderId, CAST(1 + o_custkey % 3 AS INT) AS companyId, {_SUPPLIER} AS supplierId, CAST(o_orderdate + INTERVAL 29 DAY AS DATE) AS poRcvDate,
               concat('RCV', o_orderkey) AS poRcvName, concat('DO', o_orderkey % 800) AS supplierDO, CAST(1 + o_custkey % 4 AS INT) AS warehouseId, 3159 AS poRcvStatus
        FROM {{orders}} WHERE o_orderstatus = 'F'""",
    "poReceivedLineItem": f"""
        SELECT {_LINE_ID} AS poRcvLineItemId, l_orderkey AS poRcvHeaderId, {_LINE_ID} AS poDetailsId, l_partkey AS invId, concat('CS-13-', l_partkey) AS supplierSku,
               CAST(floor(l_quantity / 2) AS INT) AS rcvQty, '' AS notes,
               CASE WHEN l_quantity >= 2 THEN 3159 ELSE 2142 END AS poRcvLineItemStatus
        FROM {{lineitem}} WHERE l_returnflag <> 'N'""",
    "orderProcess": """
        SELECT o_orderkey AS opId, CAST(1 + o_custkey % 3 AS INT) AS companyId, o_custkey AS customerId, concat('OP', o_orderkey) AS opName, o_custkey AS shipToId,
               CAST(o_orderdate + INTERVAL 26 DAY AS DATE) AS processDate, CASE o_orderkey % 3 WHEN 0 THEN 2142 WHEN 1 THEN 1091 ELSE 1090 END AS opStatus
        FROM {orders}""",
    "orderProcessLineItem": f"""
        SELECT {_LINE_ID} AS opLineItemId, l_orderkey AS opId, {_LINE_ID} AS soLineItemId, l_partkey AS invId, CAST(l_quantity AS INT) AS requestQty,
               CAST(floor(l_quantity * (1 - l_discount)) AS INT) AS confirmQty, CASE l_orderkey % 3 WHEN 0 THEN 2142 WHEN 1 THEN 1091 ELSE 1090 END AS lineStatus
        FROM {{lineitem}}""",
    "actionNotification": """
        SELECT event_id AS actionNotificationID, CAST(1 + user_id % 3 AS INT) AS corporateId,
               CASE WHEN event_type IN ('click', 'view') THEN 'SalesOrder' ELSE 'WorkOrder' END AS sourceModule,
               CASE WHEN event_type IN ('click', 'view') THEN event_id ELSE event_id - event_id % 5 END AS sourceRecordId,
               event_type AS eventType, props AS payload, '' AS comment, ts AS createDate
        FROM {events}""",
    "notificationRecipient": """
        SELECT event_id AS recipientId, event_id AS notificationID, CAST(user_id % 5 AS INT) AS userID, CASE WHEN value > 60 THEN 1 ELSE 0 END AS isRead
        FROM {events}""",
    # Staged upload files, with planted faults: blanks, unknown names, bad numbers and dates, repeats.
    "temp_SoFilelog": f"""
        SELECT {_LINE_ID} AS sofilelog_Id, concat('file', o_orderkey - o_orderkey % 3, '.csv') AS fileLoaded, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'Unknown' WHEN o_orderkey % 2 = 0 THEN concat(upper(c_name), ' ') ELSE c_name END AS customerName,
               CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 61 = 0 THEN concat('po', o_orderkey % 5000) ELSE concat('NPO', o_orderkey) END AS customerPO,
               CASE WHEN o_orderkey % 71 = 0 THEN 'L9' WHEN o_orderkey % 2 = 0 THEN concat('l', 1 + o_custkey % 4) ELSE '' END AS destinationlabel,
               CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('st-', o_custkey % 100) END AS destination,
               concat('CS-', o_custkey, '-', l_partkey) AS customerSku, concat('MS-', l_partkey) AS csitemCode, '' AS ItemDescription,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('TP', o_custkey % 7) ELSE '' END AS thirdPartyCustomer, '' AS thirdPartyPO,
               CASE WHEN o_orderkey % 79 = 0 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS orderQty,
               CASE WHEN o_orderkey % 73 = 0 THEN '1997-13-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS shipDate
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey""",
    "temp_lrLog": f"""
        SELECT {_LINE_ID} AS lrLogId, concat('lr', o_orderkey, '.csv') AS fileLoaded, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               CASE WHEN o_orderkey % 53 = 0 THEN 'P-none' ELSE concat('p-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) END AS poName,
               concat('PO', o_orderkey % 5000) AS customerPo,
               CASE o_custkey % 5 WHEN 0 THEN 'antwerp' WHEN 1 THEN 'Busan' WHEN 2 THEN 'Cadiz' WHEN 3 THEN 'Durban' ELSE 'Ennore' END AS pod,
               concat('CS-13-', l_partkey) AS supplierSku, CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE concat('MS-', l_partkey) END AS merchantSku,
               CASE WHEN o_orderkey % 43 = 0 THEN 'many' WHEN o_orderkey % 41 = 0 THEN '-1' WHEN o_orderkey % 37 = 0 THEN '99'
                    WHEN o_orderkey % 3 = 0 THEN CAST(CAST(1 + floor(l_quantity / 4) AS INT) AS VARCHAR(20))
                    ELSE CAST(CAST(l_quantity - floor(l_quantity / 3) AS INT) AS VARCHAR(20)) END AS lrQty,
               CAST(CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS VARCHAR(20)) AS shipDate,
               CASE WHEN o_orderkey % 31 = 0 THEN '50FT' WHEN o_orderkey % 29 = 0 AND l_linenumber = 1 THEN '20gp' ELSE '40hq' END AS containerType,
               CAST(1 + l_linenumber % 2 AS VARCHAR(20)) AS containerSeq, CASE WHEN o_orderkey % 23 = 0 THEN concat('n', l_linenumber) ELSE '' END AS notes,
               '5' AS qtyPerCarton, CASE WHEN o_orderkey % 59 = 0 THEN 'none' ELSE {_LINE_ID} END AS poDetailsId
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'""",
    "temp_loadingPlanningLog": f"""
        SELECT {_LINE_ID} AS lrLogId, concat('plan', o_orderkey, '.csv') AS fileLoaded, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               CASE WHEN o_orderkey % 31 = 0 THEN '50FT' WHEN o_orderkey % 29 = 0 AND l_linenumber = 1 THEN '20gp' ELSE '40hq' END AS containerType,
               CASE WHEN o_orderkey % 41 = 0 THEN '0' ELSE CAST(1 + l_linenumber % 2 AS VARCHAR(20)) END AS containerSeq,
               CASE WHEN o_orderkey % 89 = 0 THEN 'Unknown' ELSE upper(c_name) END AS customerName, concat('ms-', l_partkey) AS merchantSku,
               CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS lrQty,
               CASE WHEN o_orderkey % 19 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) ELSE CAST(CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS VARCHAR(20)) END AS shipDate,
               concat('ST-', o_custkey % 100) AS shipToLabel, '' AS notes
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey""",
    "temp_poReceivedLog": f"""
        SELECT concat('D', o_orderkey) AS poReceivedLogId, concat('rcv', o_orderkey, '.csv') AS fileName, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               CASE WHEN o_orderkey % 67 = 0 THEN 'XX' ELSE 'DO' END AS recordType, CASE WHEN o_orderkey % 17 = 0 THEN concat('DO', o_orderkey % 800) ELSE concat('NDO', o_orderkey) END AS column1,
               CASE WHEN o_orderkey % 73 = 0 THEN '1997-13-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS column2, 'ok' AS column3, '' AS column4, '' AS column5, '' AS column6
        FROM {{orders}} WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT {_LINE_ID}, concat('rcv', o_orderkey, '.csv'), CAST(1 + o_custkey % 3 AS INT), 'DL',
               CASE WHEN o_orderkey % 17 = 0 THEN concat('DO', o_orderkey % 800) ELSE concat('NDO', o_orderkey) END,
               CASE WHEN o_orderkey % 53 = 0 THEN 'P-none' ELSE concat('P-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')) END,
               CASE WHEN o_orderkey % 37 = 0 AND l_linenumber = 1 THEN 'annex' WHEN o_custkey % 3 = 0 THEN 'main' WHEN o_custkey % 3 = 1 THEN 'L2' ELSE 'Lake' END,
               concat('cs-13-', l_partkey), CASE WHEN o_orderkey % 43 = 0 THEN 'many' WHEN o_orderkey % 41 = 0 THEN '99' ELSE CAST(CAST(ceil(l_quantity / 3) AS INT) AS VARCHAR(20)) END, 'part'
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'""",
    "temp_inventoryMovementLog": """
        SELECT event_id AS invMovementLog_Id, concat('mv', event_id - event_id % 8, '.csv') AS fileLoaded, CAST(1 + user_id % 3 AS INT) AS companyId,
               CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'Nowhere' WHEN user_id % 3 = 0 THEN 'Main' WHEN user_id % 3 = 1 THEN 'l2' ELSE 'lake' END AS warehouseLabel,
               CASE event_type WHEN 'purchase' THEN 'SHIP' WHEN 'view' THEN 'adj' WHEN 'click' THEN 'RevShip' ELSE 'SHIPADJ' END AS action,
               CASE WHEN event_type = 'view' OR event_id % 83 = 0 THEN '' ELSE concat('SH', event_id) END AS shipId,
               concat('SO-', lpad(CAST(event_id AS VARCHAR(20)), 9, '0')) AS orderNo, concat('sku-', user_id) AS inventorySku,
               CASE WHEN event_id % 79 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS qty, CASE WHEN event_id % 71 = 0 THEN '' ELSE 'count' END AS reason, CAST(user_id % 7 AS INT) AS enterBy, ts AS enterDate
        FROM {events}""",
    "temp_inventoryLog": """
        SELECT p_partkey AS logId, concat('item', p_partkey - p_partkey % 4, '.csv') AS fileName, CAST(1 + p_partkey % 3 AS INT) AS companyId,
               CASE WHEN p_partkey % 61 = 0 THEN 'NOTHING' ELSE lower(p_type) END AS productCategory, concat(p_type, ' group ', sub) AS productSubCategory,
               concat(p_type, ' ', p_brand) AS productType,
               CASE WHEN p_partkey % 12 < 4 THEN '' WHEN p_partkey % 59 = 0 THEN concat('it', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0')) WHEN p_partkey % 53 = 0 THEN 'SAME' ELSE concat('NEW', p_partkey) END AS itemCode,
               concat('n', p_size) AS modelNo, concat('nsku-', p_partkey) AS inventorySKU, p_name AS productName, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'made' END AS description,
               CASE WHEN p_partkey % 47 = 0 THEN 'heavy' ELSE CAST(p_size AS VARCHAR(20)) END AS grossWeight, '1' AS grossLength, '1' AS grossWidth, '1' AS grossHeight,
               '1' AS netWeight, CAST(p_size AS VARCHAR(20)) AS netLength, '2' AS netWidth, '3' AS netHeight, CASE WHEN p_partkey % 43 = 0 THEN '' ELSE '7' END AS cbm,
               CASE WHEN p_partkey % 41 = 0 THEN 'TON' ELSE 'pcs' END AS measurement, '' AS glCode, CASE WHEN p_partkey % 5 = 0 THEN 'Y' ELSE 'N' END AS virtualProduct,
               split_part(p_name, ' ', 1) AS color, concat('BOX-', p_size % 5) AS packaging, '' AS size,
               'color' AS attributeName_1, split_part(p_name, ' ', 1) AS attributeValue_1, CASE WHEN p_partkey % 37 = 0 THEN 'shine' ELSE 'Packing' END AS attributeName_2, concat('BOX-', p_size % 5) AS attributeValue_2
        FROM partShape""",
    "temp_rawBomLog": """
        SELECT p_partkey AS rawBomLogId, concat('bom', p_partkey - p_partkey % 5, '.csv') AS fileName, concat('it', lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0')) AS upc,
               concat('IT', lpad(CAST(p_partkey + 3 AS VARCHAR(20)), 8, '0')) AS rawBomUpc, CASE WHEN p_partkey % 31 = 0 THEN 'two' ELSE CAST(1 + p_size % 4 AS VARCHAR(20)) END AS rawBomQty
        FROM {part} WHERE p_size >= 30""",
    "temp_customerSkuLog": """
        SELECT concat(o_custkey, '-', l_partkey, '-', o_orderkey % 2) AS customerSkuLog, concat('cs', o_custkey, '-', l_partkey % 10, '.csv') AS fileLoaded, CAST(1 + o_custkey % 3 AS INT) AS companyId,
               CASE WHEN o_custkey % 89 = 0 THEN 'Unknown' ELSE min(upper(c_name)) END AS customerName, CASE WHEN l_partkey % 97 = 0 THEN 'sku-none' ELSE concat('sku-', l_partkey) END AS inventorySku,
               CASE WHEN l_partkey % 13 = 0 THEN concat('cs-', o_custkey, '-', l_partkey) ELSE concat('NCS-', o_custkey, '-', l_partkey) END AS customerSku,
               concat('ms-', l_partkey) AS merchantSku, '' AS itemDesc, CASE WHEN l_partkey % 83 = 0 THEN 'XXX' ELSE 'usd' END AS currencyCode, CAST(1 + l_partkey % 90 AS VARCHAR(20)) AS customerCost
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey, l_partkey, o_orderkey % 2""",
    "temp_supplierSkuLog": """
        SELECT concat(l_suppkey, '-', l_partkey) AS supplierSkuLog, concat('ss', l_suppkey, '-', l_partkey % 60, '.csv') AS fileLoaded, CAST(1 + l_suppkey % 3 AS INT) AS companyId,
               CASE WHEN l_suppkey % 29 = 0 THEN 'Unknown' ELSE min(s_name) END AS supplierName, concat('sku-', l_partkey + 1) AS inventorySku,
               CASE WHEN l_partkey % 71 = 0 THEN concat('ss-', l_suppkey, '-', l_partkey) ELSE concat('NSS-', l_suppkey, '-', l_partkey) END AS supplierSku, '' AS itemDesc,
               CASE WHEN l_partkey % 83 = 0 THEN 'XXX' WHEN l_partkey % 61 = 0 THEN 'USD' WHEN l_suppkey % 3 = 0 THEN 'usd' WHEN l_suppkey % 3 = 1 THEN 'sgd' ELSE 'MYR' END AS currencyCode,
               CAST(1 + l_partkey % 90 AS VARCHAR(20)) AS supplierCost, '10' AS moq, CASE WHEN l_partkey % 79 = 0 THEN 'MAYBE' WHEN l_partkey % 2 = 0 THEN 'yes' ELSE 'NO' END AS isDefault
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_suppkey, l_partkey""",
}

_WORD = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")


def view_dependencies(sql: str) -> list[str]:
    """Views a text needs, each after the views it is built from."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def with_views(sql: str) -> str:
    """``WITH <needed views> <sql>``; driver tables stay as ``{name}`` placeholders."""
    names = view_dependencies(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    opening = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
    glue, body = (", " if opening else " "), body[len(opening):]
    return f"{opening or 'WITH '}{ctes}{glue}{body}"


def plain_names(sql: str) -> str:
    """Turn ``{orders}`` into ``orders`` for an engine where tables are registered by name."""
    for name in DRIVER_TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql
