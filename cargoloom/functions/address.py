"""Address text for printed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import code_name
from .text import blank

# Per country, the separator written before each part that is not blank.
DEFAULT_LAYOUT = [(", ", "addr2"), (", ", "postcode"), (" ", "city"), (", ", "state"), (", ", "country")]
LAYOUTS = {
    3: [(", ", "addr2"), (", ", "country"), (" ", "postcode")],
    22: [(", ", "addr2"), (", ", "city"), (", ", "state"), (" ", "postcode"), (", ", "country")],
}

# Where each kind of party keeps its address.
PARTY_COLUMNS = {
    "company": dict(id="companyId", name="companyName", addr1="address", addr2="addressLine2", city="city", state="state",
                    postcode="postcode", country="country", phone="telephoneNumber", fax="faxNumber"),
    "customer": dict(id="customerId", name="customerName", addr1="customerAddress", addr2="customerAddressLine2", city="customerCity",
                     state="customerStates", postcode="customerPostcode", country="customerCountry", phone="customerContactNumber",
                     fax="customerFaxNumber"),
    "supplier": dict(id="supplierId", name="supplierCompanyName", addr1="supplierAddress", addr2="supplierAddressLine2", city="supplierCity",
                     state="supplierStates", postcode="supplierPostcode", country="supplierCountry", phone="supplierContactNumber",
                     fax="supplierFaxNumber"),
}


def _tail(layout: list[tuple[str, str]]) -> Column:
    return F.concat(*[F.when(blank(part), "").otherwise(F.concat(F.lit(sep), F.trim(part))) for sep, part in layout], F.lit("."))


def party_addresses(parties: DataFrame, codes: DataFrame, kind: str, template: int = 1) -> DataFrame:
    """(id, name, line1, line2, phone, fax) per party, in upper case, blank parts skipped.

    Template 1 puts everything on line 1; template 2 leaves the street on line 1
    and the rest on line 2.
    """
    names = PARTY_COLUMNS[kind]
    have = {c.lower() for c in parties.columns}

    def take(part: str) -> Column:
        return F.col(names[part]) if names[part].lower() in have else F.lit("")

    rows = parties.select(F.col(names["id"]).alias("id"), F.upper(take("name")).alias("name"),
                          *[F.coalesce(F.upper(take(p)), F.lit("")).alias(p) for p in ("addr1", "addr2", "city", "state", "postcode")],
                          F.col(names["country"]).alias("countryId"), F.coalesce(take("phone"), F.lit("")).alias("phone"),
                          F.coalesce(take("fax"), F.lit("")).alias("fax"))
    rows = code_name(rows, codes, "countryId", "_country").withColumn("country", F.upper("_country"))
    tail = _tail(DEFAULT_LAYOUT)
    for country, layout in LAYOUTS.items():
        tail = F.when(F.col("countryId") == country, _tail(layout)).otherwise(tail)
    street = F.col("addr1")
    if template == 1:
        line1, line2 = F.concat(street, tail), F.lit(None).cast("string")
    else:
        line1, line2 = street, F.ltrim(F.regexp_replace(tail, "^, ", ""))
    return rows.select("id", "name", line1.alias("line1"), line2.alias("line2"), "phone", "fax")


def phone_line(phone: str = "phone", fax: str = "fax") -> Column:
    return F.concat(F.when(blank(phone), "").otherwise(F.concat(F.lit("TEL : "), phone, F.lit(" "))),
                    F.when(blank(fax), "").otherwise(F.concat(F.lit("FAX : "), fax)))
