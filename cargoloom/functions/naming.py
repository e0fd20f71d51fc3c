"""Product names built from a template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bracketed placeholders a template may hold.
PLACEHOLDERS = ("modelno", "color", "colorname", "netheight", "netlength", "netwidth", "inventorytype", "boardgrade", "grammage",
                "edgingtype", "surface", "backertype", "papertype", "aisize", "aitype", "pages", "direction")

# Attribute names that fill a placeholder, upper case.
ATTRIBUTE_PLACEHOLDERS = {
    "COLOR": "color", "COLOUR": "color", "COLOUR NAME": "colorname", "BOARD GRADE": "boardgrade", "GRAMMAGE": "grammage",
    "EDGING TYPE": "edgingtype", "SURFACE": "surface", "BACKER TYPE": "backertype", "PAPER TYPE": "papertype", "AI SIZE": "aisize",
    "AI TYPE": "aitype", "PAGES": "pages", "DIRECTION": "direction",
}

# Literals written as tokens, and the joining mark that is dropped.
LITERALS = {"[space]": " ", "[,]": ",", "+": ""}


def product_name(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``template``; placeholders match in any case and missing values count as ''.

    Stays a plain expression (no UDF): case-insensitive collation on the template.
    """
    def fill(text: Column, mark: str, value: Column) -> Column:
        # every operand carries the collation, so the case-insensitive search is unambiguous
        return F.replace(text, F.collate(F.lit(mark), "UTF8_LCASE"), F.collate(value, "UTF8_LCASE"))

    start = F.collate(template, "UTF8_LCASE")
    named = [(f"[{p}]", F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("")) for p in PLACEHOLDERS]
    filled = reduce(lambda t, mv: fill(t, *mv), named, start)
    filled = reduce(lambda t, mv: fill(t, mv[0], F.lit(mv[1])), LITERALS.items(), filled)
    return F.collate(filled, "UTF8_BINARY")
