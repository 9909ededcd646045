"""Line items in tables of recognised cells, and amounts in running text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.classify import number

#: What names a column in a header, what ends the items of a table, and amounts by their label.
HEADERS = {
    "sku": r"\b(?:sku|item\s*(?:no|code)|product\s*(?:no|code)|part\s*(?:no|number))\b", "description": r"\b(?:description|product|item|goods)\b", "spec": r"\b(?:model|specification|spec)\b",
    "qty": r"\b(?:quantity|qty)\b", "unit": r"\b(?:unit|uom)\b", "unit_price": r"\b(?:unit\s*price|price)\b", "amount": r"\b(?:amount|line\s*total|total\s*price)\b",
}
NO_ITEM = r"(?i)\b(?:sub\s*total|grand\s+total|payment\s+terms?|bank\s+details?)\b"
AMOUNT_LABELS = {
    "subtotal": r"sub\s*total", "discount": "discount", "freight": r"(?:freight|shipping)", "tax": r"(?:tax|vat)",
    "total": r"(?:grand\s+total|total\s+amount|invoice\s+total|total)"
}
HEADER_ROWS, COUNTED = 8, ("qty", "unit_price", "amount")


def tidy(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def column_of(cells: Column, role: str) -> Column:
    """The first cell whose text names the role, from 1; null if none does."""
    named = lambda c: F.rlike(F.lower(c), F.lit(HEADERS[role])) & (~F.lower(c).contains("price") if role == "unit" else F.lit(True))
    place = F.array_position(F.transform(cells, named), True)
    return F.when(place > 0, place)


def line_items(rows: DataFrame, table: str, order: str, cells: str) -> DataFrame:
    """Items of tables (rows in order, cells as an array): below the first of the leading rows that names two columns, one of them a
    quantity, price or amount.  source_row counts rows that are not empty from 1; sums and terms are no items."""
    filled = rows.filter(F.col(table).isNotNull() & F.exists(cells, lambda c: F.rlike(c, F.lit(r"\S"))))
    in_order = Window.partitionBy(table).orderBy(order)
    placed = filled.select(table, F.transform(cells, tidy).alias("cells"), F.row_number().over(in_order).alias("source_row"), order)
    # one look at the joined cells tells the rows that name nothing counted; the cells of the others are looked at one by one
    named = (F.col("source_row") <= HEADER_ROWS) & F.rlike(F.lower(F.array_join("cells", "\n")), F.lit("|".join(HEADERS[role] for role in COUNTED)))
    roles = F.struct(*(column_of(F.col("cells"), role).alias(role) for role in HEADERS))
    known = reduce(Column.__add__, [F.col(f"roles.{role}").isNotNull().cast("int") for role in HEADERS])
    counted = F.coalesce(*(f"roles.{role}" for role in COUNTED)).isNotNull()
    heads = placed.withColumn("roles", F.when(named, roles)).withColumn("head", F.when((known >= 2) & counted, F.struct("source_row", "roles")))
    # rows stand in the order of their table, so a head is carried down without a join
    headed = heads.withColumn("head", F.first("head", True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    below = headed.filter((F.col("source_row") > F.col("head.source_row")) & ~F.rlike(F.array_join("cells", " "), F.lit(NO_ITEM)))
    cell = lambda role: F.coalesce(F.get("cells", (F.col(f"head.roles.{role}") - 1).cast("int")), F.lit(""))
    found = below.select(
        table, "source_row", cell("sku").alias("sku"), cell("description").alias("description"), cell("spec").alias("spec"), number(cell("qty")).alias("quantity"), cell("unit").alias("unit"),
        number(cell("unit_price")).alias("unit_price"), number(cell("amount")).alias("line_amount")
    )
    says = (F.concat("description", "sku", "spec") != "") | F.coalesce("quantity", "unit_price", "line_amount").isNotNull()
    sure = (F.col("description") != "") & F.coalesce("quantity", "line_amount").isNotNull()
    return found.filter(says).withColumn("review_status", F.when(sure, "PASS").otherwise("NEEDS_REVIEW"))


def labelled_amount(text: Column, label: str, last: bool = False) -> Column:
    """The first or the last number that follows a label within 20 characters."""
    pattern = rf"(?i)\b{AMOUNT_LABELS[label]}\b[^\d]{{0,20}}([\d,]+(?:\.\d{{1,4}})?)"
    values = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), number), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.element_at(values, -1 if last else 1))
