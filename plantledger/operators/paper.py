"""Rows behind the order paper: pick sheet, slips, sale and invoice documents, pallet sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.functions import text as X
from plantledger.operators.ordering import number_rows, on_first_page, running_sums, text_list

LINE_ORDER = ("order_id", "unit_no", "part_id", "supplier_id", "ship_date", "price")
NO_PALLET = "NO PALLET"


def _picked(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with batch, unit label and piece count; the label is the move's own packaging, else the product's, else the line's unit."""
    joined = lines.join(products, "product_id", "left")
    return (joined
            .withColumn("batch", F.coalesce(X.batch_of(F.col("lot_name")), F.lit("")))
            .withColumn("unit_label", F.coalesce(*([F.col("move_packaging")] if "move_packaging" in lines.columns else []), "packaging_name", "uom"))
            .withColumn("_fall", F.when(F.col("package_name").isNotNull(), -F.col("quantity")).otherwise(F.lit(0.0)))
            .withColumn("pieces", Q.pieces_of(F.col("quantity"), F.col("uom"), F.col("count_per_unit"))))


def _first(*columns: str) -> Column:
    return F.min(F.struct(*columns))


def pick_checklist(lines: DataFrame, products: DataFrame, packages: DataFrame) -> DataFrame:
    """Contents rows of the pick sheet.

    ``row_no`` counts pallets in natural order and then loose lines; a pallet has one row per
    (product, batch) in order of first appearance among its lines by falling quantity. The unit totals
    of the pallet, its dimensions and weight repeat on its rows.
    """
    picked = _picked(lines, products.select("product_id", "product_name", "count_per_unit", "packaging_name"))
    on_pallet = picked.filter(F.col("package_name").isNotNull())
    loose = picked.filter(F.col("package_name").isNull())

    # hardly two lines of a pallet share all of product, batch and unit label, so each breakdown comes from the lines in one step
    keys = ["picking_id", "package_name"]
    contents = on_pallet.groupBy(*keys, "product_id", "batch").agg(
        F.sum("pieces").alias("pieces"), F.min(F.struct(F.struct("_fall", *LINE_ORDER).alias("_seen"), "unit_label")).alias("_first"))
    contents = contents.withColumn("unit_label", F.col("_first.unit_label"))
    contents = number_rows(contents, keys, ["_first", "product_id", "batch"], "content_no")
    labels = on_pallet.groupBy(*keys, "unit_label").agg(F.sum("pieces").alias("n"), _first("_fall", *LINE_ORDER).alias("_at"))
    # labels are packaging and unit names, a short fixed vocabulary, so one list per pallet stays small
    units = labels.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "unit_label", "n"))),
        lambda r: F.concat(r["n"].cast("string"), F.lit(" "), r["unit_label"])), " | ").alias("units"))

    pallets = packages.select(
        "picking_id", "package_name", F.lit(0).alias("_loose"),
        X.pallet_prefix(F.col("package_name")).alias("_prefix"),
        X.pallet_number(F.col("package_name")).alias("_number"),
        X.dims_text(F.col("length"), F.col("width"), F.col("height")).alias("dims"),
        X.weight_text(F.col("gross_weight_lb")).alias("weight"))
    pallets = number_rows(pallets, ["picking_id"], ["_prefix", "_number", "package_name"], "row_no")
    n_pallets = pallets.groupBy("picking_id").agg(F.count(F.lit(1)).alias("_pallets"))  # of the rows that were written to be numbered

    loose = number_rows(loose, ["picking_id"], [*LINE_ORDER, "pieces"], "_loose_no")
    loose_rows = loose.join(n_pallets, "picking_id", "left").select(
        "picking_id", (F.coalesce("_pallets", F.lit(0)) + F.col("_loose_no")).alias("row_no"),
        F.lit(NO_PALLET).alias("pallet"), F.lit(1).cast("bigint").alias("content_no"), "product_name",
        X.number_text(F.col("pieces")).alias("qty"), "unit_label",
        F.when(F.col("batch") != "", F.col("batch")).otherwise("-").alias("batch"),
        F.concat(F.col("pieces").cast("string"), F.lit(" "), "unit_label").alias("units"),
        F.lit("-").alias("dims"), F.lit("-").alias("weight"))
    pallet_rows = (contents.join(products.select("product_id", "product_name"), "product_id", "left")
                   .join(pallets.join(units, keys), keys)
                   .select("picking_id", "row_no", X.display_id(F.col("package_name")).alias("pallet"), "content_no",
                           "product_name", X.number_text(F.col("pieces")).alias("qty"), "unit_label",
                           F.when(F.col("batch") != "", F.col("batch")).otherwise("-").alias("batch"),
                           "units", "dims", "weight"))
    return pallet_rows.unionByName(loose_rows)


def pick_totals(lines: DataFrame, products: DataFrame, packages: DataFrame) -> DataFrame:
    """Pieces per unit label and in all, with distinct pallets and their weight counted once."""
    per_label = _picked(lines, products).groupBy("picking_id", "unit_label").agg(F.sum("pieces").alias("pieces"))
    pieces = (per_label.groupingSets([["picking_id", "unit_label"], ["picking_id"]], "picking_id", "unit_label")
              .agg(F.sum("pieces").alias("pieces"), F.grouping("unit_label").alias("_total"))
              .select("picking_id", F.when(F.col("_total") == 1, "(total)").otherwise(F.col("unit_label"))
                      .alias("unit_label"), "pieces"))
    weight = packages.groupBy("picking_id").agg(F.count(F.lit(1)).alias("pallets"),
                                                F.sum("gross_weight_lb").alias("weight_lb"))
    return pieces.join(weight, "picking_id", "left").select(
        "picking_id", "unit_label", "pieces", F.coalesce("pallets", F.lit(0)).alias("pallets"),
        X.weight_text(F.coalesce("weight_lb", F.lit(0.0))).alias("weight"))


def order_summary(lines: DataFrame, products: DataFrame) -> DataFrame:
    """One row per (product, batch) over pallets and loose lines, in checklist order."""
    measured = products.select("product_id", "count_per_unit", "packaging_name")
    per_package = _picked(lines, measured).groupBy("picking_id", "product_id", "batch", "package_name").agg(
        F.sum("pieces").alias("pieces"),
        _first("_fall", *LINE_ORDER).alias("_seen"), _first(*LINE_ORDER, "uom").alias("_line"))
    package = F.col("package_name")
    on_pallet = package.isNotNull()
    groups = (per_package
              .withColumn("_at", F.struct(
                  F.when(on_pallet, 0).otherwise(1), F.when(on_pallet, X.pallet_prefix(package)).otherwise(""),
                  F.when(on_pallet, X.pallet_number(package)).otherwise(0), "_seen"))
              .groupBy("picking_id", "product_id", "batch")
              .agg(F.sum("pieces").alias("pieces"), F.count("package_name").alias("on_pallets"),
                   F.min("_at").alias("_at"), F.min("_line").alias("_line")))
    numbered = number_rows(groups, ["picking_id"], ["_at", "product_id", "batch"], "position")
    usable = F.col("packaging_name").isNotNull() & (F.coalesce("packaging_qty", F.lit(0)) != 0)
    return numbered.join(products, "product_id", "left").select(
        "picking_id", "position", F.coalesce("product_name", F.lit("")).alias("product_name"),
        X.first_line(F.col("display_name")).alias("description"),
        X.other_lines(F.col("display_name")).alias("more_lines"),
        F.when(F.col("batch") != "", F.col("batch")).otherwise("-").alias("lot"),
        "pieces", F.when(usable, F.col("packaging_name")).otherwise(F.col("_line.uom")).alias("unit_label"),
        "on_pallets")


def delivery_lines(
    moves: DataFrame, lines: DataFrame, products: DataFrame, suppliers: DataFrame, lots_per_row: int = 500
) -> DataFrame:
    """Packing slip: ordered and shipped per move, batch lots, pallet count or packs; amounts on page 1 of the lots."""
    batches = lines.select("picking_id", "product_id", X.batch_of(F.col("lot_name")).alias("batch"))
    lots = text_list(batches, ["picking_id", "product_id"], "batch", "lots", lots_per_row)
    n = F.col("n_pallets")
    packed = (F.when(n == 1, "1 pallet").when(n > 1, F.concat(n.cast("string"), F.lit(" pallets")))
              .when(F.col("packaging_name").isNotNull() & (F.coalesce("packaging_qty", F.lit(0)) != 0),
                    F.concat(X.number_text(F.try_divide("shipped", "packaging_qty")), F.lit(" "), "packaging_name"))
              .otherwise("-"))
    return (moves.join(products, "product_id", "left").join(suppliers, "supplier_id", "left")
            .join(lots, ["picking_id", "product_id"], "left")
            .select("picking_id", F.coalesce("product_name", F.lit("")).alias("product_name"),
                    F.coalesce("page", F.lit(1)).cast("bigint").alias("page"),
                    X.first_line(F.col("display_name")).alias("description"),
                    X.other_lines(F.col("display_name")).alias("more_lines"),
                    F.coalesce("lots", F.lit("")).alias("lots"),
                    F.concat(X.number_text(F.col("ordered")), F.lit(" "), "uom").alias("order_qty"),
                    F.concat(X.number_text(F.col("shipped")), F.lit(" "), "uom").alias("shipped_qty"),
                    packed.alias("packed"), F.coalesce("supplier_name", F.lit("")).alias("ship_from"))
            .withColumns(on_first_page("order_qty", "shipped_qty", "packed")))


def blind_ship_lines(delivery: DataFrame) -> DataFrame:
    """The packing slip without the column that tells who ships."""
    return delivery.drop("ship_from")


def sale_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order document lines: sections and notes stay in place without amounts, product rows are
    counted, and the order's untaxed, tax and total amounts repeat on each line.

    ``lines`` carries display_type (NULL, line_section, line_note).
    """
    order = ["line_no", "product_id", "supplier_id", "ship_date", "price"]
    is_product = F.col("display_type").isNull()
    positioned = running_sums(lines, ["order_id"], order, {"position": F.lit(1), "row_no": is_product.cast("int")})
    totals = lines.filter(is_product).groupBy("order_id").agg(
        F.round(F.sum("price_subtotal"), 2).alias("untaxed"), F.round(F.sum("tax"), 2).alias("tax_amount"),
        F.max(F.col("discount") > 0).alias("display_discount"))
    packs = F.try_divide("product_uom_qty", "packaging_qty")
    packaging = F.when(F.col("packaging_name").isNotNull(),
                       F.concat(F.lit(" ("), X.number_text(packs), F.lit(" "), "packaging_name", F.lit(")")))
    return (positioned.join(totals, "order_id", "left")
            .join(products, "product_id", "left")
            .select("order_id", "position", F.coalesce("display_type", F.lit("product")).alias("display_type"),
                    F.when(is_product, F.col("row_no")).otherwise(F.lit(0)).cast("bigint").alias("row_no"),
                    X.first_line(F.col("display_name")).alias("name"),
                    X.other_lines(F.col("display_name")).alias("more_lines"),
                    F.when(is_product, F.concat(X.number_text(F.col("product_uom_qty")),
                                                F.coalesce(packaging, F.lit("")))).otherwise("").alias("qty"),
                    F.when(is_product & (F.col("discount") > 0), F.concat(
                        F.lit("Discount: "), X.number_text(F.col("discount") * 100), F.lit("%")))
                    .otherwise("").alias("discount_text"),
                    F.when(is_product, X.money_text(F.round("price_subtotal", 2))).otherwise("").alias("subtotal"),
                    F.coalesce("display_discount", F.lit(False)).alias("display_discount"),
                    X.money_text(F.coalesce("untaxed", F.lit(0).cast("decimal(18,2)"))).alias("untaxed"),
                    X.money_text(F.coalesce("tax_amount", F.lit(0).cast("decimal(18,2)"))).alias("tax"),
                    X.money_text(F.coalesce(F.col("untaxed") + F.col("tax_amount"), F.lit(0).cast("decimal(18,2)")))
                    .alias("total")))


def invoice_lines(
    lines: DataFrame, sale_lines_: DataFrame, moves: DataFrame, stock_lines: DataFrame, products: DataFrame,
    lots_per_row: int = 500,
) -> DataFrame:
    """Invoice lines with the batch lots reached over sale line, move and move line.

    ``lines``: invoice_id, sale_line_id, product_id, quantity, subtotal. ``sale_lines_``: sale_line_id,
    move_id. ``moves``: move_id, picking_id, fold_id. ``stock_lines``: picking_id, fold_id, lot_name.
    Amounts stand on page 1 of a line's lots. The lots of a move are listed once and then attached, so the chain never multiplies rows.
    """
    batches = (stock_lines.filter(F.col("lot_name").isNotNull())
               .select("picking_id", "fold_id", X.batch_of(F.col("lot_name")).alias("batch")).distinct())
    by_move = moves.join(batches, ["picking_id", "fold_id"]).select("move_id", "batch")
    lots = text_list(by_move, ["move_id"], "batch", "lots", lots_per_row)
    return (lines.join(sale_lines_, "sale_line_id", "left").join(lots, "move_id", "left")
            .join(products, "product_id", "left")
            .select("invoice_id", "sale_line_id", F.coalesce("product_name", F.lit("")).alias("product_name"),
                    F.coalesce("page", F.lit(1)).cast("bigint").alias("page"),
                    X.first_line(F.col("display_name")).alias("name"),
                    F.coalesce("lots", F.lit("")).alias("lots"),
                    X.number_text(F.col("quantity")).alias("qty"),
                    X.money_text(F.round("subtotal", 2)).alias("subtotal"))
            .withColumns(on_first_page("qty", "subtotal")))


def invoice_balance(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment rows and the remaining balance under each invoice.

    Entries print only under posted invoices; the balance row prints when there are entries or the
    residual differs from the total. The title follows from (draft, refund).
    """
    paid = payments.groupBy("order_id").agg(F.sum("amount").alias("paid"), F.count(F.lit(1)).alias("n_entries"))
    total = Q.cents(F.col("amount_total")).cast("decimal(20,2)")
    head = (invoices.join(paid, "order_id", "left")
            .withColumn("total", total)
            .withColumn("residual", (total - F.coalesce("paid", F.lit(0).cast("decimal(20,2)"))).cast("decimal(20,2)"))
            .withColumn("title", F.when(F.col("is_draft") & F.col("is_refund_doc"), "Draft Credit Note")
                        .when(F.col("is_draft"), "Draft Invoice").when(F.col("is_refund_doc"), "Credit Note")
                        .otherwise("Invoice"))
            .withColumn("posted", ~F.col("is_draft")))
    day = F.date_format("date", "MM/dd/yyyy")
    label = (F.when(F.col("is_exchange"), "Exchange Difference:")
             .when(F.col("is_refund"), F.concat(F.lit("Reversed on "), day, F.lit(":")))
             .otherwise(F.concat(F.lit("Paid on "), day, F.lit(":"))))
    entries = (payments.join(head.filter("posted").select("order_id", "title"), "order_id")
               .select("order_id", "title", F.col("entry_no").cast("bigint").alias("row_no"), label.alias("label"),
                       X.money_text(F.col("amount")).alias("amount")))
    shown = F.col("posted") & (F.col("n_entries").isNotNull()
                               | ((F.col("residual") != 0) & (F.col("residual") != F.col("total"))))
    balance = head.filter(shown).select("order_id", "title", (F.coalesce("n_entries", F.lit(0)) + 1).cast("bigint").alias("row_no"),
                                        F.lit("Remaining Balance:").alias("label"),
                                        X.money_text(F.col("residual")).alias("amount"))
    return entries.unionByName(balance)


def pallet_sheet(lines: DataFrame, packages: DataFrame, products: DataFrame, lines_per_page: int = 500) -> DataFrame:
    """Pallet header (first order, lots, dimensions, weight, finish time) over its numbered contents; a page of as many lines
    has as many lots in its header, so all are named and none is on a page without lines."""
    inside = lines.filter(F.col("package_name").isNotNull())
    keys = ["picking_id", "package_name"]
    numbered = number_rows(inside, keys, [*LINE_ORDER, "quantity", "uom"], "line_no")
    head = inside.groupBy(*keys).agg(F.min("order_no").alias("first_order"), F.count(F.lit(1)).alias("case_count"))
    lots = text_list(inside.select(*keys, "lot_name"), keys, "lot_name", "lots", lines_per_page)
    page = (F.floor((F.col("line_no") - 1) / lines_per_page) + 1).cast("bigint")
    return (numbered.withColumn("page", page).join(head.join(packages, keys), keys).join(products, "product_id", "left")
            .join(lots, [*keys, "page"], "left")
            .select("picking_id", X.display_id(F.col("package_name")).alias("pallet"), "first_order", "case_count", F.coalesce("lots", F.lit("")).alias("lots"),
                    X.dims_text(F.col("length"), F.col("width"), F.col("height")).alias("dims"),
                    X.weight_text(F.col("gross_weight_lb")).alias("weight"),
                    F.date_format("finalized_at", "MM/dd/yyyy HH:mm").alias("finalized"),
                    "line_no", F.coalesce("lot_name", F.lit("-")).alias("lot"),
                    X.first_line(F.col("display_name")).alias("product"),
                    F.concat(X.number_text(F.col("quantity")), F.lit(" "), "uom").alias("qty")))


def addresses(documents: DataFrame, partners: DataFrame) -> DataFrame:
    """Street printed for each role: the contact's own, or that of its commercial parent.

    ``documents``: document_id and one partner column per role (bill_id, sold_id, ship_id). Without an order
    (NULL sold_id) the goods count as sold to the billed contact.
    """
    parents = partners.select(F.col("partner_id").alias("_parent"), F.col("street").alias("_parent_street"),
                              F.col("partner_name").alias("_parent_name"))
    own = F.col("street").isNotNull()
    resolved = (partners.join(parents, F.col("commercial_id") == F.col("_parent"), "left")
                .select("partner_id", F.when(own, F.col("partner_name")).otherwise(F.col("_parent_name")).alias("name"),
                        F.coalesce("street", "_parent_street", F.lit("")).alias("street")))
    out = documents.withColumn("sold_id", F.coalesce("sold_id", "bill_id"))
    for role in ("bill", "sold", "ship"):
        side = resolved.select(F.col("partner_id").alias(f"{role}_id"), F.col("name").alias(f"{role}_name"),
                               F.col("street").alias(f"{role}_street"))
        out = out.join(side, f"{role}_id", "left")
    return out.select("document_id", *[f"{r}_{c}" for r in ("bill", "sold", "ship") for c in ("name", "street")])
