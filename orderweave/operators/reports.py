"""Aggregates over decisions: statistics, vocabularies, history, attention lists, audits, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import text as T

STATUSES = ["MATCHED_AUTO", "MATCHED_LLM", "NEEDS_LLM", "QUARANTINE"]


def status_counts(decisions: DataFrame) -> DataFrame:
    """One row, a column a status, zero where there is none; a decision with ``n_lines`` counts for so many lines."""
    if "n_lines" in decisions.columns:
        return decisions.agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n_lines"))), F.lit(0).cast("long")).alias(s.lower()) for s in STATUSES))
    return decisions.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


def order_stats(decisions: DataFrame) -> DataFrame:
    auto, no_code = F.count_if(F.col("status") == "MATCHED_AUTO"), F.count_if((F.col("status") == "MATCHED_AUTO") & F.col("barcode").isNull())
    return decisions.groupBy("order_id").agg(
        F.count("*").alias("n_rows"), F.sum("quantity").cast("long").alias("places"), auto.alias("n_auto"), no_code.alias("n_no_barcode"),
        F.count_if(F.col("status") == "QUARANTINE").alias("n_quarantine"), percent(auto, F.count("*")).alias("auto_percent"),
    )


def shift_summary(decisions: DataFrame) -> DataFrame:
    coded = F.count_if(F.col("barcode").isNotNull())
    return decisions.groupBy("shift_date").agg(F.countDistinct("order_id").alias("n_orders"), F.count("*").alias("n_rows"), F.sum("quantity").cast("long").alias("places"), coded.alias("n_coded"), percent(coded, F.count("*")).alias("coded_percent"))


def attention(decisions: DataFrame) -> DataFrame:
    """For each order with something to look at: its open lines, by kind."""
    lines = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("line_number"))))
    out = decisions.groupBy("order_id").agg(lines(F.col("status") == "QUARANTINE").alias("quarantine"), lines((F.col("status") == "MATCHED_AUTO") & F.col("barcode").isNull()).alias("no_barcode"))
    return out.where((F.size("quarantine") > 0) | (F.size("no_barcode") > 0))


def with_overrides(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(order_id, line_number, ean)`` win over the catalog's barcode."""
    clean = overrides.select("order_id", "line_number", T.optional_text(F.col("ean")).alias("ean"))
    return decisions.join(clean, ["order_id", "line_number"], "left").withColumn("barcode", F.coalesce("ean", "barcode")).drop("ean")


def export_rows(decisions: DataFrame) -> DataFrame:
    """The five columns of the export; a line without an entity keeps the client's text."""
    blank = lambda c: F.when(F.lower(F.trim(c)).isin("none", "nan", "null") | c.isNull(), F.lit("")).otherwise(F.trim(c))
    return decisions.select("order_id", F.col("line_number").alias("no"), F.coalesce("nomenclature", "client_description").alias("name"), blank(F.col("barcode")).alias("barcode"), "quantity", F.col("customer_name").alias("customer"))


def with_totals(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Export rows and one more an order, with its count and sum; ``lines(order_id, quantity)`` that the rows come from spare counting the rows."""
    total = (rows if lines is None else lines).groupBy("order_id").agg(F.lit(None).cast("int").alias("no"), F.concat(F.lit("TOTAL "), F.count("*").cast("string")).alias("name"), F.lit("").alias("barcode"), F.sum("quantity").cast("long").alias("quantity"), F.lit("").alias("customer"))
    return rows.withColumn("quantity", F.col("quantity").cast("long")).unionByName(total)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` doesn't have, and all of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def reconcile(source: DataFrame, export: DataFrame, key: list[str], value: str) -> DataFrame:
    """Counts of a full comparison of two keyed tables."""
    s, e = source.select(*key, F.col(value).alias("s")), export.select(*key, F.col(value).alias("e"))
    both = s.withColumn("in_s", F.lit(1)).join(e.withColumn("in_e", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("in_e").isNull()).alias("missing"), F.count_if(F.col("in_s").isNull()).alias("extra"), F.count_if(F.col("s") != F.col("e")).alias("different"), F.sum("s").cast("long").alias("source_sum"), F.sum("e").cast("long").alias("export_sum"))


def distinct_terms(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.select(F.trim(column).alias("term")).where("term <> ''").distinct()


def part_types(catalog: DataFrame, least: int = 15, length: int = 4) -> DataFrame:
    """Label types, and first words of names that are frequent and long enough."""
    words = catalog.select(F.lower(F.regexp_extract("nomenclature", "^([А-Яа-яA-Za-z]+)", 1)).alias("term")).where(F.length("term") >= length)
    return words.groupBy("term").count().where(F.col("count") >= least).select("term").union(catalog.select(F.lower(F.trim("label_type")).alias("term")).where("term IS NOT NULL")).distinct()


def model_terms(catalog: DataFrame, least: int = 2, most: int = 50, length: int = 3) -> DataFrame:
    """Models, and words that a moderate number of distinct models share."""
    models = distinct_terms(catalog, "label_model")
    words = models.select(F.explode(T.matches(F.col("term"), "[А-Яа-яA-Za-z]+")).alias("term")).where(F.length("term") >= length)
    return words.groupBy("term").count().where(F.col("count").between(least, most)).select("term").union(models).distinct()


# Labels that operators see.
QUARANTINED, WAITING = "🟡 Карантин", "🟠 Ожидает LLM"
BY_MODEL, BY_MODEL_BARE = "🔵 LLM", "🔵 LLM (без ШК)"
AUTO, AUTO_BARE = "🟢 Авто (со штрихкодом)", "🟢 Авто (без ШК)"
SNIPPET, NAME_MOST = 5, 80


def badge() -> Column:
    """The label of a decision, by status, method and barcode."""
    coded = T.optional_text(F.col("barcode")).isNotNull()
    model = (F.col("status") == "MATCHED_LLM") | F.upper(F.coalesce("match_method", F.lit(""))).startswith("LLM")
    return F.when(F.col("status") == "QUARANTINE", QUARANTINED).when(F.col("status") == "NEEDS_LLM", WAITING).when(model, F.when(coded, BY_MODEL).otherwise(BY_MODEL_BARE)).when(coded, AUTO).otherwise(AUTO_BARE)


def order_cards(decisions: DataFrame) -> DataFrame:
    """(order_id, card, label): a warning if anything is quarantined, and the station's label of the order."""
    s = order_stats(decisions)
    label = F.concat(F.col("order_id").cast("string"), F.lit(" (Строк: "), F.col("n_rows").cast("string"), F.lit(" | Мест: "), F.col("places").cast("string"), F.lit(" | Карантин: "), F.col("n_quarantine").cast("string"), F.lit(")"))
    return s.select("order_id", F.when(F.col("n_quarantine") > 0, "WARNING").otherwise("SUCCESS").alias("card"), label.alias("label"))


def quarantine_snippets(decisions: DataFrame) -> DataFrame:
    """(order_id, snippet): the first lines in quarantine, and how many more there are; no order's lines are gathered whole."""
    w = W.partitionBy("order_id").orderBy("line_number")
    q = decisions.where("status = 'QUARANTINE'").withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("order_id"))}).where(F.col("rn") <= SNIPPET)
    name = F.substring("client_description", 1, NAME_MOST)
    line = F.concat(F.lit("• Строка #"), F.col("line_number").cast("string"), F.lit(": "), name, F.lit(" — ["), F.coalesce("status_detail", F.lit("QUARANTINE")), F.lit("]"))
    g = q.groupBy("order_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.max("n").alias("n"))
    more = F.when(F.col("n") > SNIPPET, F.concat(F.lit("\n• … ещё "), (F.col("n") - SNIPPET).cast("string"))).otherwise("")
    return g.select("order_id", F.concat("lines", more).alias("snippet"))


def shown_names(decisions: DataFrame) -> DataFrame:
    """(order_id, line_number, factory_name, shown_barcode, method): what the console shows."""
    name = F.coalesce("nomenclature", F.when(F.col("status") == "QUARANTINE", "— (Отсутствует в 1С 8)").otherwise("—"))
    method = F.coalesce("match_method", F.when(F.col("status") == "MATCHED_AUTO", "vector_auto").otherwise(F.col("status")))
    return decisions.select("order_id", "line_number", name.alias("factory_name"), F.coalesce(T.optional_text(F.col("barcode")), F.lit("—")).alias("shown_barcode"), method.alias("method"), badge().alias("badge"))
