"""The factory catalog: a workbook of 17 columns, checked by its header and read as entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.functions import text as T

# The header, in order, and what each column is called here.
COLUMNS = [
    ("Номенклатура", "nomenclature"), ("ХарактеристикаНоменклатуры", "characteristic"), ("НоменклатураКод", "code"), ("Штрихкод", "barcode"), ("Вес", "weight"), ("Объем", "volume"),
    ("Высота", "height"), ("Длина", "length"), ("Глубина", "depth"), ("ЭтикеткаМодель", "label_model"), ("Модуль", "module"), ("Цвет", "color"), ("Начинка", "filling"),
    ("Упаковка", "packaging"), ("ТипЭтикетки", "label_type"), ("ДС", "ds"), ("ЗонаХранения", "storage_zone"),
]
NUMBERS, NEEDED = {"weight", "volume", "height", "length", "depth"}, {"nomenclature", "code"}
CODE_WIDTH = 11


def check_header(cells: DataFrame) -> None:
    """Raises ValueError unless the first row has the 17 names in order."""
    first = {r["col"]: r["text"] for r in cells.where(f"row = 1 AND col <= {len(COLUMNS)}").select("col", "text").distinct().limit(2 * len(COLUMNS)).collect()}
    got, want = [first.get(k + 1) for k in range(len(COLUMNS))], [name for name, _ in COLUMNS]
    if got != want:
        raise ValueError(f"unexpected catalog header: expected {want}, got {got}")


def load_catalog(cells: DataFrame) -> DataFrame:
    """One row an entity from ``cells(row, col, text)`` of a catalog workbook; blank rows are left out, a row without name or code is an error."""
    check_header(cells)
    rows = cells.where(f"row > 1 AND col <= {len(COLUMNS)}").withColumn("text", T.optional_text(F.col("text"))).where("text IS NOT NULL")
    rows = rows.groupBy("row").agg(*(F.max(F.when(F.col("col") == k + 1, F.col("text"))).alias(name) for k, (_, name) in enumerate(COLUMNS)))

    def value(title: str, name: str) -> Column:
        c = F.col(name)
        if name in NEEDED:
            c = F.coalesce(c, F.raise_error(F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(f": empty {title}"))))
        if name == "code":
            c = T.pad_code(c, CODE_WIDTH)
        return (T.restore_barcode(c) if name == "barcode" else T.optional_number(c) if name in NUMBERS else c).alias(name)

    return rows.select(*(value(*x) for x in COLUMNS))
