"""Sinks: workbooks of export rows, run history by shift, and what is needed to read them back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.operators import reports

# The header of the export.
HEADER = ["№", "Номенклатура", "Штрихкод", "Количество", "Покупатель"]
LEAST_WIDTH, MOST_WIDTH = 10, 80
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


class _Formula(str):
    """A cell that is worked out; any other text is text, whatever it begins with."""


def _ref(row: int, col: int) -> str:
    return f"{chr(64 + col)}{row}"


def _sheet(rows: list[list], widths: list[int], filter_rows: int = 0) -> str:
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row, 1):
            if isinstance(v, _Formula):
                cells.append(f'<c r="{_ref(r, c)}"><f>{escape(v)}</f></c>')
            elif isinstance(v, int):
                cells.append(f'<c r="{_ref(r, c)}"><v>{v}</v></c>')
            elif v not in (None, ""):
                cells.append(f'<c r="{_ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    filter_ = f'<autoFilter ref="A1:{_ref(filter_rows, len(widths))}"/>' if filter_rows else ""
    return f"<worksheet {_NS}><cols>{cols}</cols><sheetData>{''.join(body)}</sheetData>{filter_}</worksheet>"


def filtered_last_row(book: bytes) -> int:
    """The last data row that the export sheet's filter covers; totals are below it."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        found = re.search(rb'<autoFilter ref="[A-Z]+\d+:[A-Z]+(\d+)"', z.read("xl/worksheets/sheet1.xml"))
    if not found:
        raise ValueError("the export sheet has no filter")
    return int(found[1])


def workbook(rows: list[tuple], summary: list[tuple]) -> bytes:
    """An export sheet (header, rows, a blank row, totals) and a summary sheet. Barcodes are text."""
    table = [HEADER, *[[int(n), name, barcode, int(q), customer] for n, name, barcode, q, customer in rows]]
    total = len(rows) + 1
    table += [[], ["Итого", f"{len(rows)}", "", _Formula(f"SUM(D2:D{total})") if rows else 0, ""]]
    width = lambda c: min(MOST_WIDTH, max(LEAST_WIDTH, 3 + max(len(str(r[c])) for r in table if len(r) > c)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="WMS" sheetId="1" r:id="r1"/><sheet name="Сводка" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet(table, [width(c) for c in range(5)], total))
        z.writestr("xl/worksheets/sheet2.xml", _sheet([list(r) for r in summary], [30, 20]))
    return out.getvalue()


def workbooks(decisions: DataFrame) -> DataFrame:
    """(order_id, content): one workbook an order, made where the order's rows are."""
    rows = reports.export_rows(decisions).join(decisions.select("order_id", F.col("line_number").alias("no"), "status"), ["order_id", "no"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        counts = pdf.groupby("status").size().to_dict()
        summary = [("rows", len(pdf)), ("places", int(pdf["quantity"].sum())), *sorted((k, int(v)) for k, v in counts.items())]
        book = workbook(list(pdf[["no", "name", "barcode", "quantity", "customer"]].itertuples(index=False)), summary)
        return pd.DataFrame({"order_id": [pdf["order_id"].iloc[0]], "content": [book]})

    return rows.groupBy("order_id").applyInPandas(run, "order_id long, content binary")


def zipped(files: Iterator[tuple[str, bytes]]) -> bytes:
    """A zip of named files, in the order in which they come."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def save_runs(spark: SparkSession, runs: DataFrame, path: str) -> None:
    """Upserts ``runs(order_id, shift_date, ...)`` into a table partitioned by shift; other shifts are not touched.

    The merged shifts are written beside the table first and swapped in by partition, as a table can't be
    overwritten while it is read.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        runs.write.partitionBy("shift_date").parquet(path)
        return
    old = spark.read.schema(runs.schema).parquet(path).join(runs.select("shift_date").distinct(), "shift_date", "left_semi").select(*runs.columns)
    reports.upsert(old, runs, "order_id").write.mode("overwrite").partitionBy("shift_date").parquet(path + ".next")
    spark.read.schema(runs.schema).parquet(path + ".next").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shift_date").parquet(path)


def run_history(spark: SparkSession, path: str, shift: str | None = None) -> DataFrame:
    """Runs, newest first."""
    runs = spark.read.parquet(path)
    return (runs.where(F.col("shift_date") == shift) if shift else runs).orderBy(F.desc("timestamp"), "order_id")


def manifest_runs(raw: DataFrame) -> DataFrame:
    """Runs of JSON manifests, one in each row's ``value``, whether ``{"runs": [...]}`` or a bare list."""
    run = "struct<order_id:string,timestamp:string,original_filename:string,doc_type:string,total_rows:long,total_places:long,matched_auto_count:long,auto_no_barcode_count:long,quarantine_count:long,wms_excel_path:string,customer_name:string,session_path:string>"
    raw = raw.select(F.trim("value").alias("t"))
    both = F.coalesce(F.when(F.col("t").startswith("["), F.from_json("t", f"array<{run}>")), F.from_json("t", f"struct<runs:array<{run}>>")["runs"])
    return raw.select(F.explode(both).alias("r")).select("r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Runs of JSON manifest files."""
    return manifest_runs(spark.read.text(path, wholetext=True))
