"""Queries against DuckDB, and operators on small fixtures."""

import re
import zipfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderweave.functions import text as T
from orderweave.operators import answers, dictionary, documents, linkage, reports, scoring
from orderweave.plans import registry
from orderweave.sources import sheet
from orderweave.streaming import shifts

SF = "/root/testdata/sf0.001"
TABLES = ["part", "lineitem", "orders", "pages", "events", "documents", "embeddings", "conversations"]


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got, want = (sorted(map(repr, rows)) for rows in ([tuple(r[c] for c in cols) for r in df.collect()], con.sql(registry.ORACLE_SQL[name]).select(*cols).fetchall()))
    spark.catalog.clearCache()
    assert got == want


def test_no_line_is_lost(spark):
    df = entry.entry(spark)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert df.count() == lines == df.select("order_id", "line_number").distinct().count()
    assert {r[0] for r in df.select("status").distinct().collect()} == {"MATCHED_AUTO", "NEEDS_LLM", "QUARANTINE"}
    spark.catalog.clearCache()


def test_every_query_is_listed():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


PAIR = "order_id long, line_number long, code string, label_model string, color string, entity_ratio string, ratio string, models array<string>, colors array<string>, sub_brands array<string>, entity_brands array<string>, pairs array<string>, entity_pairs array<string>, query string, search string, composite boolean, same_key string, score double, rank0 int"


def _pair(code, score, brands=(), entity_brands=(), color="белый", colors=("белый",), ratio="1/1", entity_ratio="1/1", pairs=(), entity_pairs=(), query="", search="", key="k", rank=0):
    return (1, 1, code, "m", color, entity_ratio, ratio, [], list(colors), list(brands), list(entity_brands), list(pairs), list(entity_pairs), query, search, False, key, score, rank)


def _scored(spark, *pairs):
    df = spark.createDataFrame(list(pairs), PAIR)
    return df.withColumn("reason", scoring.constraint_reason(df))


def test_constraints(spark):
    df = _scored(
        spark,
        _pair("a", 0.5), _pair("b", 0.5, ratio="1/2", entity_ratio="2/2"), _pair("c", 0.5, ratio="1/2", entity_ratio=None), _pair("d", 0.5, entity_ratio=None),
        _pair("e", 0.5, brands=["роял"], entity_brands=["тренд"]), _pair("f", 0.5, brands=["роял"]), _pair("g", 0.5, query="дверь (FE)", search="дверь"),
        _pair("h", 0.5, pairs=["565x255"], entity_pairs=["565x300"]), _pair("i", 0.5, pairs=["565x255"], entity_pairs=["1x2"]), _pair("j", 0.5, pairs=["5x2"], entity_pairs=["5x2", "5x3"]),
    )
    got = {r.code: r.reason for r in df.collect()}
    assert {k for k, v in got.items() if v is None} == {"a", "d", "f", "i", "j"}
    assert got["b"] == got["c"] == "Package ratio mismatch" and got["e"] == "Sub-brand conflict"
    assert got["g"] == "facade finish mismatch: FE vs None" and got["h"] == "dimension conflict: 565x255"


def test_barriers(spark):
    asked = _scored(spark, _pair("a", 0.5, ["роял"], ["роял"]), _pair("b", 0.9, ["роял"]))
    assert {r.code: round(r.score, 6) for r in scoring.sub_brand_barrier(asked).collect()} == {"a": 0.85, "b": 0.4}
    plain = _scored(spark, _pair("a", 0.6), _pair("b", 0.9, (), ["роял"]))
    assert {r.code: round(r.score, 6) for r in scoring.sub_brand_barrier(plain).collect()} == {"a": 0.6, "b": 0.4}
    colors = _scored(spark, _pair("a", 0.6), _pair("b", 0.9, color="белый/графит"))
    assert {r.code: round(r.score, 6) for r in scoring.color_barrier(colors).collect()} == {"a": 0.6, "b": 0.8}
    alone = _scored(spark, _pair("b", 0.9, color="белый/графит"))
    assert scoring.color_barrier(alone).first().score == 0.9


def test_top1_and_status(spark):
    df = scoring.top1(_scored(spark, _pair("a", 0.9, rank=1), _pair("b", 0.9, rank=0), _pair("c", 0.95, ratio="1/2")))
    df = df.withColumns({"sure": F.lit(False), "aligned": F.lit(True)})
    r = df.withColumn("status", scoring.status(df)).first()
    assert (r.code, r.rival, r.n_passed, r.status) == ("b", 0.9, 2, "NEEDS_LLM")
    df = scoring.top1(_scored(spark, _pair("a", 0.9), _pair("b", 0.9, key="other", rank=5)))
    for sure, aligned, want in ((False, True, "MATCHED_AUTO"), (False, False, "NEEDS_LLM"), (True, False, "MATCHED_AUTO")):
        d = df.withColumns({"sure": F.lit(sure), "aligned": F.lit(aligned)})
        assert d.withColumn("status", scoring.status(d)).first().status == want


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank0): r.vec_id for r in scoring.knn(q, v, 7, block=10).collect()}
    best = np.argsort(-(x[:5].astype("float64") @ x.astype("float64").T), axis=1)[:, :7]
    assert got == {(i, k): int(best[i, k]) for i in range(5) for k in range(7)}
    assert scoring.knn(q.where("false"), v).collect() == []


def test_embedding_is_a_unit_vector(spark):
    e = spark.createDataFrame([("комод",), ("",)], "t string").select(scoring.hash_embedding(F.col("t")).alias("e"))
    assert [round(sum(x * x for x in r.e), 9) for r in e.collect()] == [1.0, 1.0]


def test_resolver_answers_each_job_once(spark):
    df = spark.createDataFrame([(1, "a ", ["x", "y"]), (2, "A", ["y", "x"]), (3, "b", ["z"])], "id int, client_description string, codes array<string>")
    jobs = scoring.resolver_jobs(df)
    assert sorted(r.n_lines for r in jobs.collect()) == [1, 2]

    def pick(prompt, key):
        if prompt.startswith("b"):
            raise RuntimeError
        return '{"selected_nomenclature_code": "%s", "confidence": 0.9, "reasoning": "least"}' % prompt[-1]

    asked = jobs.select("job_key", F.concat_ws(" ", F.trim("client_description"), F.array_min("codes")).alias("prompt"))
    assert sorted((r.code or "", r.reasoning) for r in answers.resolve(asked, pick).collect()) == [("", answers.UNAVAILABLE), ("x", "least")]


def test_dictionary():
    terms = ["ателье светлый", "белый", "бел"]
    assert dictionary.find_terms("Белый Ателье светлый бел белый", terms) == ["белый", "ателье светлый", "бел", "белый"]
    assert dictionary.find_terms("белыйx бел", terms, boundary=True) == ["бел"]
    assert dictionary.find_terms(None, terms) == []


def test_lookup_of_codes(spark):
    cat = spark.createDataFrame([("0012",), ("12",), ("000",)], "code string")
    asked = spark.createDataFrame([(1, "0012"), (2, "00012"), (3, "7"), (4, "0")], "id int, code string")
    assert {r.id: r.found for r in linkage.lookup_code(asked, cat).collect()} == {1: "0012", 2: "0012", 3: None, 4: None}


def test_reports(spark):
    d = spark.createDataFrame(
        [(1, 1, "MATCHED_AUTO", "nan", 2, "n", "c", "u"), (1, 2, "QUARANTINE", None, 3, None, "text", "u"), (2, 1, "MATCHED_AUTO", None, 1, "n2", "c", "u")],
        "order_id long, line_number long, status string, barcode string, quantity int, nomenclature string, client_description string, customer_name string",
    )
    assert reports.status_counts(d).first().asDict() == {"matched_auto": 2, "matched_llm": 0, "needs_llm": 0, "quarantine": 1}
    assert [(r.name, r.barcode) for r in reports.export_rows(d).orderBy("order_id", "no").collect()] == [("n", ""), ("text", ""), ("n2", "")]
    assert {r.order_id: (r.quarantine, r.no_barcode) for r in reports.attention(d).collect()} == {1: ([2], []), 2: ([], [1])}
    over = spark.createDataFrame([(2, 1, " 123 "), (1, 2, " ")], "order_id long, line_number long, ean string")
    assert {(r.order_id, r.line_number): r.barcode for r in reports.with_overrides(d, over).collect()} == {(1, 1): "nan", (1, 2): None, (2, 1): "123"}


GRID = [
    (1, 1, "Получатель:"), (1, 2, "ООО Ромашка"), (3, 1, "№"), (3, 2, "Секция"), (3, 3, "Наименование"), (3, 4, "Тип"), (3, 5, "Кол-во"),
    (4, 1, "1"), (4, 2, "Р1.16.Я2"), (4, 3, "Комод 1/1"), (4, 4, "корпус"), (4, 5, "2"), (5, 3, "IMP к Комод"), (6, 3, "Заказ № 77"), (7, 3, "белый"),
    (8, 1, "2"), (8, 3, "Стекло 4мм"), (8, 5, "x"), (9, 1, "Итого мест 3"), (10, 1, "3"), (10, 3, "после"),
]


def _xlsx(path, grid, fills=None):
    col = lambda c: chr(64 + c)
    rows = {}
    for r, c, t in grid:
        style = (fills or {}).get((r, c), 0)
        rows.setdefault(r, []).append(f'<c r="{col(c)}{r}" t="inlineStr" s="{style}"><is><t>{t}</t></is></c>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items()) + "</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fills><fill/><fill><patternFill><fgColor rgb="FFE0FFE0"/></patternFill></fill></fills><cellXfs><xf fillId="0"/><xf fillId="1"/></cellXfs></styleSheet>')


def _html(path, grid):
    cells = {(r, c): t for r, c, t in grid}
    body = "".join("<tr>" + "".join(f"<td>{cells.get((r, c), '')}</td>" for c in range(1, 6)) + "</tr>" for r in range(1, 12))
    path.write_bytes(f"<html><table><tr><td>small</td></tr></table><table>{body}</table></html>".encode("cp1251"))


@pytest.mark.parametrize("kind", ["html", "xlsx", "source"])
def test_standard_document(spark, tmp_path, kind):
    if kind == "html":
        _html(tmp_path / "a.xls", GRID)
    else:
        _xlsx(tmp_path / "a.xlsx", GRID)
    if kind == "source":
        spark.dataSource.register(sheet.SheetSource)
        cells = spark.read.format("sheet").load(str(tmp_path))
    else:
        cells = sheet.read_sheets(spark, str(tmp_path))
    assert documents.document_class(cells).first().kind == "STANDARD_PICKING_LIST"
    assert documents.customers(cells).first().customer == "ООО Ромашка"
    got = documents.parse_standard(cells).orderBy("line_number").collect()
    assert [(r.line_number, r.client_description, r.item_type, r.quantity, r.factory_alias, r.order_service_line) for r in got] == [
        (1, "Комод 1/1", "корпус", 2, "IMP к Комод белый", "Заказ № 77"),
        (2, "Стекло 4мм", "", 1, None, ""),
    ]
    r = documents.checksum(documents.parse_standard(cells), cells).first()
    assert (r.places, r.declared, r.mismatch) == (3, 3, False)


def test_without_a_header_fills_open_blocks(spark, tmp_path):
    grid = [(8, 1, "1"), (8, 2, "Комод"), (9, 1, "2"), (9, 2, "Стол")]
    _xlsx(tmp_path / "a.xlsx", grid, {(8, 2): 1})
    got = documents.parse_standard(sheet.read_sheets(spark, str(tmp_path))).collect()
    assert [r.client_description for r in got] == ["Комод"]


def test_soft_document(spark):
    grid = [(1, 1, "Мягкая мебель"), (3, 1, "№"), (3, 2, "Наименование"), (3, 3, "Кол-во"), (4, 1, "1"), (4, 2, "Диван"), (4, 3, "2"), (5, 1, "Состоит из упаковок"), (6, 1, "Спинка"), (6, 3, "1"), (7, 1, "Сиденье"), (7, 3, "3"), (8, 1, "2"), (8, 2, "Кресло"), (8, 3, "1"), (9, 1, "Итого мест 9")]
    cells = spark.createDataFrame([("d", r, c, t, "") for r, c, t in grid], sheet.CELLS)
    assert documents.document_class(cells).first().kind == "SOFT_FURNITURE_TRANSFER"
    lines = documents.parse_soft(cells)
    assert [(r.line_number, r.client_description, r.quantity) for r in lines.orderBy("line_number").collect()] == [(1, "Диван Спинка", 2), (2, "Диван Сиденье", 6), (3, "Кресло", 1)]
    assert documents.checksum(lines, cells).first().mismatch is False


def test_formats():
    assert sheet.kind_of(b"\xef\xbb\xbf <HTML>") == "html" and sheet.kind_of(b"PK\x03\x04") == "xlsx" and sheet.kind_of(b"\xd0\xcf\x11\xe0") == "xls" and sheet.kind_of(b"?", "a.xls") == "xls"
    with pytest.raises(ValueError):
        sheet.kind_of(b"?", "a.txt")
    assert sheet.decode("Привет".encode("cp1251")) == sheet.decode("Привет".encode("cp866")) == "Привет"


def test_streamed_totals_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = shifts.daily_totals(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted(map(repr, df.select("event_type", "day", "n").collect()))
    assert rows(spark.table("totals")) == rows(shifts.daily_totals(events))


def test_files_are_linked_as_they_come(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    lines.write.parquet(str(tmp_path / "in"))
    q = shifts.link_files(spark, str(tmp_path / "in"), lines.schema, lambda df: df.withColumn("u", F.upper("t")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.u for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]


def test_full_constraints(spark):
    cols = "code string, query string, search string, item_type string, ratio string, entity_ratio string, color string, colors array<string>"
    rows = [
        ("ok", "комод", "комод", "", "1/1", "1/1", "", []),
        ("corpus", "шкаф (корпус)", "ящик с доводчиком", "", "1/1", "1/1", "", []),
        ("widths", "чикаго 160/140/120", "чикаго 900", "", "1/1", "1/1", "", []),
        ("widths ok", "чикаго 160/140/120", "чикаго 1400", "", "1/1", "1/1", "", []),
        ("linear", "столешница 40мм 2,00м", "столешница 40мм 3,00м", "", "1/1", "1/1", "", []),
        ("thick", "столешница 40мм 2,00м", "столешница 26мм 2,00м", "", "1/1", "1/1", "", []),
        ("custom", "зеркало 500x700", "зеркало", "", "1/1", "1/1", "", []),
        ("glass", "дверца 4мм", "фасад белый", "стекло", "1/1", "1/1", "", []),
        ("hardware", "планка 1516 38мм", "планка 1516 26мм", "", "1/1", "1/1", "", []),
        ("hardware ok", "планка 1516 38мм", "планка 1516 38 мм", "", "1/1", "1/1", "белый", ["белый"]),
    ]
    df = spark.createDataFrame(rows, cols)
    from orderweave.functions import text as T

    q = F.col("query")
    none = F.array().cast("array<string>")
    df = df.withColumns({"pairs": T.dimension_pairs(q), "entity_pairs": T.dimension_pairs(F.col("search")), "widths": T.alternative_widths(q), "thick": T.thicknesses(q), "metres": T.linear_metres(q), "sub_brands": none, "entity_brands": none})
    got = {r.code: r.r for r in df.select("code", scoring.full_constraint_reason().alias("r")).collect()}
    assert {k for k, v in got.items() if v is None} == {"ok", "widths ok", "hardware ok"}
    assert got["corpus"] == "Corpus vs drawer/slide isolation" and got["custom"] == "custom size not in catalog" and got["glass"] == "glass/material mismatch"
    assert got["hardware"] == "hardware type/size/color mismatch" and got["widths"].startswith("dimension mismatch") and got["linear"] == got["thick"] == "linear dimension or thickness mismatch"


def test_hardware_phrases(spark):
    cat = linkage.prepared_catalog(spark.createDataFrame([("1", "Планка угловая 38мм"), ("2", "Планка 26мм"), ("3", "Заглушка")], "code string, nomenclature string").selectExpr("*", "'' module", "'' label_type", "'' color", "null packaging"))
    blocks = spark.createDataFrame([(1, 1, "планка 38 мм"), (1, 2, "планка корнер"), (1, 3, "комод")], "order_id long, line_number long, client_description string")
    assert [(r.line_number, r.code) for r in linkage.join_phrase(blocks, cat).collect()] == [(1, "1")]


def test_phrases_of_every_line(spark):
    """Each line's own part has its phrase, so no line is without one."""
    lines = registry.QUERIES["q_join_phrase"](spark, SF).select("order_id", "line_number").distinct().count()
    spark.catalog.clearCache()
    assert lines == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_knn_by_slices(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)).tolist()
    v = spark.createDataFrame([(f"c{i:02d}", r) for i, r in enumerate(x)], "vec_id string, embedding array<double>")
    q = v.limit(4).withColumnRenamed("vec_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.rank0, r.vec_id) for r in df.collect())
    assert rows(scoring.knn_lines(q, v, 5, slice_rows=7)) == rows(scoring.knn_lines(q, v, 5))


def test_composite_document(spark):
    grid = [
        (1, 1, "Отборочная ведомость корпусная мебель"), (2, 1, "№"), (2, 2, "Наименование"), (2, 3, "Кол-во"), (3, 1, "1"), (3, 2, "Комод"), (3, 3, "2"), (4, 2, "Заказ № ЦНТ-001415"), (5, 1, "2"), (5, 2, "Стол"), (5, 3, "1"), (6, 1, "Итого мест: 3"),
        (8, 1, "Отборочная ведомость мягкая мебель"), (9, 1, "№"), (9, 2, "Наименование"), (9, 3, "Кол-во"), (10, 1, "1"), (10, 2, "Диван"), (10, 3, "1"), (11, 1, "Ткань: велюр"), (12, 1, "Итого мест 1"),
    ]
    cells = spark.createDataFrame([("d", r, c, t, "") for r, c, t in grid], sheet.CELLS)
    assert documents.document_class(cells).first().kind == "COMPOSITE_PICKING_LIST"
    assert [(r.kind, r.first_row, r.last_row, r.declared) for r in documents.sections(cells).orderBy("section").collect()] == [("STANDARD", 1, 6, 3), ("SOFT", 8, 12, 1)]
    got = documents.parse_composite(cells).orderBy("line_number").collect()
    assert [(r.line_number, r.client_description, r.quantity, r.order_reference, r.is_soft_furniture) for r in got] == [(1, "Комод", 2, "ЦНТ-001415", False), (2, "Стол", 1, "ЦНТ-001415", False), (3, "Диван велюр", 1, None, True)]
    assert documents.parse(cells).count() == 3


def test_composite_documents_are_dealt_once(spark):
    """Cells that come dealt by document stay where they are: the plan deals them once for each kind of section, the same way."""
    cells = spark.createDataFrame([(d, 1, 1, "Отборочная ведомость корпусная мебель", "") for d in ("a#1", "b")], sheet.CELLS)
    plan = documents.parse_composite(cells.repartition(3, "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (hash|range|Single)", plan)) == 2 == len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+, 3\), REPARTITION_BY_NUM", plan))


def test_workbooks_can_be_read_back(spark, tmp_path):
    from orderweave.sources import export

    d = spark.createDataFrame([(7, 2, "QUARANTINE", None, 3, None, "Стол & <стул>", "u"), (7, 1, "MATCHED_AUTO", "0123", 2, "Комод", "c", "u")], "order_id long, line_number long, status string, barcode string, quantity int, nomenclature string, client_description string, customer_name string")
    book = export.workbooks(d).first().content
    cells = {(r, c): t for r, c, t, _ in sheet.xlsx_cells(bytes(book))}
    assert [cells.get((2, c)) for c in range(1, 6)] == ["1", "Комод", "0123", "2", "u"] and cells[3, 2] == "Стол & <стул>" and cells[5, 1] == "Итого"
    names = zipfile.ZipFile(__import__("io").BytesIO(export.zipped([("a.xlsx", bytes(book))]))).namelist()
    assert names == ["a.xlsx"]


def test_history(spark, tmp_path):
    from orderweave.sources import export

    run = lambda *rows: spark.createDataFrame(list(rows), "order_id string, timestamp string, places int, shift_date string")
    path = str(tmp_path / "runs")
    export.save_runs(spark, run(("a", "2026-01-01 10:00:00", 1, "2026-01-01"), ("b", "2026-01-02 10:00:00", 2, "2026-01-02")), path)
    export.save_runs(spark, run(("a", "2026-01-01 11:00:00", 5, "2026-01-01"), ("c", "2026-01-01 12:00:00", 3, "2026-01-01")), path)
    assert [(r.order_id, r.places) for r in export.run_history(spark, path).collect()] == [("b", 2), ("c", 3), ("a", 5)]
    (tmp_path / "m1.json").write_text('{"runs": [{"order_id": "x", "total_rows": 3}]}')
    (tmp_path / "m2.json").write_text('[{"order_id": "y", "customer_name": "c"}]')
    assert sorted((r.order_id, r.total_rows, r.customer_name) for r in export.read_manifest(spark, str(tmp_path / "m*.json")).collect()) == [("x", 3, None), ("y", None, "c")]


def test_decisions_on_order_texts(spark):
    cat = spark.createDataFrame(
        [("1", "Комод Йорк 1/1 белый", "4600000000017", "1/1"), ("2", "Планка угловая 38мм арт 1516", None, None), ("3", "Шкаф 600x720 1/1", "46", "1/1"), ("4", "Шкаф 600x720 1/1 графит", "47", "1/1")],
        "code string, nomenclature string, barcode string, packaging string",
    ).selectExpr("*", "'' module", "'' label_type", "'' color")
    texts = ["Комод  ЙОРК 1/1 белый", "Планка 1516 угловая", "Полка 600 х 720", "Петля накладная", "Зеркало 500x700 под заказ", "Артикул 777777", "Диван", "Комод Йорк 1/2 белый", "Полкодержатели стекло 30x40", None]
    blocks = spark.createDataFrame([(1, i, t, 1, "c", "d") for i, t in enumerate(texts)], "order_id long, line_number long, client_description string, quantity int, customer_name string, shift_date string")
    got = {r.line_number: r for r in linkage.decide(blocks, cat).collect()}
    assert len(got) == len(texts)
    assert (got[0].code, got[0].stage, got[0].match_method) == ("1", linkage.NAME, "exact_article")
    assert (got[1].code, got[1].stage, got[1].match_method) == ("2", linkage.ARTICLE, "AUTO_NO_BARCODE")
    assert (got[2].status, got[2].n_candidates) == ("NEEDS_LLM", 2)
    assert (got[3].status, got[3].code, got[3].match_method) == ("MATCHED_AUTO", None, "AUTO_NO_BARCODE")
    assert (got[4].status, got[4].status_detail) == ("QUARANTINE", linkage.CUSTOM)
    assert (got[5].status, got[5].status_detail) == ("QUARANTINE", linkage.NO_ARTICLE)
    assert (got[6].status, got[6].status_detail) == (got[9].status, got[9].status_detail) == ("QUARANTINE", linkage.MISSING)
    assert (got[7].status, got[7].code) == ("NEEDS_LLM", None)
    assert got[8].status == "MATCHED_AUTO"
    spark.catalog.clearCache()


def test_each_text_is_decided_once(spark, monkeypatch):
    seen, plain = [], linkage.prepared_blocks
    monkeypatch.setattr(linkage, "prepared_blocks", lambda b: seen.append(b.count()) or plain(b))
    cat = spark.createDataFrame([("1", "chair 10x20 1/1", "46", "1/1"), ("2", "table 10x20 1/2", None, "1/2")], "code string, nomenclature string, barcode string, packaging string").selectExpr("*", "'' module", "'' label_type", "'' color")
    texts = ["chair 10x20 1/1", "thing 10x20 1/2", None] * 4
    blocks = spark.createDataFrame([(1, i, t, 1, "c", "d") for i, t in enumerate(texts)], "order_id long, line_number long, client_description string, quantity int, customer_name string, shift_date string")
    got = {r.line_number: (r.status, r.code, r.n_candidates) for r in linkage.decide(blocks, cat).collect()}
    assert seen == [3] and len(got) == 12
    assert got[9] == ("MATCHED_AUTO", "1", 1) and got[10] == ("MATCHED_AUTO", "2", 2) and got[11] == ("QUARANTINE", None, 0)
    spark.catalog.clearCache()


def test_pools_are_scored_once(spark):
    from orderweave.plans.queries import _Pools

    pools = _Pools(spark, SF)
    lines, texts = pools.lines.count(), pools.texts.count()
    assert pools.texts.select("id").distinct().count() < texts < lines
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["link_flagship", "q_lexical_cascade", "q_score_boosts", "q_join_phrase"])
def test_lines_without_a_part(spark, tmp_path, name):
    con = duckdb.connect()
    for t, what in (("part", "SELECT * FROM '{}' WHERE p_partkey <> 7"), ("lineitem", "SELECT * FROM '{}' WHERE l_partkey < 30"), ("orders", "SELECT * FROM '{}'")):
        con.execute(f"COPY ({what.replace('{}', f'{SF}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got, want = df.count(), len(con.sql(registry.ORACLE_SQL[name]).fetchall())
    spark.catalog.clearCache()
    assert got == want


def test_passed_and_refused_pairs_are_those_of_whole_pools(spark):
    """Pairs that pass, and of the others the first three in an order, are made without the rest of the pools."""
    from orderweave.plans.queries import _Pools

    pools = _Pools(spark, "/root/testdata/sf0.01")
    rows = lambda df: sorted((r.id, r.code, r.score, r.reason or "") for r in df.select("id", "code", "score", "reason").collect())
    every, passed = rows(pools.pairs), rows(pools.passed())
    assert passed == [x for x in every if not x[3]] and len(every) > 4 * len(passed)
    _, asks = pools.best_passed()
    assert {r.id: r.n_passed for r in asks.collect() if r.n_passed} == Counter(x[0] for x in passed)
    others = defaultdict(list)
    for x in every:
        if x[3]:
            others[x[0]].append(x)
    found = defaultdict(list)
    for x in rows(pools.refused(asks, F.col("score").desc(), "rank0", "code")):
        found[x[0]].append(x)
    best = lambda xs: sorted(xs, key=lambda x: (-x[2], int(x[1][-4:]), x[1]))[:3]
    assert {k: best(v) for k, v in found.items()} == {k: best(v) for k, v in others.items()}
    spark.catalog.clearCache()


def test_pools_are_scored_by_many_tasks(spark):
    from orderweave.plans.queries import _Pools

    assert _Pools(spark, SF).pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    spark.catalog.clearCache()


def test_barrier_totals_are_those_of_the_barrier(spark):
    every = [(b, e, r) for b in ([], ["роял"]) for e in ([], ["роял"], ["тренд"]) for r in ("1/1", "1/2")]
    rows = [(line, i + 1, *_pair(str(i), 0.3 + i / 20, b, e, entity_ratio=r)[2:]) for line in range(40) for i, (b, e, r) in enumerate(every) if (line * 7 + i * i) % 5 < 2]
    df = spark.createDataFrame(rows, PAIR).drop("line_number").withColumn("line_number", F.size("sub_brands"))
    df = df.withColumn("reason", scoring.constraint_reason(df))
    want = scoring.sub_brand_barrier(df).groupBy("order_id", "line_number").agg(F.max("score").alias("best"), F.sum("score").alias("total"))
    told = lambda x: {(r.order_id, r.line_number): (round(r.best, 9), round(r.total, 9)) for r in x.collect()}
    got = scoring.barrier_totals(df)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(told(got)) > 40 and told(got) == told(want)


def test_features_are_worked_out_by_many_tasks(spark, monkeypatch):
    from orderweave.plans.standins import keyed_views

    monkeypatch.setattr(linkage, "kept", lambda df: df)
    v, least = keyed_views(spark, SF), 4 * spark.sparkContext.defaultParallelism
    assert linkage._text_features(v["texts"]).rdd.getNumPartitions() >= least
    assert linkage._entity_features(v["cat"]).rdd.getNumPartitions() >= least
    spark.catalog.clearCache()


def test_preview_decides_the_lines_that_it_shows(spark, monkeypatch):
    seen, plain = [], linkage.decide_texts
    monkeypatch.setattr(linkage, "decide_texts", lambda t, c: seen.append(t.count()) or plain(t, c))
    assert [(r.order_id, r.no) for r in registry.QUERIES["q_preview_top20"](spark, SF).collect()] == sorted((r.order_id, r.line_number) for r in registry.QUERIES["link_flagship"](spark, SF).collect())[:20]
    assert seen[0] <= 20 < seen[1]
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["q_overrides", "q_totals_row"])
def test_reports_decide_once(spark, name):
    joins = lambda q: registry.QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(name) <= joins("link_flagship") + 3
    spark.catalog.clearCache()


def test_lines_are_counted_by_text(spark):
    plan = registry.QUERIES["q_status_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "order_id" not in plan  # lines are counted before, and don't meet decisions
    spark.catalog.clearCache()


def _order_texts(spark):
    cat = spark.createDataFrame([("1", "Полка 10x20 арт 1234", "46", "1/1"), ("2", "chair 10x20 1/1", None, "1/1"), ("3", "Ручка 96 мм", "47", "1/1"), ("4", "Шкаф без цвета 30x40", None, "1/2")], "code string, nomenclature string, barcode string, packaging string").selectExpr("*", "'' module", "'' label_type", "'' color")
    texts = ["chair 10x20 1/1", "nothing", None, "", "x 9999", "x 9999 8888", "ст 1234 5678", "Ручка 96 мм", "Ручка 128 мм", "Петля 45 гр", "Петля заказная 45 гр", "Стекло 500x600", "полкодержатель заказн", "thing 10x20", "шкаф 30x40", "Полка 1234"]
    return cat, spark.createDataFrame([(t,) for t in texts], "client_description string")


def test_quarantine_needs_no_choice(spark):
    cat, texts = _order_texts(spark)
    cols = ["client_description", "status", "status_detail"]
    want = {tuple(r) for r in linkage.decide_texts(texts, cat).where("status = 'QUARANTINE'").select(*cols).collect()}
    got = linkage.quarantined_texts(texts, cat).select(*cols).collect()
    assert len(got) == len(want) > 5 and {tuple(r) for r in got} == want and {r.status_detail for r in got} == {linkage.MISSING, linkage.NO_ARTICLE, linkage.CUSTOM}
    spark.catalog.clearCache()


def test_decisions_add_up_lines(spark):
    cat, texts = _order_texts(spark)
    twice = texts.selectExpr("client_description", "2L n_lines").unionAll(texts.selectExpr("client_description", "1L n_lines"))
    want = reports.status_counts(linkage.with_decision(texts.unionAll(texts).unionAll(texts), linkage.decide_texts(texts, cat))).first()
    assert reports.status_counts(linkage.decide_texts(twice, cat)).first() == want and sum(want) == 48
    assert tuple(reports.status_counts(linkage.decide_texts(twice.limit(0), cat)).first()) == (0, 0, 0, 0)
    spark.catalog.clearCache()


def test_catalog_slugs_are_core_slugs(spark):
    cat, _ = _order_texts(spark)
    cat = cat.unionByName(cat.limit(1).withColumns({"code": F.lit("5"), "nomenclature": F.lit(None).cast("string")}))
    got = linkage.prepared_catalog(cat).select("slug", T.core_slug(F.col("nomenclature")).alias("want"), "name_key", T.name_key(F.col("nomenclature")).alias("key")).collect()
    assert len(got) == 5 and all(r.slug == r.want and r.name_key == r.key for r in got)


def test_texts_equal_but_for_case_are_decided_once(spark, monkeypatch):
    seen, plain = [], linkage.prepared_blocks
    monkeypatch.setattr(linkage, "prepared_blocks", lambda b: seen.append(b.count()) or plain(b))
    cat, _ = _order_texts(spark)
    said = ["chair 10x20 1/1", "  CHAIR 10X20\t1/1 ", "Chair  10 x 20 1/1", "полка 10x20 арт 1234", "ПОЛКА 10x20 арт 1234", None]
    texts = spark.createDataFrame(list(enumerate(said)), "k int, client_description string")
    lines = texts.selectExpr("k", "k order_id", "1 line_number", "1 quantity", "'c' customer_name", "'d' shift_date")
    got = {r.order_id: (r.client_description, r.status, r.code) for r in linkage.decide_keyed(lines, texts, cat, ["k"]).collect()}
    want = {r.order_id: (r.client_description, r.status, r.code) for r in linkage.decide(lines.join(texts, "k"), cat).collect()}
    assert seen[0] == 5 and got == want and [got[k][2] for k in range(5)] == ["2", "2", "2", "1", "1"]
    spark.catalog.clearCache()


def test_features_of_folded_texts_are_the_same(spark):
    bits = ["fe", "(FE)", "( Fe )", "h", "H-", "B", "b_", " ", "  ", "\t", "\n", "\x1c", "1", "12", "2000", "/", "1/2", "10/20/30", "x", "X", " X ", "*", ".", "1.2.3", "Word", "Ун", "-"]
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("".join(rng.choice(bits, 6)),) for _ in range(4000)], "client_description string")
    told = ["name_key", "slug", "articles", "dims", "pairs", "ratio", "tokens"]
    both = df.select(F.col("client_description").alias("d"), F.explode(F.array("client_description", T.folded(F.col("client_description")))).alias("client_description"))
    got = linkage.prepared_blocks(both).groupBy("d").agg(F.count_distinct(F.struct(*told)).alias("n")).where("n > 1")
    assert got.collect() == []
