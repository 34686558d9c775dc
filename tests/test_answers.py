"""Replies as text, merged answers, the catalog's header, queries in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderweave.operators import answers, scoring
from orderweave.plans import sheets
from orderweave.sources import catalog


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"selected_nomenclature_code": " 12 ", "confidence": 0.5, "reasoning": " ok "}', ("12", 0.5, "ok")),
        ('```json\n{"selected_nomenclature_code": null, "confidence": 1, "reasoning": "нет"}\n```', (None, 1.0, "нет")),
        ('Sure: {"selected_nomenclature_code": "7", "reasoning": "{a}"} done', ("7", 0.0, "{a}")),
        ("no json at all", (None, 0.0, answers.UNAVAILABLE)),
        (None, (None, 0.0, answers.UNAVAILABLE)),
    ],
)
def test_replies(spark, reply, want):
    r = spark.createDataFrame([(reply,)], "t string").select(answers.parse_reply(F.col("t")).alias("x")).first().x
    assert (r.code, r.confidence, r.reasoning) == want


def test_merged_answers_keep_every_line(spark):
    lines = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", True), (1, 3, "b", False), (1, 4, "c", False), (1, 5, None, False)], "order_id long, line_number long, job_key string, breaks boolean")
    said = spark.createDataFrame([("a", "7", 0.9, "x"), ("b", "8", 0.0, answers.TIMED_OUT), ("c", "99", 0.4, "x")], "job_key string, code string, confidence double, reasoning string")
    cat = spark.createDataFrame([("007", "n7", "b7"), ("008", "n8", None)], "code string, nomenclature string, barcode string")
    got = {r.line_number: (r.status, r.code, r.match_method, r.status_detail) for r in answers.merge_answers(lines, said, cat, F.when(F.col("breaks"), "broken"), "ollama").collect()}
    missing = ("QUARANTINE", None, None, answers.MISSING)
    assert got == {1: ("MATCHED_LLM", "007", "LLM_OLLAMA", None), 2: missing, 3: ("QUARANTINE", None, "LLM_TIMEOUT", answers.TIMEOUT), 4: missing, 5: missing}


def test_catalog_header(spark):
    cells = sheets.catalog(spark.createDataFrame([("001", "стол", 1.5)], "code string, nomenclature string, weight double"))
    r = catalog.load_catalog(cells).first()
    assert (r.code, r.nomenclature, r.weight, r.color) == ("00000000001", "стол", 1.5, None)
    with pytest.raises(ValueError):
        catalog.load_catalog(cells.withColumn("text", F.when((F.col("row") == 1) & (F.col("col") == 4), "другое").otherwise(F.col("text"))))
    with pytest.raises(Exception, match="empty"):
        catalog.load_catalog(cells.where("row = 1 OR col <> 1")).collect()


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(40, 4)).tolist())], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    rows = lambda: sorted((r.query_id, r.rank0, r.vec_id) for r in scoring.knn(q, v, 5).collect())
    whole = rows()
    monkeypatch.setattr(scoring, "MOST_QUERIES", 4)
    assert rows() == whole and len(whole) == 45


def test_explained_lines_without_candidates(spark):
    p = spark.createDataFrame([(1, 1, "a", "Package ratio mismatch", "стол", 0), (1, 1, "b", "Sub-brand conflict", "стул", 1), (1, 2, "a", None, "стол", 0), (1, 2, "b", "x", "y", 1)], "order_id long, line_number long, code string, reason string, nomenclature string, rank0 int")
    assert [(r.line_number, r.why) for r in scoring.explain_empty(p).collect()] == [(1, "no candidates passed hard filters (QUARANTINE) — Package ratio mismatch: стол; Sub-brand conflict: стул")]


def test_keys_take_turns_and_rest():
    now = [0.0]
    ring = answers.KeyRing(["a", " b ", ""], rest=10, clock=lambda: now[0])
    assert [ring.take() for _ in range(3)] == ["a", "b", "a"]
    ring.refuse("b")
    assert [ring.take() for _ in range(2)] == ["a", "a"]
    ring.refuse("a")
    assert ring.take() is None
    now[0] = 10.0
    assert ring.take() in ("a", "b") and answers.KeyRing([]).take() is None


def test_one_more_try():
    calls = []

    def call():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("429 too many requests")
        return "done"

    assert answers.call_with_retry(call, delay=0) == "done" and len(calls) == 2
    with pytest.raises(KeyError):
        answers.call_with_retry(lambda: {}["x"], delay=0)


def test_questions_and_replies(spark):
    def ask(prompt, key):
        if "broken" in prompt:
            raise RuntimeError("no")
        return '{"selected_nomenclature_code": "%s", "confidence": 1, "reasoning": "%s"}' % (prompt[-1], key)

    jobs = spark.createDataFrame([("a", "ask 1"), ("b", "broken"), ("c", "ask 2")], "job_key string, prompt string")
    got = {r.job_key: (r.code, r.confidence, r.reasoning) for r in answers.resolve(jobs, ask, ("k",)).collect()}
    assert got == {"a": ("1", 1.0, "k"), "b": (None, 0.0, answers.UNAVAILABLE), "c": ("2", 1.0, "k")}
    assert {r.reasoning for r in answers.resolve(jobs, None).collect()} == {answers.UNAVAILABLE}


def test_index_is_built_once(spark, tmp_path):
    from orderweave.operators import index_cache

    cat = spark.createDataFrame([("1", "a"), ("2", "b")], "code string, search string")
    made = lambda c, model="m": {r.vec_id: list(r.embedding) for r in index_cache.build_or_load(spark, c, str(tmp_path / "ix"), F.array(F.length("search").cast("double"), F.rand()), model).collect()}
    first = made(cat)
    assert made(cat.orderBy(F.desc("code"))) == first and made(cat, "other") != first
    assert set(made(cat.union(spark.createDataFrame([("3", "c")], cat.schema)))) == {"1", "2", "3"}


def test_samples_are_the_same_for_a_seed(spark):
    from orderweave.plans.standins import sample_catalog

    cat = spark.createDataFrame([(f"{i}", f"n{i}" if i else " ") for i in range(30)], "code string, nomenclature string")
    one = lambda seed: sorted(r.code for r in sample_catalog(cat.repartition(3), 10, seed).collect())
    assert one(1) == one(1) != one(2) and "0" not in one(1)
    with pytest.raises(ValueError):
        sample_catalog(cat, 30)


def test_the_filter_ends_before_the_totals():
    from orderweave.sources import export

    book = export.workbook([(1, "Стол", "01", 2, "u"), (2, "Стул", "", 1, "u")], [("rows", 2)])
    assert export.filtered_last_row(book) == 3
