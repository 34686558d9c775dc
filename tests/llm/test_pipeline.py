"""The pipeline against a plain version, and the registered queries against DuckDB."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from orderweave.llm import language_id, piece_tokens, registry, secret_scan, source_mixing

from .helpers import documents, rows
from .test_operators import _secrets, kept_by_brute_force


def test_pipeline(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(spark).write.parquet(path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Training order decides the last bits of a model, so the plain version shares it and does the rest by itself.
    model = language_id.fit(spark.read.parquet(path))
    docs = [r for r in rows() if not model.predict([r[1]])[2][0]]
    assert 0 < len(docs) < len(rows())
    docs = [docs[k] for k in kept_by_brute_force([r[:2] for r in docs])]
    text = {r[0]: secret_scan.redact(r[1], _secrets(r[1]), "[secret]") for r in docs}
    mixed = source_mixing.mix_rows(documents(spark, [(r[0], text[r[0]], *r[2:]) for r in docs]), corpus_pipeline.WEIGHTS).collect()
    assert Counter(r.doc_id for r in got) == Counter({r.doc_id: r.copies for r in mixed if r.copies})
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_tokens.MODEL_FILE)
    for r in got:
        assert r.ids == lib.encode(text[r.doc_id]) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), "").collect() == []


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, con.sql(registry.ORACLE_SQL[name]).select(*cols).fetchall()))
