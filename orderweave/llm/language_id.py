"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, what isn't a letter is a word end, and each word's byte n-grams (word ends included) are
hashed to rows of an embedding table; their mean goes through one linear layer. Embeddings and layer are trained
together by minibatch stochastic gradient descent in numpy, on the driver, from a bounded sample: at most
``SAMPLE_DOCS`` documents of each language (fewer where there are so many languages that they would come to more than
``SAMPLE_ALL``, but ``LEAST_DOCS``) of no more than ``SAMPLE_CHARS`` code points; a language that has only longer ones
is learnt from their beginnings. More than ``MOST_LANGS`` languages are an error. Another sample, of about
``CALIBRATE_DOCS`` documents of all languages together, is kept from training; on it a temperature is fitted and the
score below which a text is rejected, so that no more than ``FALSE_REJECTS`` of right answers are.

For prediction the table is folded with the layer into one score a bucket and language (of bounded size, and
broadcast), and all whole texts of a batch are scored together as arrays, a bounded block at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without anything to
learn from every text is ``und``; repeated rows get the same answer; a row without an id is never held out; an
empty table gives an empty result; other columns are ignored by ``predict_languages`` and kept by
``drop_rejected``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.common import crc_remainder, map_rows, table, tidy

SAMPLE_DOCS, LEAST_DOCS, SAMPLE_ALL, SAMPLE_CHARS, MOST_LANGS = 300, 30, 60_000, 20_000, 2000
GRAMS, BUCKET_BITS, DIM = (2, 3, 4), 16, 16
SEGMENT, BATCH, EPOCHS, RATE, SEED = 96, 64, 4, 4.0, 5
FALSE_REJECTS, CALIBRATE_DOCS = 0.002, 4000
BLOCK, AT_ONCE = 1 << 20, 1 << 23  # scores in memory at once, and bytes of texts (or one text)
_NONE = 1 << BUCKET_BITS
_LETTER = re.compile(r"[^\W\d_]")
#: Letters and the bytes of all that isn't ASCII stay; the rest ends words.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def gram_rows(data: np.ndarray) -> list[np.ndarray]:
    """For each length of ``GRAMS`` the bucket of the n-gram that begins at each byte; ``_NONE`` where it holds a word end inside or nothing else.

    After the last byte come word ends. The n-grams of one place share their first bytes' hash.
    """
    size, out = len(data), []
    data = np.append(data, np.full(max(GRAMS), 32, np.uint8))
    gap, inside = data == 32, np.zeros(size, bool)
    h = np.full(size, 2166136261, np.uint32)
    for k in range(max(GRAMS)):
        h = (h ^ data[k : k + size]) * np.uint32(16777619)
        if k > 1:
            inside = inside | gap[k - 1 : k - 1 + size]
        if k + 1 in GRAMS:
            rows = ((h ^ (h >> np.uint32(15))) & np.uint32(_NONE - 1)).astype(np.intp)
            rows[inside if k > 1 else gap[:size] & gap[1 : size + 1]] = _NONE
            out.append(rows)
    return out


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # [buckets + 1, languages]; the last row, of what isn't an n-gram, is zero
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row a text, before the temperature."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        data = [b" " + _bytes(text) + b"  " for text in texts]  # so no n-gram goes over into the next text
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and held < AT_ONCE:
                held += len(data[hi])
                hi += 1
            self._add(np.frombuffer(b"".join(data[lo:hi]), np.uint8), np.cumsum([0, *map(len, data[lo:hi])]), total[lo:hi], count[lo:hi])
            lo = hi
        return total / np.maximum(count, 1)[:, None] + self.bias

    def _add(self, data: np.ndarray, starts: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
        step = max(256, BLOCK // len(self.langs))
        for lo in range(0, len(data), step):
            hi = min(lo + step, len(data))
            rows = [r[: hi - lo] for r in gram_rows(data[lo : hi + max(GRAMS) - 1])]
            scores = np.take(self.scores, rows[0], axis=0)
            real = (rows[0] != _NONE).view(np.int8)
            for r in rows[1:]:
                scores += np.take(self.scores, r, axis=0)
                real = real + (r != _NONE)
            first, upto = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi))
            at = np.maximum(starts[first:upto], lo) - lo
            total[first:upto] += np.add.reduceat(scores, at, axis=0, dtype=np.float64)
            count[first:upto] += np.add.reduceat(real, at, dtype=np.int64)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether it is rejected."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known:
            p = self.probabilities([texts[i] for i in known])
            for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                langs[i], scores[i], rejected[i] = self.langs[k], s, s < self.threshold
        return langs, scores, rejected


def _segments(text: str, rng: np.random.Generator) -> np.ndarray:
    """All n-grams of a text, dealt at random into rows of ``SEGMENT``."""
    data = np.frombuffer(b" " + _bytes(text) + b"  ", np.uint8)
    rows = np.concatenate(gram_rows(data))
    rows = rng.permutation(rows[rows != _NONE])
    return np.resize(rows, (-(-len(rows) // SEGMENT), SEGMENT)) if len(rows) else np.zeros((0, SEGMENT), np.int64)


def _descend(x: np.ndarray, y: np.ndarray, n_langs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    emb = rng.uniform(-1 / DIM, 1 / DIM, (_NONE + 1, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, n_langs), np.float32), np.zeros(n_langs, np.float32)
    weight = len(y) / (n_langs * np.maximum(np.bincount(y, minlength=n_langs), 1))  # rare languages count as much
    steps, done = EPOCHS * -(-len(x) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rate = np.float32(RATE * (1 - done / steps))
            rows, mine = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            mean = emb[rows].mean(axis=1)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), mine] -= 1
            p *= (np.minimum(weight[mine], 10) / len(mine))[:, None].astype(np.float32)
            back = p @ out.T / np.float32(SEGMENT)
            out -= rate * (mean.T @ p)
            bias -= rate * p.sum(axis=0)
            flat = rows.ravel()
            per = np.repeat(back, SEGMENT, axis=0)
            for k in range(DIM):
                emb[:, k] -= rate * np.bincount(flat, per[:, k], _NONE + 1).astype(np.float32)
            done += 1
    return emb, out, bias


def train(rows: list[tuple[str, str, bool]]) -> Model:
    """From (text, language, whether it is for calibration)."""
    rng = np.random.default_rng(SEED)
    langs = sorted({lang for _, lang, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((_NONE + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    held = [r for r in rows if r[2]]
    learn = [r for r in rows if not r[2]] or rows
    parts = [(_segments(t, rng), number[lang]) for t, lang, _ in learn]
    x = np.concatenate([s for s, _ in parts])
    y = np.concatenate([np.full(len(s), k) for s, k in parts])
    emb, out, bias = _descend(x, y, len(langs), rng) if len(x) else (np.zeros((_NONE + 1, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    scores = (emb @ out).astype(np.float32)
    scores[_NONE] = 0
    model = Model(langs, scores, bias.astype(np.float64), 1.0, 0.0)
    held = [r for r in held if _LETTER.search(r[0])]
    if held:
        z, mine = model.logits([t for t, _, _ in held]), np.array([number[lang] for _, lang, _ in held])

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(mine)), mine]))

        model.temperature = min(np.geomspace(0.2, 8.0, 40), key=loss)
        p = model.probabilities([t for t, _, _ in held])
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == mine])
        if len(right):
            model.threshold = float(right[int(FALSE_REJECTS * len(right))])
    return model


def sample(docs: DataFrame, may_learn: Column, calibrate: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str, bool]]:
    """The bounded sample: of each language about the same number, by a hash of the id."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    short = F.length(text_col) <= SAMPLE_CHARS
    counts = [F.count("*").alias("n"), F.count_if(calibrate).alias("held"), F.count_if(short & ~calibrate).alias("short_n"), F.count_if(short & calibrate).alias("short_held")]
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(*counts).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values in {lang_col}")
    if not sizes:
        return []
    # A language without short texts is learnt from the beginnings of its long ones.
    only_long = [r["lang"] for r in sizes if not r["short_n"]]
    sizes = [(r["lang"], {False: r["short_n"] or r["n"] - r["held"], True: r["short_held"] if r["short_n"] else r["held"]}) for r in sizes]
    each = min(SAMPLE_DOCS, max(LEAST_DOCS, SAMPLE_ALL // len(sizes)))
    most = {False: each, True: max(each // 3, -(-CALIBRATE_DOCS // len(sizes)))}

    def share(held: bool) -> Column:
        rates = ((lang, min(1.0, 1.5 * most[held] / max(n[held], 1))) for lang, n in sizes)
        rates = F.create_map(*(F.lit(v) for pair in rates for v in pair))
        return F.get(F.map_values(F.map_filter(rates, lambda k, v: k == F.col(lang_col))), F.lit(0))

    order = F.xxhash64(F.lit(SEED), id_col)
    draw = (order.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("draw")
    few = rows.where(draw < F.coalesce(F.when(calibrate, share(True)).otherwise(share(False)), F.lit(0.0)))
    few = few.where(short | F.col(lang_col).isin(only_long)) if only_long else few.where(short)
    few = few.select(order.alias("o"), F.left(F.col(text_col), F.lit(SAMPLE_CHARS)).alias("t"), F.col(lang_col).alias("l"), calibrate.alias("c"))
    taken, out = {}, []
    for o, text, lang, held in few.orderBy("o").limit(2 * sum(most.values()) * len(sizes)).collect():
        taken[lang, held] = taken.get((lang, held), 0) + 1
        if taken[lang, held] <= most[held]:
            out.append((text, lang, held))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from labelled rows whose crc32 of the id is not 2 modulo 4; those of remainder 3 calibrate."""
    part = crc_remainder(F.col(id_col), 4)
    return train(sample(docs, part != 2, part == 3, id_col, text_col, lang_col))


def _mapped(docs: DataFrame, model: Model, text_col: str, make: Callable[[pa.RecordBatch, tuple], pa.RecordBatch]) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch, shared.value.predict(batch.column(at).to_pylist()))

    return run


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row; only the text is looked at."""
    held = F.coalesce(crc_remainder(F.col(id_col), 4) == 2, F.lit(False))
    chosen = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def make(batch: pa.RecordBatch, said: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said[0], pa.string()), pa.array(said[1], pa.float64()), pa.array(said[2], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(_mapped(chosen, model, "text", make)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected."""

    def make(batch: pa.RecordBatch, said: tuple) -> pa.RecordBatch:
        return batch.filter(pa.array([not x for x in said[2]], pa.bool_()))

    return map_rows(docs, _mapped(docs, model, text_col, make))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs))
