"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices, each at a node of a 255-node tree; every node has its own binary context tree
over the ``DEPTH`` bytes before. A cell is a context of some depth and a node. Deepest first, a cell's
Krichevsky-Trofimov block probability is weighted half and half with the product of its children's, which also
gives the cell's weight against all deeper ones. A text's probability is the product over its bits of the estimates
of all depths mixed by those weights, so every byte has a code length and -score / log10(2) / bytes is the code
length per byte in bits.

One pass over all documents counts grams (the ``DEPTH`` bytes before, and the byte) and words: each task adds up what
it sees, Spark adds up the tasks. Grams that training never has come along with a count of zero. All cells of depth 2
and more below one two-byte context are worked out together, from its grams, by whatever task has them (2 ** 24 grams
at most, whatever the corpus); a first round brings the sums for the 65,280 cells of depth 1 to the driver, a second
takes the mixed estimates of depth 0 and 1 and gives the log probability of every gram of the corpus. So no cell is
left out or stands for another, and nothing is joined by cell.

A scoring task gets a bounded part of the result: the ``KNOWN`` most frequent grams and the ``FREQUENT`` most frequent
words, with their keys, which are compared. All other grams and words of a document are joined with the tables.

Defined results: a null text is empty and has its end alone; a text ends with a byte that UTF-8 never has, so
probabilities of all texts add up to one; without training documents every bit has probability one half and N
is 0; a row without an id is never held out; repeated rows count and are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.common import Scratch, crc_remainder, table, tidy
from orderweave.llm.word_blocks import LOWER, Lookup, Seen, binary_array, distinct, loads, mixed, parts, text_bytes, word_bounds, word_keys

DEPTH = 4
FREQUENT, KNOWN = 1 << 19, 1 << 21
LONGEST_SENT = 64  # bytes of a word that is sent to all tasks
BLOCK = 1 << 18  # bytes whose grams are counted or scored at once
PART = 1 << 20  # bytes of text whose words are, or one text
HELD, HELD_WORDS = 1 << 20, 1 << 20  # distinct grams that a task holds before it adds them up, and distinct words before it passes them on
GROUPED = 1 << 19  # grams worked out together, unless one two-byte context has more
_HALF = math.log10(0.5)
_END = 0xFF
_U = np.uint64
_TABLE = 1 << 16
_LG_HALF = np.array([math.lgamma(k + 0.5) for k in range(_TABLE)])
_LG_ONE = np.array([math.lgamma(k + 1.0) for k in range(_TABLE)])


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with ``DEPTH`` end bytes before each and one after; which bytes count; where each text begins.

    Eight bytes of padding are in front.
    """
    n, width = len(offsets) - 1, DEPTH + 1
    begins = offsets[:-1] + width * np.arange(n)
    out = np.full(len(data) + width * n + 8, _END, np.uint8)
    counts = np.ones(len(out) - 8, bool)
    counts[(begins[:, None] + np.arange(DEPTH)).ravel()] = False
    plain = counts.copy()
    plain[begins + np.diff(offsets) + DEPTH] = False
    out[8:][plain] = data
    return out, counts, begins


def grams_at(out: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The gram that ends at each place of a stream: the ``DEPTH`` bytes before and the byte, as one number."""
    return loads(out[lo + 1 : hi + 8]).byteswap() & _U((1 << 8 * (DEPTH + 1)) - 1)


def grams(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, counts, _ = stream(data, np.array([0, len(data)]))
    return grams_at(out, 0, len(counts))[counts]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large arguments."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _gammas(k: np.ndarray, known: np.ndarray, more: float) -> np.ndarray:
    out = known[np.minimum(k, _TABLE - 1)]
    large = np.flatnonzero(k >= _TABLE)
    out[large] = _log_gamma(k[large] + more)
    return out


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return _gammas(a, _LG_HALF, 0.5) + _gammas(b, _LG_HALF, 0.5) - math.log(math.pi) - _gammas(a + b, _LG_ONE, 1.0)


def _weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the log weighted probability, and the weight of its own estimate; ``below`` is that of its children."""
    own = kt_log(a, b)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below)
    return both - math.log(2), np.exp(own - both)


def deep_cells(gram: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, ...]]]]:
    """For each bit, by depth down to 2: each gram's cell, and the cells' zeros, ones, log weighted probability, weight, and one gram."""
    byte, context = gram & _U(255), gram >> _U(8)
    sorted_ = []
    for depth in range(DEPTH, 1, -1):
        key = (context & _U((1 << 8 * depth) - 1)) << _U(8) | byte
        order = np.argsort(key)
        sorted_.append((depth, order, key[order], n[order], byte[order]))
    for bit in range(8):
        out, last = {}, None
        for depth, order, key, count, own_byte in sorted_:
            k = key >> _U(8 - bit)
            new = np.append(True, k[1:] != k[:-1])
            at, cell = np.flatnonzero(new), np.empty(len(k), np.int64)
            cell[order] = np.cumsum(new) - 1
            every = np.add.reduceat(count, at)
            b = np.add.reduceat(count * (own_byte >> _U(7 - bit) & _U(1)).astype(np.int64), at)
            below = None if last is None else np.bincount(cell[last[5]], last[3], len(at))
            last = out[depth] = (cell, every - b, b, *_weigh(every - b, b, below), order[at])
        yield bit, out


def _upper(gram: np.ndarray, bit: int) -> np.ndarray:
    """The cell of depth 1: the last byte before, and the node (a leading one and the bits so far)."""
    return (gram >> _U(8) & _U(255)).astype(np.int64) << 8 | 1 << bit | (gram & _U(255)).astype(np.int64) >> (8 - bit)


def _grouped(grams_: DataFrame, schema: str, run) -> DataFrame:
    """``run(gram, n)`` on all grams of some two-byte contexts at a time."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in found:
            held.append(tuple(c.to_numpy() for c in b.columns))
            size += b.num_rows
            if size < GROUPED:
                continue
            c2, gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(c2, c2[-1]))
            if cut:
                yield from run(gram[:cut].view(np.uint64), n[:cut])
            held, size = [(c2[cut:], gram[cut:], n[cut:])], len(c2) - cut
        if size:
            _, gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from run(gram.view(np.uint64), n)

    keyed = grams_.select(F.expr("cast(shiftrightunsigned(gram, 8) & 65535 AS int)").alias("c2"), "gram", "n")
    return keyed.repartition("c2").sortWithinPartitions("c2").mapInArrow(tidy(batches), schema)


class Top:
    """The cells of depth 0 and 1, from the sums for those of depth 1 (zeros, ones, log probability below)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        one, share = [], []
        weighted, own = _weigh(a, b, below)
        a0, b0, below0 = (x.reshape(256, 256).sum(axis=0) for x in (a, b, weighted))
        _, own0 = _weigh(a0, b0, below0)
        node = np.arange(1 << 16) & 255
        one, share = (b0 + 0.5) / (a0 + b0 + 1), np.where(a0 + b0 > 0, own0, 0.0)
        p, base, rest = np.where(a0 + b0 > 0, one, 0.5)[node], (share * one)[node], (1 - share)[node]
        one, seen = (b + 0.5) / (a + b + 1), a + b > 0
        #: By cell of depth 1: the estimate if nothing deeper is seen; with deeper cells it is base + rest * theirs.
        self.p = np.where(seen, base + rest * one, p)
        self.base = np.where(seen, base + rest * own * one, base)
        self.rest = np.where(seen, rest * (1 - own), rest)


def _upward(grams_: DataFrame) -> Top:
    """The sums of all cells of depth 2 by their cell of depth 1: 65,280 rows at most come to the driver."""

    def run(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, below = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
        for bit, cells in deep_cells(gram, n):
            _, zeros, ones, weighted, _, first = cells[2]
            up = _upper(gram[first], bit)
            np.add.at(a, up, zeros)
            np.add.at(b, up, ones)
            np.add.at(below, up, weighted)
        used = np.flatnonzero(a + b)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(a[used]), pa.array(b[used]), pa.array(below[used])], names=["cell", "a", "b", "below"])

    sums = _grouped(grams_, "cell int, a long, b long, below double", run).groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    a, b, below = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
    for x, name in ((a, "a"), (b, "b"), (below, "below")):
        x[sums["cell"].to_numpy()] = sums[name].to_numpy()
    return Top(a, b, below)


def gram_table(grams_: DataFrame, top: Top) -> DataFrame:
    """(gram, n, log) from (gram, n): log10 of the byte after the bytes before it, of grams seen and not seen."""
    shared = grams_.sparkSession.sparkContext.broadcast(top)

    def run(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        up, log = shared.value, np.zeros(len(gram))
        for bit, cells in deep_cells(gram, n):
            at = _upper(gram, bit)
            p, base, rest = up.p[at], up.base[at], up.rest[at]
            for depth in range(2, DEPTH + 1):
                cell, a, b, _, share, _ = cells[depth]
                one, seen = ((b + 0.5) / (a + b + 1))[cell], (a + b > 0)[cell]
                p = np.where(seen, base + rest * one, p)
                share = np.where(seen, share[cell], 0.0)
                base, rest = base + rest * share * one, rest * (1 - share)
            log += np.log10(np.where(gram >> _U(7 - bit) & _U(1) == 1, p, 1 - p))
        for lo in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (gram.view(np.int64), n, log)], names=["gram", "n", "log"])

    return _grouped(grams_, "gram long, n long, log double", run)


def _of_texts(values: np.ndarray, begins: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The text's value at each place of a stretch of the stream."""
    first, upto = max(int(np.searchsorted(begins, lo, "right")) - 1, 0), int(np.searchsorted(begins, hi))
    return np.repeat(values[first:upto], np.diff(np.clip(np.append(begins[first:upto], hi), lo, hi)))


class _Words:
    """Counts the words of a task."""

    def __init__(self) -> None:
        self.seen, self.words, self.n, self.ends = Seen(), [], np.zeros(0, np.int64), 0

    def add(self, data: np.ndarray, offsets: np.ndarray, learn: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends = word_bounds(low, offsets)
        if not learn.all():
            mine = np.repeat(learn, np.diff(np.searchsorted(starts, offsets)))
            starts, ends = starts[mine], ends[mine]
        keys = word_keys(low, starts, ends)
        at = self.seen.find(keys)
        new = np.flatnonzero(at < 0)
        first, number = distinct(keys[:, new])
        at[new] = len(self.seen) + number
        first = new[first]
        self.seen.learn(keys[:, first])
        self.words.append(binary_array(low, starts[first], ends[first]))
        self.n = np.bincount(at, minlength=len(self.seen)) + np.append(self.n, np.zeros(len(first), np.int64))
        self.ends += int(learn.sum())

    def told(self) -> Iterator[pa.RecordBatch]:
        """All words so far; it begins anew."""
        words = pa.concat_arrays([*self.words, pa.array([b""], pa.binary())])
        n = pa.array(np.append(self.n, self.ends).astype(np.int64))
        every = pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), words, n], names=["gram", "word", "n"])
        for lo in range(0, len(n) if self.ends else 0, 100_000):
            yield every.slice(lo, 100_000)
        self.__init__()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return [key[at]], [np.add.reduceat(n, at) if len(at) else n]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """From ``rows(text, learn)``: (gram, null, n) and (null, word, n), n over the rows to learn from; the end is the empty word.

    Words are listed only if they are learnt, grams of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, _Words()
        for batch in batches:
            every, bounds = text_bytes(batch.column(0))
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for top, bottom in parts(bounds, PART):
                data, offsets, learn = every[bounds[top] : bounds[bottom]], bounds[top : bottom + 1] - bounds[top], flags[top:bottom]
                out, real, begins = stream(data, offsets)
                for lo in range(0, len(real), BLOCK):
                    hi = min(lo + BLOCK, len(real))
                    learnt = _of_texts(learn, begins, lo, hi)
                    g = (grams_at(out, lo, hi) << _U(1) | learnt)[real[lo:hi]]
                    g.sort()
                    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
                    n = np.diff(np.append(at, len(g)))
                    n[g[at] & _U(1) == 0] = 0
                    keys.append(g[at] >> _U(1))
                    counts.append(n)
                    held += len(at)
                    if held >= HELD:
                        keys, counts = _added(keys, counts)
                        held = 0
                words.add(data, offsets, learn)
                if len(words.seen) >= HELD_WORDS:
                    yield from words.told()
        yield from words.told()
        key, n = _added(keys, counts)
        for lo in range(0, len(key[0]), 100_000):
            part = pa.array(key[0][lo : lo + 100_000].view(np.int64))
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), pa.binary()), pa.array(n[0][lo : lo + 100_000])], names=["gram", "word", "n"])

    return rows.select("text", "learn").mapInArrow(tidy(run), "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


def build(scratch: Scratch, training: DataFrame) -> tuple[DataFrame, Top]:
    """The counts of all grams of ``training``, and the cells of depth 0 and 1."""
    counts = corpus_counts(training.select("text", F.lit(True).alias("learn")))
    seen = scratch.keep(counts.where("word IS NULL").select("gram", "n"), "grams")
    return seen, _upward(seen)


def gram_logs(gram: np.ndarray, seen: DataFrame, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the bytes before it, for a few grams."""
    asked = seen.sparkSession.createDataFrame([(int(g), 0) for g in np.unique(gram)], "gram long, n long")
    every = gram_table(seen.union(asked).groupBy("gram").agg(F.sum("n").alias("n")), top)
    logs = {r.gram: r.log for r in every.join(asked.select("gram"), "gram", "left_semi").collect()}
    return np.array([logs[int(g)] for g in gram])


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """Of ``rows(n, ...)`` those of at least some count: as many as are ``most`` at most. Nothing is sorted; what comes to the driver are counts by eighths of powers of two."""
    step = F.floor(F.log2(F.col("n") + 1) * 8)
    total, least = 0, None
    for r in rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return rows.where(step >= least if least is not None else F.lit(False))


def _gram_keys(gram: np.ndarray) -> np.ndarray:
    return np.stack([gram, mixed(gram * _U(0x9E3779B97F4A7C15))])


def _per_text(owner: np.ndarray, values: np.ndarray, texts: int) -> pa.Array:
    """Values in the order of their texts, as one list a text."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=texts))).astype(np.int32)), values)


class Scorer:
    """What a scoring task knows: some words' and some grams' log probabilities."""

    def __init__(self, words: np.ndarray, word_n: np.ndarray, end_n: int, gram: np.ndarray, n: np.ndarray, log: np.ndarray):
        self.words, self.grams, self.end_n = Lookup(words, word_n), Lookup(_gram_keys(gram), n), end_n
        self.word_logs, self.gram_logs = np.log10(word_n + 1.0)[self.words.order], log[self.grams.order]
        self.words.order = self.grams.order = None  # it is sent to all tasks

    def score(self, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        """Of each text: tokens, how many of them the task knows, their logs, the log of known grams; the other words, grams and their counts."""
        size, low = len(offsets) - 1, LOWER[data]
        starts, ends = word_bounds(low, offsets)
        n_words = np.diff(np.searchsorted(starts, offsets))
        owner = np.repeat(np.arange(size), n_words)
        at = self.words.find(word_keys(low, starts, ends))
        rare, found = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        said = np.bincount(owner[found], self.word_logs[at[found]], size) + math.log10(self.end_n + 1)
        known = np.bincount(owner[found], minlength=size) + (self.end_n > 0)
        score, keys, counts, owners = np.zeros(size), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        out, real, begins = stream(data, offsets)
        for lo in range(0, len(real), BLOCK):
            hi = min(lo + BLOCK, len(real))
            mine, g = _of_texts(np.arange(size), begins, lo, hi)[real[lo:hi]], grams_at(out, lo, hi)[real[lo:hi]]
            at = self.grams.find(_gram_keys(g))
            here, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            score += np.bincount(mine[here], self.gram_logs[at[here]], size)
            order = other[np.lexsort((g[other], mine[other]))]
            g, mine = g[order], mine[order]
            new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (mine[1:] != mine[:-1]))[: len(g)])
            keys.append(g[new])
            owners.append(mine[new])
            counts.append(np.diff(np.append(new, len(g))))
        keys, counts, owners = (np.concatenate(x) for x in (keys, counts, owners))
        numbers = [pa.array(x) for x in ((n_words + 1).astype(np.int64), known.astype(np.int64), said, score)]
        return [*numbers, _per_text(owner[rare], binary_array(low, starts[rare], ends[rare]), size), _per_text(owners, pa.array(keys.view(np.int64)), size), _per_text(owners, pa.array(counts.astype(np.int64)), size)]


def score_documents(docs: DataFrame, training: DataFrame | Column, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, n_known, train_tokens, base_score and score.

    It learns from the rows of ``training(text)``, or from those rows of ``docs`` for which the column holds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    if isinstance(training, Column):
        rows = docs.select("text", F.coalesce(training, F.lit(False)).alias("learn"))
    else:
        rows = docs.select("text", F.lit(False).alias("learn")).union(training.select("text", F.lit(True)))
    counts = scratch.keep(corpus_counts(rows), "counts")
    words, seen = counts.where("word IS NOT NULL").select("word", "n"), counts.where("word IS NULL").select("gram", "n")
    total, v, end = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    sent = _most_frequent(words.where(F.octet_length("word").between(1, LONGEST_SENT)), FREQUENT).toArrow()
    data, offsets = text_bytes(sent["word"].combine_chunks())
    known = word_keys(data, offsets[:-1], offsets[1:]), sent["n"].to_numpy()
    learnt = scratch.keep(gram_table(seen, _upward(seen)), "learnt")
    grams_ = _most_frequent(learnt, KNOWN).toArrow()
    shared = spark.sparkContext.broadcast(Scorer(*known, end, grams_["gram"].to_numpy().astype(np.uint64), grams_["n"].to_numpy(), grams_["log"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, bounds = text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in parts(bounds, PART):
                found = shared.value.score(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                rows = pa.array(np.arange(row, row + hi - lo))
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], rows, *found], names=[*batch.schema.names[:-1], "row", "n_tokens", "known", "logs", "score", "rare", "others", "counts"])

    chosen = docs.select(*keep, "text")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    scored = chosen.mapInArrow(tidy(run), f"{head}, row long, n_tokens long, known long, logs double, score double, rare array<binary>, others array<long>, counts array<long>")
    scored = scratch.keep(scored, "scored")
    word = scored.select("row", F.explode("rare").alias("word")).join(words, "word")
    word = word.select("row", F.lit(1).alias("k"), F.log10(F.col("n") + 1).alias("l"), F.lit(0.0).alias("more"))
    gram = scored.select("row", F.explode(F.arrays_zip("others", "counts")).alias("x")).select("row", F.col("x.others").alias("gram"), F.col("x.counts").alias("times"))
    gram = gram.join(learnt.select("gram", "log"), "gram").select("row", F.lit(0).alias("k"), F.lit(0.0).alias("l"), (F.col("times") * F.col("log")).alias("more"))
    rest = word.union(gram).groupBy(F.col("row").alias("of")).agg(F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("more").alias("more"))
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    base = F.col("logs") + zero("l") - F.col("n_tokens") * F.lit(math.log10(total + v + 1))
    out = scored.join(rest, F.col("row") == F.col("of"), "left")
    return out.select(*keep, "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("more")).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a model of those whose crc32 of the id is not 2 modulo 7."""
    held = F.coalesce(crc_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return score_documents(docs, ~F.col("held_out"), ["doc_id", "held_out"])
