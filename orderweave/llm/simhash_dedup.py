"""SimHash near-dedup with pivot distance tables.

Fingerprints that differ in at most three of 64 bits agree on one of four 16-bit blocks, so each distinct
fingerprint is dealt to four buckets, by block. Inside a bucket the pivot table has every fingerprint's Hamming
distance to reference fingerprints; by the triangle inequality a pair is within three bits only if no coordinate
differs by more than three. Pairs are taken along the first coordinate, discarded by the largest coordinate
difference, and the survivors verified; what leaves a task is a spanning forest (fewer edges than rows), never
the pairs. A bucket of more than ``LARGE_BUCKET`` fingerprints is dealt again by blocks of its remaining bits,
which is exact for the same reason; after ``LEVELS`` deals the rest is so narrow that a task takes it whole.

Documents of one fingerprint are one node, whatever their number; fingerprints, links and components stay in
tables, and components are found by ``connected_components``.

Three bits are far below what near copies differ in, so ``near_groups``, for dropping them, takes wide fingerprints
of ``WORDS`` x 64 bits over five-word shingles. Texts of Jaccard similarity J have an angle whose cosine is about
2J / (1 + J), and the share of differing bits is that angle by pi; a pair links if it has no more differing bits than
0.8 comes to, plus ``SLACK``, and the same 16 bits in one of the bands. A bucket's pairs go through the same pivot
table, verification and spanning forest. Bands of 16 bits suit some 10^8 documents; ``band_bits`` is a parameter.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of them all; repeated rows and equal texts share a node;
an empty table gives an empty result; other columns are ignored by ``simhash_groups`` and kept by
``drop_near_copies``, which keeps exactly one row of each group, the one of the least id; rows without an id are
in groups too, and stay only where no row of theirs has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.common import Scratch, column, table, tidy
from orderweave.llm.components import connected_components
from orderweave.llm.word_blocks import LOWER, mixed, parts, text_bytes, word_bounds, word_keys

BITS, MOST, BLOCKS = 64, 3, 4
SHINGLE, SEED = 3, 42
PIVOTS, PIVOT_SEED = 48, 11
WORDS, NEAR_SHINGLE, SIMILARITY, SLACK, BAND_BITS = 4, 5, 0.8, 6, 16
PART, AT_ONCE = 1 << 22, 1 << 14  # bytes of text hashed at once, and shingles whose bits are counted at once
LARGE_BUCKET, LEVELS = 4096, 5
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_FEW = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts, k = [0, *ends[:-1].tolist()], min(n, len(parts))
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _FEW):
        bits = np.unpackbits(hashes[at : at + _FEW].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(tidy(run), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis, of several numbers a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, one row a fingerprint and one column a pivot."""
    return np.stack([_distance(fps, p) for p in pivots], axis=1)


def _pivots(words: int = 1) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, (PIVOTS if words == 1 else PIVOTS // 6, words), np.uint64)


def _roots(n: int, u: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``p`` (each node's root) with the edges u-v hooked in, larger roots under smaller."""
    while len(u):
        a, b = p[u], p[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            break
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while (q := p[p]).tobytes() != p.tobytes():
            p = q
    return p


def near_forest(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, root) of the fingerprints (a row of numbers each) within ``most`` bits that have the same key."""
    pivots = _pivots(fps.shape[1])
    first = _distance(fps, pivots[0])
    order = np.lexsort((nodes, first, keys))
    keys, fps, nodes, first = keys[order], fps[order], nodes[order], first[order]
    n = len(fps)
    coords = pivot_table(fps, pivots[1:])
    bucket = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
    p, at = np.arange(n), np.arange(n - 1)
    step = 1
    while len(at):
        j = at + step
        at = at[(keys[j] == keys[at]) & (first[j] - first[at] <= most)]
        j = at + step
        new = p[at] != p[j]  # what is linked already needs no second link
        a, b = at[new], j[new]
        for lo, hi in ((0, 8), (8, coords.shape[1])):
            far = np.abs(coords[a, lo:hi] - coords[b, lo:hi]).max(axis=1, initial=0) if len(a) else np.zeros(0)
            a, b = a[far <= most], b[far <= most]
        close = _distance(fps[a], fps[b]) <= most
        p = _roots(n, a[close], b[close], p)
        if step & (step - 1) == 0:  # a bucket that is one component by now is done
            least, greatest = np.full(bucket[-1] + 1, n), np.zeros(bucket[-1] + 1, np.int64)
            np.minimum.at(least, bucket, p)
            np.maximum.at(greatest, bucket, p)
            at = at[(least < greatest)[bucket[at]]]
        step += 1
        at = at[at + step < n]
    # Roots by value, so that tasks agree on them.
    least = nodes.copy()
    np.minimum.at(least, p, nodes)
    root = least[p]
    child = root != nodes
    return nodes[child], root[child]


def _bucket_edges(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``rows(key, node, f0...)``, all of a key together and sorted, to edges; a task holds the rows of one key and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[np.ndarray]) -> pa.RecordBatch:
            u, v = near_forest(held[0], np.stack(held[2:], axis=1).view(np.uint64), held[1], most)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        held: list[np.ndarray] | None = None
        for b in batches:
            more = [c.to_numpy() for c in b.columns]
            held = more if held is None else [np.concatenate(c) for c in zip(held, more, strict=True)]
            if len(held[0]) >= 1 << 16 and held[0][0] != held[0][-1]:
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                yield done([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield done(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "u long, v long")


def _deal(rows: DataFrame) -> DataFrame:
    """``rows(key, used, fp)`` dealt by the four blocks of the bits not in the mask ``used``: the key takes in block and bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, used, fp = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            out: list[list[np.ndarray]] = [[], [], []]
            masks, where = np.unique(used, return_inverse=True)
            for k, mask in enumerate(masks.tolist()):
                free = [i for i in range(BITS) if not mask >> i & 1]
                mine = where == k
                width = len(free) // BLOCKS
                for block in range(BLOCKS):
                    bits = free[block * width : (block + 1) * width if block < BLOCKS - 1 else len(free)]
                    part = sum(1 << i for i in bits)
                    value = fp[mine] & np.uint64(part)
                    mixed = (key[mine] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= (value + np.uint64(part & (2**63 - 1))) * np.uint64(0x94D049BB133111EB)
                    mixed ^= mixed >> np.uint64(29)
                    for col, x in zip(out, (mixed, np.full(len(value), mask | part, np.uint64), fp[mine]), strict=True):
                        col.append(x)
            cols = [pa.array(np.concatenate(c).view(np.int64) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "used", "fp"])

    return rows.mapInArrow(tidy(run), "key long, used long, fp long")


def near_edges(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """``distinct(fp)``, each once, to edges (u, v) with u > v that connect all within ``MOST`` bits."""
    rows, edges = distinct.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"), "fp"), None
    for level in range(LEVELS):
        dealt = scratch.keep(_deal(rows), "dealt")
        large = scratch.keep(dealt.groupBy("key").count().where(F.col("count") > LARGE_BUCKET).select("key"), "large") if level < LEVELS - 1 else None
        more = large is not None and not large.isEmpty()
        found = _bucket_edges((dealt.join(large, "key", "left_anti") if more else dealt).select("key", F.col("fp").alias("node"), "fp"))
        edges = found if edges is None else edges.union(found)
        if not more:
            break
        rows = dealt.join(large, "key", "left_semi").select("key", "used", "fp")
    return edges


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, id_col, text_col), "fps")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comps = connected_components(scratch, near_edges(scratch, classes.select("fp")))
    rooted = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = NEAR_SHINGLE, words: int = WORDS) -> np.ndarray:
    """SimHashes of ``words`` x 64 bits of many texts' word shingles, one row a text, from the words' hashes."""
    low = LOWER[data]
    starts, ends = word_bounds(low, offsets)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at)
    h = np.append(word_keys(low, starts, ends)[3], np.zeros(shingle, np.uint64))
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(n_words)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[owner]
    joined = np.zeros(len(owner), np.uint64)
    for k in range(shingle):  # a text of fewer words has them all in its one shingle
        joined = mixed(joined ^ h[place + k] * np.uint64(0x9E3779B97F4A7C15)) if k == 0 else np.where(place + k < at[owner + 1], mixed(joined * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[place + k]), joined)
    total = np.zeros((len(n_words), 64 * words), np.int64)
    for lo in range(0, len(owner), AT_ONCE):
        part = joined[lo : lo + AT_ONCE]
        lanes = np.stack([mixed(part + np.uint64((k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) for k in range(words)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1)
        mine = owner[lo : lo + AT_ONCE]
        new = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        total[mine[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * total > count[:, None], axis=1).view(np.uint64).reshape(len(n_words), words)


def most_differing(similarity: float, words: int = WORDS, slack: int = SLACK) -> int:
    """The bits in which wide fingerprints of texts of that similarity differ, and some more."""
    return int(64 * words * np.arccos(2 * similarity / (1 + similarity)) / np.pi) + slack


def band_keys(fps: np.ndarray, band_bits: int = BAND_BITS) -> np.ndarray:
    """The bands of each fingerprint, one column each: its bits in order, then every other bit in order; the number of the band is in the key."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)
    bits = np.concatenate([bits, bits[:, ::2]], axis=1)
    bands = bits.shape[1] // band_bits
    value = bits[:, : bands * band_bits].reshape(len(fps), bands, band_bits).astype(np.int64) @ (np.int64(1) << np.arange(band_bits))
    return value << 8 | np.arange(bands)


def near_groups(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, band_bits: int = BAND_BITS) -> DataFrame:
    """From ``rows(row, text)``, row a number of its own, (row, kept): whether it is the least row of its group of near copies."""
    scratch = Scratch(rows.sparkSession)
    names = [f"f{k}" for k in range(WORDS)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for lo, hi in parts(bounds, PART):
                fps = wide_fingerprints(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(f)) for f in fps.T)], names=["row", *names])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                keys = band_keys(np.stack([c.to_numpy() for c in b.columns[1:]], axis=1), band_bits)
                again = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(again) for c in b.columns)], names=["key", "node", *names])

    kinds = ", ".join(f"{f} long" for f in names)
    fps = scratch.keep(rows.select("row", "text").mapInArrow(tidy(prints), f"row long, {kinds}"), "wide")
    classes = scratch.keep(fps.groupBy(*names).agg(F.min("row").alias("node")), "nodes")
    dealt = scratch.keep(classes.select("node", *names).mapInArrow(tidy(bands), f"key long, node long, {kinds}"), "bands")
    crowded = dealt.groupBy("key").count().where("count > 1").select("key")
    edges = _bucket_edges(dealt.join(crowded, "key", "left_semi"), most_differing(similarity))
    comps = connected_components(scratch, edges)
    scratch.drop(dealt)
    least = classes.join(comps, "node", "left_anti").select("node")  # a node that has a root isn't its group's least
    return fps.join(least.withColumnRenamed("node", "row"), "row", "left_semi").select("row")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    scratch, key, names = Scratch(docs.sparkSession), column(id_col), docs.columns
    whole = docs.schema[id_col].dataType.simpleString() in ("int", "bigint")
    if whole and docs.groupBy(key.alias("k")).count().where("count > 1 OR k IS NULL").isEmpty():
        kept = near_groups(docs.select(key.cast("long").alias("row"), column(text_col).alias("text")), similarity)
        return docs.join(kept, docs["`" + id_col.replace("`", "``") + "`"] == kept["row"], "left_semi")
    # Ids that aren't a key: rows are written with a number first, which goes up with the id and puts missing ids last.
    ordered = docs.select(F.struct(*map(column, names)).alias("all"), key.isNull().alias("no"), key.alias("id")).repartitionByRange("no", "id").sortWithinPartitions("no", "id")
    ordered = scratch.keep(ordered.select(F.monotonically_increasing_id().alias("row"), "all"), "ordered")
    kept = near_groups(ordered.select("row", F.col("all")[text_col].alias("text")), similarity)
    return ordered.join(kept, "row", "left_semi").select(*(F.col("all").getField(n).alias(n) for n in names))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: fingerprint and component."""
    return simhash_groups(table(spark, sf_dir, "documents"))
