"""Vector candidates, hard constraints, score adjustments within a line's pool, and the decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.functions import text as T
from orderweave.operators.linkage import KEY, dimension_conflict, packaging_compatible

# Thresholds and adjustments of the scores.
AUTO, TUPLE_FLOOR, GAP = 0.83, 0.88, 0.03
PACKAGE_BOOST, MODEL_BOOST, COLOR_BOOST = 0.03, 0.03, 0.02
BRAND_BOOST, BRAND_PENALTY, COMPOSITE_PENALTY = 0.35, 0.50, 0.10
TOP_K, POOL, MOST_QUERIES = 30, 5, 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def knn(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = 4096) -> DataFrame:
    """``queries(query_id, embedding)`` against all ``vectors(vec_id, embedding)``: (query_id, vec_id, score, rank0).

    The stated queries go to all tasks, ``MOST_QUERIES`` or so at a time; each task compares them with its vectors by
    blocks and keeps the best of the task, and the best of those are taken. Vectors never move.
    """
    parts = max(1, -(-queries.count() // MOST_QUERIES))
    each = [_knn(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p), vectors, k, block) for p in range(parts)]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id")) - 1
    return found.withColumn("rank0", rank).where(F.col("rank0") < k)


def _knn(queries: DataFrame, vectors: DataFrame, k: int, block: int) -> DataFrame:
    few = queries.select("query_id", "embedding").collect()
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        score, found = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, block):
                part = batch.slice(at, block)
                x = np.array(part.column(1).to_pylist(), np.float64)
                score = np.hstack([score, asked @ x.T])
                found = np.hstack([found, np.broadcast_to(part.column(0).to_numpy(), (len(ids), len(x)))])
                order = np.lexsort((found, -np.round(score, 12)), axis=1)[:, :k]
                score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(found.ravel()), pa.array(score.ravel())], names=["query_id", "vec_id", "score"])

    return vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(best, "query_id long, vec_id long, score double")


def knn_lines(lines: DataFrame, vectors: DataFrame, k: int = TOP_K, slice_rows: int = 200_000) -> DataFrame:
    """``lines(query_id, embedding)`` of any number against a catalog of ``vectors(vec_id, embedding)``.

    The catalog goes to all tasks, ``slice_rows`` vectors at a time; of more than one slice the best are merged.
    Lines are read as a stream and never moved for a catalog of one slice.
    """
    slices = max(1, -(-vectors.count() // slice_rows))
    kinds = {f.name: f.dataType.simpleString() for f in [*lines.schema.fields, *vectors.schema.fields]}
    out = None
    for s in range(slices):
        part = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).orderBy("vec_id").collect()
        shared = lines.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in part], np.array([r["embedding"] for r in part], np.float64).reshape(len(part), -1)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    score = np.round(np.array(b.column(1).to_pylist(), np.float64) @ x.T, 12) if ids else np.zeros((b.num_rows, 0))
                    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    n = order.shape[1]
                    rows = pa.array(np.repeat(np.arange(b.num_rows), n))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([ids[j] for j in order.ravel().tolist()]), pa.array(np.take_along_axis(score, order, 1).ravel()), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))], names=["query_id", "vec_id", "score", "rank0"])

        one = lines.select("query_id", "embedding").mapInArrow(best, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double, rank0 int")
        out = one if out is None else out.unionByName(one)
    if slices > 1:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")) - 1
        out = out.withColumn("rank0", rank.cast("int")).where(F.col("rank0") < k)
    return out


def trigram_vector(text: str, size: int) -> np.ndarray:
    """Character trigrams counted by hash, of unit length."""
    codes = np.frombuffer(f" {text.lower()}  "[: max(3, len(text) + 2)].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    counts = np.bincount((h % np.uint64(size)).astype(np.int64), minlength=size).astype(np.float64)
    return counts / np.linalg.norm(counts)


def hash_embedding(text: Column, size: int = 64) -> Column:
    """Stands for an embedding model where there is none."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: trigram_vector(t or "", size))

    return run(text)


def overlap(terms: Column, value: Column) -> Column:
    """Whether any term contains the value or is in it; an empty value is in everything."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.exists(terms, lambda t: low.contains(F.lower(t)) | F.lower(t).contains(low))


def finish(text: Column) -> Column:
    """The facade finish that a text names, or ``None`` as text."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(text, r"(?iuU)\(\s*(FE|SB|Д)\s*\)", 1), F.lit(""))), F.lit("None"))


def constraint_reason(pairs: DataFrame | None = None) -> Column:
    """The first of the packaging, sub-brand, finish and dimension constraints that a (line, entity) pair breaks, or null.

    Finishes are read off ``query`` and ``search``, unless ``pairs`` have them as ``finish`` and ``entity_finish``.
    """
    brands = F.size(F.array_intersect("sub_brands", "entity_brands")) == 0
    clash = dimension_conflict(F.col("pairs"), F.col("entity_pairs"))
    known = pairs is not None and {"finish", "entity_finish"} <= set(pairs.columns)
    asked, held = (F.col("finish"), F.col("entity_finish")) if known else (finish(F.col("query")), finish(F.col("search")))
    return (
        F.when(~packaging_compatible(F.col("ratio"), F.col("entity_ratio")), "Package ratio mismatch")
        .when((F.size("sub_brands") > 0) & (F.size("entity_brands") > 0) & brands, "Sub-brand conflict")
        .when(asked != held, F.concat(F.lit("facade finish mismatch: "), asked, F.lit(" vs "), held))
        .when(clash.isNotNull(), F.concat(F.lit("dimension conflict: "), clash))
    )


def corpus_conflict(query: Column, entity: Column) -> Column:
    """A corpus order (that doesn't ask for drawers itself) against a drawer or slide."""
    drawers = r"ящик\s+с\s+доводчиком|комплект\s+ящиков|направляющ"
    return query.rlike(r"(?iuU)\(\s*корпус\s*\)|\bкорпус\b") & ~query.rlike(f"(?iuU){drawers}") & entity.rlike(rf"(?iuU){drawers}|(?<!\d)\bящик\b")


def widths_compatible(widths: Column, entity: Column) -> Column:
    """Any width of the entity is among those asked for, in millimetres or centimetres; an entity without widths goes."""
    allowed = F.concat(widths, F.transform(F.filter(widths, lambda w: (w >= 1000) & (w % 10 == 0)), lambda w: (w / 10).cast("int")), F.transform(F.filter(widths, lambda w: w < T.CM_LIMIT), lambda w: w * 10))
    got = T.candidate_widths(entity)
    return (F.size(got) == 0) | F.arrays_overlap(got, allowed)


def linear_conflict(metres: Column, thick: Column, entity: Column) -> Column:
    """Order in metres and thickness: the entity has every thickness, and if it has metres, one within 5 cm."""
    packed = F.replace(F.lower(entity), F.lit(" "), F.lit(""))
    found = T.linear_metres(entity)
    wrong = F.exists(thick, lambda t: ~packed.contains(F.lower(t)))
    far = (F.size(found) > 0) & ~F.exists(found, lambda m: F.abs(m - F.get(metres, F.lit(0))) <= 0.05)
    return (F.size(metres) > 0) & (F.size(thick) > 0) & (wrong | far)


def glass_conflict(item_type: Column, thick: Column, entity: Column) -> Column:
    """An order for glass, by type or by its 4 mm, against anything that isn't glass or mirror or lacks that thickness."""
    of_glass = lambda t: (F.lower(t) == "4мм") | F.lower(t).startswith("4мм/")
    glass = (F.lower(F.trim(item_type)) == "стекло") | F.exists(thick, of_glass)
    packed = F.replace(F.lower(entity), F.lit(" "), F.lit(""))
    return glass & (~entity.rlike("(?iu)стекл|зеркал") | F.exists(F.filter(thick, of_glass), lambda t: ~packed.contains(F.lower(t))))


def hardware_sizes(text: Column) -> Column:
    return F.transform(T.matches(text, r"(?iuU)\d+\s*мм|\d+\s*гр|\d+[,.]?\d*\s*м\b"), lambda m: F.lower(F.regexp_replace(m, r"(?U)\s+", "")))


def hardware_matches(query: Column, colors: Column, entity: Column, color: Column) -> Column:
    """Types, one article, every size and a colour that the order names are the entity's."""
    low = F.lower(entity)
    packed = F.replace(low, F.lit(" "), F.lit(""))
    articles = T.article_tokens(query)
    typed = F.forall(T.hardware_types(query), low.contains)
    numbered = (F.size(articles) == 0) | F.exists(articles, packed.contains)
    sized = F.forall(hardware_sizes(query), packed.contains)
    painted = (F.size(colors) == 0) | ((F.coalesce(color, F.lit("")) != "") & overlap(colors, color)) | F.exists(colors, lambda c: low.contains(F.lower(c)))
    return typed & numbered & sized & painted


def full_constraint_reason() -> Column:
    """All hard constraints in order, over pairs that also have item_type, widths, thick, metres, colors and color.

    Packaging, sub-brand, corpus and finish hold for all; dimensions and glass for what isn't hardware; the
    hardware test for what is.
    """
    q, e = F.col("query"), F.col("search")
    hardware = T.is_hardware(q)
    cut = (F.size("pairs") > 0) & ((F.lower(F.trim("item_type")) == "стекло") | q.rlike("(?iu)стекл|зеркал"))
    none = F.size("entity_pairs") == 0
    met = F.arrays_overlap("pairs", "entity_pairs")
    plain = constraint_reason(None)
    size_ = (
        F.when((F.size("widths") > 0) & ~widths_compatible(F.col("widths"), e), "dimension mismatch: none of the widths")
        .when(linear_conflict(F.col("metres"), F.col("thick"), e), "linear dimension or thickness mismatch")
        .when((F.size("widths") == 0) & cut & (none | ~met), "custom size not in catalog")
    )
    early = ~F.coalesce(plain.startswith("dimension conflict"), F.lit(True))
    return (
        F.when(early & plain.isin("Package ratio mismatch", "Sub-brand conflict"), plain)
        .when(corpus_conflict(q, e), "Corpus vs drawer/slide isolation")
        .when(early, plain)
        .when(~hardware & size_.isNotNull(), size_)
        .when(~hardware & (F.size("widths") == 0) & plain.isNotNull(), plain)
        .when(~hardware & glass_conflict(F.col("item_type"), F.col("thick"), e), "glass/material mismatch")
        .when(hardware & ~hardware_matches(q, F.col("colors"), e, F.col("color")), "hardware type/size/color mismatch")
    )


def high_confidence() -> Column:
    """Model, packaging, colour and module of a pair all agree."""
    module = F.lower(F.trim("entity_module"))
    query = F.lower("query")
    named = (module != "") & (query.contains(module) | ((F.size(T.significant_tokens(module)) > 0) & F.forall(T.significant_tokens(module), query.contains)))
    return F.coalesce((F.size("models") > 0) & (F.col("label_model") != "") & overlap(F.col("models"), F.col("label_model")) & T.packaging_equal(F.col("ratio"), F.col("entity_ratio")) & (F.size("colors") > 0) & (F.col("color") != "") & overlap(F.col("colors"), F.col("color")) & named, F.lit(False))


def with_alignment(pairs: DataFrame) -> DataFrame:
    """Adds ``aligned``: what tells products apart agrees (decor codes, product words, part types, sizes, the name as a whole).

    ``pairs`` also have client_description, match_text (the description and its alias) and part_types. Each layer
    reads the one before, so that a text is worked out once.
    """
    p = pairs.withColumns({"__low": F.lower("search"), "__text": T.search_text(F.col("client_description")), "__asks": T.is_hardware(F.col("match_text"))})
    p = p.withColumns({"__packed": F.replace(F.col("__low"), F.lit(" "), F.lit("")), "__own": T.slug(F.col("__text")), "__other": T.slug(F.col("search"))})
    p = p.withColumns({
        "__codes": T.matches(F.lower("match_text"), r"(?U)\b\d{3,4}/[a-z]{1,3}\b"), "__mine": F.array_distinct(T.significant_tokens(F.col("__own"))),
        "__theirs": T.significant_tokens(F.col("__other")), "__words": F.filter(T.significant_tokens(F.col("__own")), lambda t: (F.length(t) >= 4) & ~t.isin(T.GENERIC_TOKENS)),
    })
    e, words, own, other, mine = (F.col(c) for c in ("__low", "__words", "__own", "__other", "__mine"))
    named = (F.size(words) == 0) | (F.size(F.filter(words, e.contains)) >= 0.75 * F.size(words))
    typed = F.forall(F.filter("part_types", lambda t: (F.length(t) >= 5) & ~F.lower(t).isin(T.GENERIC_TOKENS)), lambda t: e.contains(F.lower(t)))
    sized = F.when(F.size("widths") > 0, widths_compatible(F.col("widths"), F.col("search"))).when(F.size("pairs") > 0, F.arrays_overlap("pairs", "entity_pairs")).otherwise(F.lit(True))
    alike = (own == "") | (other == "") | other.contains(own) | own.contains(other) | (F.size(mine) == 0) | (2 * F.size(F.array_intersect(mine, "__theirs")) >= F.size(mine))
    plain = F.forall("__codes", F.col("__packed").contains) & named & typed & sized & alike
    fits = F.when(F.col("__asks"), hardware_matches(F.col("match_text"), F.col("colors"), F.col("search"), F.col("color"))).otherwise(plain)
    return p.withColumn("aligned", F.coalesce(fits, F.lit(False))).select(*pairs.columns, "aligned")


def boosted(pairs: DataFrame) -> DataFrame:
    """Adds packaging, model and colour boosts to scores of pairs that passed, one at most."""
    passed = F.col("reason").isNull()
    boost = (
        F.when(T.packaging_equal(F.col("ratio"), F.col("entity_ratio")), PACKAGE_BOOST).otherwise(0.0)
        + F.when((F.size("models") > 0) & (F.col("label_model") != "") & overlap(F.col("models"), F.col("label_model")), MODEL_BOOST).otherwise(0.0)
        + F.when((F.size("colors") > 0) & (F.col("color") != "") & overlap(F.col("colors"), F.col("color")), COLOR_BOOST).otherwise(0.0)
    )
    return pairs.withColumn("boost", boost).withColumn("score", F.when(passed, F.least(F.lit(1.0), F.col("score") + F.col("boost"))).otherwise(F.col("score")))


def sub_brand_barrier(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Within a line: with a sub-brand asked for and met, those that have it rise and plain ones fall; with none asked for and a plain one there, branded ones fall."""
    w = W.partitionBy(*key)
    stays, moves, met = _barred()
    return pairs.withColumn("__met", F.max(met).over(w)).withColumn("score", F.when(F.col("__met"), moves).otherwise(stays)).drop("__met")


def _barred() -> tuple[Column, Column, Column]:
    """A pair's score without and with the sub-brand barrier, and whether it is a pair for which its line's barrier holds."""
    asked, plain, s = F.size("sub_brands") > 0, F.size("entity_brands") == 0, F.col("score")
    passed, aligned = F.col("reason").isNull(), F.size(F.array_intersect("sub_brands", "entity_brands")) > 0
    fall = F.greatest(F.lit(0.0), s - BRAND_PENALTY)
    moves = F.when(~passed, s).when(asked, F.when(aligned, F.least(F.lit(1.0), s + BRAND_BOOST)).when(plain, fall).otherwise(s)).when(~plain, fall).otherwise(s)
    return s, moves, passed & F.when(asked, aligned).otherwise(plain)


def barrier_totals(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(line, best, total) of the scores that ``sub_brand_barrier`` gives, by one aggregation: pairs are neither sorted nor kept."""
    stays, moves, met = _barred()
    p = pairs.select(*key, stays.alias("s"), moves.alias("m"), met.alias("met"))
    g = p.groupBy(*key).agg(F.max("met").alias("met"), *(f(c).alias(n + c) for n, f in (("best_", F.max), ("total_", F.sum)) for c in "sm"))
    return g.select(*key, *(F.when(F.col("met"), F.col(n + "_m")).otherwise(F.col(n + "_s")).alias(n) for n in ("best", "total")))


def color_barrier(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Within a line that names one plain colour: composite decors fall if a plain one overlaps it as well."""
    w, passed = W.partitionBy(*key), F.col("reason").isNull()
    composite, meets = F.coalesce(F.col("color"), F.lit("")).rlike("[/-]"), overlap(F.col("colors"), F.col("color"))
    wanted = (F.size("colors") > 0) & ~F.col("composite")
    p = pairs.withColumn("plain", F.max(passed & ~composite & meets).over(w))
    s = F.when(passed & wanted & F.col("plain") & composite & meets, F.greatest(F.lit(0.0), F.col("score") - COMPOSITE_PENALTY)).otherwise(F.col("score"))
    return p.withColumn("score", s).drop("plain")


def top1(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Each line's best pair that passed, with the best rival of the same key (``rival``) and how many passed.

    The order is by score, then the order in which candidates came, then code.
    """
    w = W.partitionBy(*key).orderBy(F.col("score").desc(), "rank0", "code")
    p = pairs.where(F.col("reason").isNull()).withColumn("rn", F.row_number().over(w))
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = p.withColumn("top_key", F.first("same_key").over(every))
    rival = F.max(F.when((F.col("rn") > 1) & (F.col("same_key") == F.col("top_key")), F.col("score"))).over(every)
    return p.withColumns({"rival": rival, "n_passed": F.count("*").over(every)}).where("rn = 1").drop("rn", "top_key")


def _clear() -> Column:
    return F.col("rival").isNull() | (F.round(F.col("score") - F.col("rival"), 9) >= GAP)


def status(top: DataFrame) -> Column:
    """Auto at once for a ``sure`` pair; else only one that is ``aligned``, clear of rivals of the same kind, and above the threshold."""
    return F.when(F.col("sure") | (F.col("aligned") & _clear() & (F.col("score") >= AUTO)), "MATCHED_AUTO").otherwise("NEEDS_LLM")


def explain(top: DataFrame) -> Column:
    """Why a line's best pair isn't taken by itself, or that it is."""
    gap = F.format_number(F.col("score") - F.col("rival"), 3)
    # The wording.
    return (
        F.when(status(top) == "MATCHED_AUTO", "auto-matched")
        .when(~F.col("aligned"), "distinctive product tokens/decor codes do not align with top candidate")
        .when(~_clear(), F.concat(F.lit("ambiguous collision among same-characteristic candidates (gap="), gap, F.lit(f" < {GAP})")))
        .when(F.col("score") < AUTO, F.concat(F.lit("score "), F.format_number("score", 3), F.lit(f" below auto threshold {AUTO} (feature boost="), F.format_number("boost", 2), F.lit(")")))
    )


def explain_empty(pairs: DataFrame, key: list[str] = KEY, names: DataFrame | None = None) -> DataFrame:
    """(line, why) of lines whose every pair broke a constraint: the first three by rank, with what they broke.

    ``names(code, nomenclature)`` are for pairs without names.
    """
    w = W.partitionBy(*key).orderBy("rank0", "code")
    p = pairs.withColumns({"n_passed": F.count_if(F.col("reason").isNull()).over(W.partitionBy(*key)), "rn": F.row_number().over(w)}).where("n_passed = 0 AND rn <= 3")
    p = p if names is None else p.join(names, "code")
    said = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(": ", "reason", F.left("nomenclature", F.lit(50))).alias("v")))), lambda x: x["v"])
    return p.groupBy(*key).agg(F.concat(F.lit("no candidates passed hard filters (QUARANTINE) — "), F.array_join(said, "; ")).alias("why"))


def best_three(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(line, n, n_passed, top_three) from pairs with reason and score; the best three are given whether they passed or not, with what they broke."""
    w = W.partitionBy(*key)
    best = w.orderBy(F.col("score").desc(), "rank0", "code")
    p = pairs.withColumns({"n": F.count("*").over(w), "n_passed": F.count_if(F.col("reason").isNull()).over(w), "rn": F.row_number().over(best)}).where("rn <= 3")
    each = F.transform(F.array_sort(F.collect_list(F.struct("rn", "code", "score", "reason"))), lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"), x["reason"].alias("reason")))
    return p.groupBy(*key).agg(F.max("n").alias("n"), F.max("n_passed").alias("n_passed"), each.alias("top_three"))


def diagnose(pairs: DataFrame) -> DataFrame:
    """(line, n, n_passed, top_three, why) for calibration, from pairs with reason, score, boost, nomenclature, sure and aligned."""
    top = top1(pairs)
    said = top.select(*KEY, explain(top).alias("why")).unionByName(explain_empty(pairs))
    return best_three(pairs).join(said, KEY, "left")


def resolver_jobs(decisions: DataFrame) -> DataFrame:
    """One job for all lines that ask the same of the same candidates; ``answers.resolve`` is called once a job. Rows may stand for ``n_lines`` lines."""
    key = F.sha2(F.concat_ws("", F.lower(F.trim("client_description")), F.array_join(F.array_sort("codes"), ",")), 256)
    return decisions.withColumn("job_key", key).groupBy("job_key").agg((F.sum("n_lines") if "n_lines" in decisions.columns else F.count("*")).alias("n_lines"), F.min("client_description").alias("client_description"), F.first("codes").alias("codes"))
