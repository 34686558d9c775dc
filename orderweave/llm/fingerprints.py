"""Document fingerprints: a canonical exact digest.

A text is brought to its canonical form (NFKC, full case folding, NFKC again, white space folded to single
spaces and trimmed) by built-in SQL functions; ``reflect`` reaches the Unicode routines that Spark itself ships
with. Two xxHash64 lanes of different seeds make a digest of 128 bits. Texts of one digest are then compared byte
by byte (the least and the greatest canonical text of the group; both are partial aggregates, so a group of any
size is compared where it lies); should they differ, the classes inside that digest are numbered and the number
is part of the fingerprint. So fingerprints are equal exactly if canonical texts are.

The next document is found without one global sort: ids are dealt to ranges, each range gets the first document
of the next range as a last row of its own, and a window inside the range does the rest; texts are shuffled once.
Ranges are parts of equal width between counted quantiles of the ids, so an outlying id moves no more than the rows
of its own quantile together; rows without an id are dealt by a hash of their text.

Defined results: ids are whole numbers (others fail the cast); a null text is empty; rows of one id are ordered by a
hash of the text, then by text; rows without an id come first; the only row is followed by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.llm.common import Scratch, table

ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 1024, 200_000
QUANTILES = 256
#: Digests or ids (16 bytes each) up to which a list is broadcast rather than shuffled.
BROADCAST_KEYS = 500_000
SECOND_LANE = 20_240_229
#: Stands for a null id inside, where ids are compared; it comes before all others.
NO_ID = -(2**63)
_WHITE = r"[\x09-\x0D\x1C-\x20\x85   -     　]+"


def canonical(text: Column) -> Column:
    """The canonical form. A text of as many bytes as code points is ASCII, which ``lower`` folds as well."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, _WHITE, " "))


def digest(canon: Column, bits: int = 64) -> Column:
    """Both lanes; ``bits`` below 64 weakens them, so that tests meet unequal texts of one digest."""
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")
    return F.struct(F.xxhash64(canon).bitwiseAND(mask).alias("a"), F.xxhash64(F.lit(SECOND_LANE), canon).bitwiseAND(mask).alias("b"))


def _hex(d: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{d}.a"), 16, "0"), F.lpad(F.hex(f"{d}.b"), 16, "0")))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def _number(bounds: list[int], at: Column, low: int = 0) -> Column:
    """How many of the sorted bounds are at most ``at``, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(at < F.lit(bounds[mid]), _number(bounds[:mid], at, low)).otherwise(_number(bounds[mid + 1 :], at, low + mid + 1))


def ranged(own: DataFrame) -> DataFrame:
    """``own(doc_id, t)`` with ``range``, which goes up with (doc_id, o), and o, a hash of the text."""
    ids = own.where(F.col("doc_id") != NO_ID)
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    least, most, n, bounds = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.percentile_approx("doc_id", shares, 10 * QUANTILES)).first()
    bounds = sorted({*(bounds or ()), least or 0} - {None})
    ranges = min(max(LEAST_RANGES, n // ROWS_A_RANGE), MOST_RANGES) // QUANTILES
    ends = [*bounds[1:], (most or 0) + 1]
    widths = [max(1, -(-(e - b) // ranges)) for b, e in zip(bounds, ends, strict=True)]
    part = _number(bounds[1:], F.col("doc_id"))
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("part") + 1)
    rows = own.withColumns({"o": F.xxhash64("t"), "part": part})
    inside = F.floor((F.col("doc_id") - pick(bounds)) / pick(widths))
    dealt = F.when(F.col("doc_id") == NO_ID, F.shiftright("o", 54) - 1024).otherwise(F.col("part").cast("long") * ranges + F.least(inside, F.lit(ranges - 1)))
    return rows.select("doc_id", "t", "o", dealt.cast("long").alias("range"))


def with_next(own: DataFrame) -> DataFrame:
    """``own(doc_id, t)`` with next_id and next_t: the row that follows by id, after the last the first."""
    own = ranged(own)
    # One row a range, at most MOST_RANGES and 1024: small enough for one task and for a broadcast.
    firsts = own.groupBy("range").agg(F.min(F.struct("doc_id", "o")).alias("first"))
    w = W.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("of"))
    heads = own.select("doc_id", "o", "t").join(F.broadcast(firsts), F.struct("doc_id", "o") == F.col("of"))
    heads = heads.groupBy("range").agg(F.min("t").alias("t"), F.first("doc_id").alias("doc_id"), F.first("o").alias("o"))
    both = own.select("range", F.lit(False).alias("head"), "doc_id", "o", "t").unionByName(heads.select("range", F.lit(True).alias("head"), "doc_id", "o", "t"))
    w = W.partitionBy("range").orderBy("head", "doc_id", "o", "t")
    return both.select("head", "doc_id", "t", F.lead("doc_id").over(w).alias("next_id"), F.lead("t").over(w).alias("next_t")).where("NOT head").drop("head")


def _edited() -> Column:
    half = F.floor(F.length("t") / 2).cast("int")
    return F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(F.col("next_t"), F.lit(1), half))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def _members(scratch: Scratch, own: DataFrame, light: DataFrame, bits: int) -> DataFrame:
    """(doc_id, edited, d, canon) of all rows whose digest another text has too."""
    shared = light.select(F.explode(F.array("d", "e")).alias("d")).groupBy("d").count().where("count > 1").select("d")
    shared = _few(scratch.keep(shared, "shared"))
    plain = own.withColumn("canon", canonical(F.col("t"))).withColumn("d", digest(F.col("canon"), bits)).join(shared, "d", "left_semi")
    pairs = light.join(shared.withColumnRenamed("d", "e"), "e", "left_semi").select("doc_id", "next_id", "e").distinct()
    pairs = _few(scratch.keep(pairs, "pairs"))
    one = own.join(pairs, "doc_id").select("doc_id", "next_id", "e", "t")
    ahead = own.select(F.col("doc_id").alias("next_id"), F.col("t").alias("next_t")).join(pairs.select("next_id", F.col("doc_id").alias("of")).distinct(), "next_id")
    two = one.join(ahead, (F.col("doc_id") == F.col("of")) & (one["next_id"] == ahead["next_id"])).select("doc_id", "e", canonical(_edited()).alias("canon"))
    two = two.withColumn("d", digest(F.col("canon"), bits)).where("d = e")
    return plain.select("doc_id", F.lit(False).alias("edited"), "d", "canon").unionByName(two.select("doc_id", F.lit(True).alias("edited"), "d", "canon"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Fingerprints of each text and its edited text, and whether they are those of the next."""
    scratch = Scratch(docs.sparkSession)
    own = _own(docs, id_col, text_col)
    a = with_next(own).select("doc_id", "next_id", F.length("t").cast("long").alias("n_chars"), canonical(F.col("t")).alias("canon"), canonical(F.col("next_t")).alias("next_canon"), _edited().alias("edited"))
    a = a.select("doc_id", "next_id", "n_chars", digest(F.col("canon"), bits).alias("d"), digest(F.col("next_canon"), bits).alias("x"), digest(canonical(F.col("edited")), bits).alias("e"), F.sha2("edited", 256).alias("edited_sha256"))
    light = scratch.keep(a, "light")
    members = _members(scratch, own, light, bits)
    unequal = members.groupBy("d").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("d")
    unequal = scratch.keep(unequal, "unequal")
    zero = F.lit(0)
    if unequal.isEmpty():
        out = light.withColumns({"dn": zero, "en": zero, "xn": zero})
    else:
        texts = members.join(unequal, "d", "left_semi").select("doc_id", "edited", "d", "canon").distinct()
        ranks = texts.select("d", "canon").distinct().withColumn("rank", F.dense_rank().over(W.partitionBy("d").orderBy("canon")) - 1)
        ranks = scratch.keep(texts.join(ranks, ["d", "canon"]).select("doc_id", "edited", "d", "rank"), "ranks")
        out = light
        for key, d, name, edited in (("doc_id", "d", "dn", False), ("doc_id", "e", "en", True), ("next_id", "x", "xn", False)):
            r = ranks.where(F.col("edited") == edited).select(F.col("doc_id").alias("__id"), F.col("d").alias("__d"), F.col("rank").alias(name))
            out = out.join(r, (out[key] == r["__id"]) & (out[d] == r["__d"]), "left").drop("__id", "__d").fillna(0, [name])
    full = lambda d, n: F.concat(_hex(d), F.when(F.col(n) > 0, F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise(F.lit("")))
    out = out.withColumns({"fingerprint": full("d", "dn"), "edited_fingerprint": full("e", "en"), "next_fingerprint": full("x", "xn")})
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` and its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
