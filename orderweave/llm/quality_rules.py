"""Quality rules: a threshold table compiled into one projection, evaluated by built-in functions alone.

Each rule is a row of ``RULES``: a measure, a bound on either side, the least number of words from which the rule
speaks, and the words that the measure counts, if it counts any. ``quality_rules`` turns the table into columns of
a single ``select``; there is no shuffle, so the work is spread as the scan is and no key can be hot.

Repeated windows are found through numbers. A text whose windows' 32-bit hashes are all distinct has none. Of the
others the hashes, each above its position, are sorted as longs; only windows whose hash comes twice are looked at
again, and their words are compared; where two of equal hash differ, which is rare, the text's windows are sorted by
content instead. So the count is exact.

Defined results: a null text counts as empty (no word, fails the base rule); repeated rows are judged each by
itself; an empty table gives an empty result; columns of the input other than id and text are ignored, so names
cannot clash; a text of any length is judged whole.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm.common import SPACE_CLASS, table

# Frequent function words of the four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this", "from", "or",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como",
]


class Rule(NamedTuple):
    """A bound of None is open; ``counted`` are the words whose share a measure of words is."""

    measure: str
    least: float | None
    most: float | None
    from_words: int
    counted: tuple[str, ...] = ()


RULES = [
    Rule("mean_word_chars", 2.0, 14.0, 50),
    Rule("symbols_per_word", None, 0.2, 50),
    Rule("stop_share", 0.02, None, 50, tuple(STOP_WORDS)),
    Rule("dup_line_share", None, 0.5, 50),
    Rule("bang_share", None, 0.5, 50),
]
_SPACES = " \t\n\v\f\r"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _window(i: Column) -> list[Column]:
    return [F.get("w", i + k) for k in range(3)]


def _same_hash(x: Column, y: Column) -> Column:
    return F.coalesce(F.shiftright(x.bitwiseXOR(y), 32) == 0, F.lit(False))


def _hashes() -> Column:
    """A hash for each window; the last two words begin none."""
    every = F.transform("w", lambda x, i: F.hash(x, F.get("w", i + 1), F.get("w", i + 2)))
    return F.when(F.col("n") >= 3, F.slice(every, F.lit(1), F.col("n") - 2))


def _sorted_hashes() -> Column:
    """A long for each window, sorted: its hash above its position."""
    return F.sort_array(F.transform("h", lambda x, i: F.shiftleft(x.cast("long"), 32).bitwiseOR(i.cast("long"))))


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _among(word: Column, counted: list[str]) -> Column:
    """Whether a word is one of the list, case aside; of plain ASCII words all spellings are listed, which spares folding the word."""
    folds = all(w.isascii() and w == w.lower() and "k" not in w for w in counted)  # K has a spelling outside ASCII
    if not folds or sum(1 << len(w) for w in counted) > 4096:
        return F.lower(word).isin(counted)
    return word.isin(sorted({"".join(c) for w in counted for c in product(*zip(w, w.upper(), strict=True))}))


def _collide(x: Column, y: Column) -> Column:
    """Whether two windows of equal hash differ in a word."""
    one, two, three = (p != q for p, q in zip(_window(_position(x)), _window(_position(y)), strict=True))
    return _same_hash(x, y) & (one | two | three)


def _by_content() -> Column:
    """Positions of the windows that come twice, by sorting their words."""
    s = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.array(*_window(i)).alias("g"), i.alias("i"))))
    both = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["g"] == y["g"], F.array(x["i"], y["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, min_words: int = 50) -> DataFrame:
    """Measures of each text and the verdict; one row for each row of ``docs``."""
    counted = sorted({w for r in rules for w in r.counted}) or [""]
    text = F.coalesce(docs[text_col], F.lit(""))
    a = docs.select(docs[id_col].alias("doc_id"), text.alias("t"))
    inner = F.btrim("t", F.lit(_SPACES))
    split = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))
    # Each step reads columns of the one before more than once, so that no lambda computes them anew.
    b = a.select("doc_id", "t", split.alias("w"), F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "").alias("lines"))
    c = b.select(
        "doc_id", "w", F.size("w").alias("n"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: _among(x, counted))).cast("long").alias("n_stop"),
        F.when(F.col("t").contains("!!"), F.size(F.filter("w", lambda x: x.endswith("!!")))).otherwise(F.lit(0)).cast("long").alias("n_bang"),
    )
    rest = [k for k in c.columns if k not in ("w", "n")]
    c = c.select(*rest, "w", "n", _hashes().alias("h"))
    d = c.select(*rest, "w", "n", F.when(F.size(F.array_distinct("h")) < F.size("h"), _sorted_hashes()).alias("s"))
    twice = F.filter("s", lambda x, k: _same_hash(x, F.get("s", k - 1)) | _same_hash(x, F.get("s", k + 1)))
    e = d.select(*rest, "w", "n", twice.alias("twice"))
    collide = F.exists(F.zip_with("twice", F.slice("twice", 2, F.greatest(F.size("twice"), F.lit(1))), _collide), lambda z: z)
    at = F.when(collide, _by_content()).otherwise(F.sort_array(F.transform("twice", _position)))
    f = e.select(*rest, F.when(F.size("twice") > 0, at).alias("at"))
    low = F.lit(0xFFFFFFFF)
    # The words covered so far, above the last position and three.
    swept = F.aggregate(
        "at", F.lit(0).cast("long"),
        lambda acc, i: F.shiftleft(F.shiftright(acc, 32) + F.least(F.lit(3).cast("long"), i + 3 - acc.bitwiseAND(low)), 32).bitwiseOR(i.cast("long") + 3),
        lambda acc: F.shiftright(acc, 32),
    )
    g = f.select(*rest, F.coalesce(swept, F.lit(0).cast("long")).alias("n_repeat_words"))
    n = F.col("n_words")
    measures = {
        "mean_word_chars": _ratio(F.col("word_chars"), n), "symbols_per_word": _ratio(F.col("n_symbols"), n), "stop_share": _ratio(F.col("n_stop"), n),
        "dup_line_share": _ratio(F.col("n_dup_lines"), F.col("n_lines")), "bang_share": _ratio(F.col("n_bang"), n),
    }
    base_failed = (n < min_words) | (100 * F.col("n_repeat_words") > 50 * n)
    passed = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (measures[r.measure] >= r.least)
        if r.most is not None:
            ok = ok & (measures[r.measure] <= r.most)
        passed = passed & ((n < r.from_words) | ok)
    return g.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        F.when(base_failed, F.lit(False)).otherwise(passed).alias("kept"), "n_lines", "n_stop", "n_bang",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of ``documents``."""
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql_list(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _rules_sql(rules: list[Rule]) -> str:
    out = []
    for name, least, most, start, _ in rules:
        bounds = ([f"{name} >= {least}"] if least is not None else []) + ([f"{name} <= {most}"] if most is not None else [])
        out.append(f"(n_words < {start} OR ({' AND '.join(bounds)}))")
    return " AND ".join(out)


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_sql_list(STOP_WORDS)})))::BIGINT AS n_stop, len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_bang
  FROM w LEFT JOIN r USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_bang / n_words ELSE 0 END AS bang_share, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {_rules_sql(RULES)} END AS kept, n_lines, n_stop, n_bang FROM q
"""
