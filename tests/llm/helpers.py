"""Small tables and plain versions of the operators to hold them against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside.
CLASHING = ["size", "h", "row", "t", "key", "fp", "u", "v", "n", "w", "d", "range", "copies", "target", "held_out", "score", "spans"]
ENGLISH = "the of and that with from this which thing other there would their about".split()
FRENCH = "le les des une dans pour avec être été où çà après très même".split()


def prose(rnd: random.Random, words: list[str], n: int) -> str:
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Two languages, nulls, empty and blank texts, a very long text, equal and nearly equal texts."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = "en" if i % 2 else "fr"
        text = prose(rnd, ENGLISH if i % 2 else FRENCH, rnd.randint(60, 300))
        if i % 9 == 0:
            text += f' token = "{rnd.getrandbits(96):024x}" key AKIA{"ABCDEFGHIJKLMNOPQRST"} '
        out.append((i, text, lang, f"s{i % 3}" if i % 10 else None, len(text)))
    out.append((n, None, None, "s1", None))
    out.append((n + 1, "", "en", None, 0))
    out.append((n + 2, " \n\t ", None, "s2", 4))
    out.append((n + 3, "!!! ### 123", None, "s2", 11))
    out.append((n + 4, prose(rnd, ENGLISH, 40_000), "en", "s0", None))
    out.append((n + 5, out[1][1], "en", "s0", None))
    out.append((n + 6, out[1][1] + " end", "en", "s1", None))
    return out


def documents(spark, data=None, clash: bool = False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    return df


def digests(result, *drop):
    """Rows as a sorted list, floats rounded."""
    cols = [c for c in result.columns if c not in drop]
    fix = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(repr([fix(r[c]) for c in cols]) for r in result.collect())
