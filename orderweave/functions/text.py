"""Text normalisation and feature extraction as Column functions; all of them stay in the JVM.

Patterns carry ``(?iuU)`` where they are to ignore case or meet Cyrillic word characters. Null in, null out,
unless said otherwise; lists of nothing are empty.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look alike, in pairs.
LATIN = "aceopvxyABCEHKMOPTX"
CYRILLIC = "асеорвхуАВСЕНКМОРТХ"
# Order shorthand and what it stands for, applied from first to last.
ABBREVIATIONS = [
    (r"\bд\.?\s*сон(ома)?\b", "дуб сонома"),
    (r"\bб\.?\s*дер(ево)?\b", "белое дерево"),
    (r"\bяс\.?\s*шим(о)?\b", "ясень шимо"),
    (r"\bателье\s*св(ет)?\b", "ателье светлый"),
    (r"\bкат(\d+)\b", "категория $1"),
    (r"\(\s*FE\s*\)|(?<![A-Za-z(])FE(?![A-Za-z)])", "(FE) фасад эмаль"),
    (r"\bстарт\b", ""),
    (r"(\d+)\s*ящ\b", "$1ящик"),
    (r"(?<![а-яёa-z0-9])ящ\b", "ящик"),
    (r"(\d+)\s*ств\b", "$1створка"),
    (r"(?<![а-яёa-z0-9])ств\b", "створка"),
]
# Collections and their short names.
COLLECTIONS = {"сп": "спальня", "к": "кухня", "прих": "прихожая", "г": "гостиная"}
# Names of product lines.
SUB_BRANDS = [
    "вайт", "white", "роял", "royal", "тренд", "trend", "классик", "classic", "люкс", "lux", "luxe", "модерн", "modern",
    "эко", "eco", "лайт", "light", "плюс", "plus", "престиж", "prestige", "комфорт", "comfort", "мини", "mini",
    "макси", "maxi", "элит", "elite", "софт", "soft", "гранд", "grand", "про", "pro", "нью", "new",
]
# Words that tell nothing apart, in general and as product words.
STOP_WORDS = ["система", "упаковка", "корпус", "и", "the"]
GENERIC_TOKENS = [
    "система", "упаковка", "корпус", "фасад", "фасады", "фурнитура", "и", "к", "д", "шт", "навесная", "навесной", "стекло",
    "полировка", "комплект", "набор", "пр", "imp", "кат1", "кат", "для", "the", "оптовые", "продажи",
]
# Hardware words, what hints at hardware, lists of widths, ratios; below so many, a width is in centimetres.
HARDWARE = r"корнер|планка|плинтус|профиль|заглушка|светильник|\bопора\b|\bпетл(?:я|и|ю)\b|\bручк(?:а|и|у)\b|стяжк[а-яё]*|\bнавес\b|\bугол\b|доводчик|направляющ|полкодерж"
HARDWARE_HINT = r"планка|корнер|заглушка|плинтус|профиль|\bопора\b|угол.{0,24}цокол|цокол.{0,24}угол|петл|\bручка\b|стяжк|\bнавес\b|светильник|доводчик|направляющ|ящик с доводчиком|полкодерж"
WIDTH_LIST = r"(?<![\d/])(\d{2,4}(?:/\d{2,4}){2,})(?![\d/])"
RATIO = r"(\b\d+/\d+\b|Ун\s*\d+/\d+)"
CM_LIMIT = 400
MAJORITY = 0.6

_HIGH = "".join(chr(c) for c in range(0x80, 0x100))
_AS_1251 = _HIGH.encode("latin-1").decode("cp1251", errors="replace")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def squeeze(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze_ascii(text: Column) -> Column:
    """The same of a text of ASCII characters."""
    wide = lambda t: functools.reduce(operator.or_, (t.contains(c) for c in ("  ", *"\t\n\x0b\f\r")))
    return F.trim(let(text, lambda t: F.when(wide(t), F.regexp_replace(t, r"\s+", " ")).otherwise(t)))


def folded(text: Column) -> Column:
    """A text of ASCII characters in lower case with single spaces, which no feature of it tells from the text; others stay."""
    return let(text, lambda t: F.when(ascii_only(t), F.lower(squeeze_ascii(t))).otherwise(t))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a whole pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def nfkc(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))


def heal_mojibake(text: Column) -> Column:
    """Cyrillic bytes that were read as Latin-1 are read again; only if that gives Cyrillic, and all is Latin-1."""
    keep = "".join(c for c, d in zip(_HIGH, _AS_1251, strict=True) if d != "�")
    healed = F.translate(text, keep + "".join(set(_HIGH) - set(keep)), _AS_1251.replace("�", ""))
    broken = ~text.rlike("[А-Яа-яЁё]") & text.rlike(r"[À-ÿ]") & ~text.rlike(r"[^\u0000-ÿ]")
    return F.when(broken & healed.rlike("[А-Яа-яЁё]"), healed).otherwise(text)


def canonical_dimensions(text: Column) -> Column:
    """``116 х 596*16`` to ``116x596x16``."""
    return F.regexp_replace(text, r"(\d+)\s*[xXхХ*×]\s*(?=\d)", "$1x")


_CHAIN = r"\d\s*[xXхХ*×]\s*\d"


def dimension_tokens(text: Column) -> Column:
    """Every run of two and more neighbours of each dimension chain, distinct, short runs first."""

    def windows(chain: Column) -> Column:
        parts = F.split(chain, "x")
        return F.flatten(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda w: F.transform(F.sequence(F.lit(1), F.size(parts) - w + 1), lambda i: F.array_join(F.slice(parts, i, w), "x"))))

    def several(chain: Column) -> Column:
        return F.when(chain.rlike("x.*x"), windows(chain)).otherwise(F.array(chain))

    return let(text, lambda t: F.when(~t.rlike(_CHAIN), F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(matches(canonical_dimensions(t), r"\d+(?:x\d+)+"), several)))))


def dimension_pairs(text: Column) -> Column:
    """Distinct ``WxH`` pairs that don't overlap, as text."""
    number = lambda p, i: F.split_part(p, F.lit("x"), F.lit(i)).cast("bigint").cast("string")
    return let(text, lambda t: F.when(~t.rlike(_CHAIN), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(matches(canonical_dimensions(t), r"\d+x\d+"), lambda p: F.concat(number(p, 1), F.lit("x"), number(p, 2))))))


def vote_script(token: Column) -> Column:
    """A token of mixed scripts in the one that six tenths of its letters have."""
    cyr, lat = (F.length(F.regexp_replace(token, rf"[^\p{{{s}}}]", "")) for s in ("IsCyrillic", "IsLatin"))
    return (
        F.when((cyr > 0) & (cyr >= MAJORITY * (cyr + lat)), F.translate(token, LATIN, CYRILLIC))
        .when((lat > 0) & (lat >= MAJORITY * (cyr + lat)), F.translate(token, CYRILLIC, LATIN))
        .otherwise(token)
    )


def vote_scripts(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), vote_script), " ")


def module_codes(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)\b[HНhн]\s*[-_]?\s*(\d+)", "Н$1")
    return F.regexp_replace(text, r"(?U)\b[BВbв]\s*[-_]?\s*(\d+)", "В$1")


def strip_special(text: Column) -> Column:
    return squeeze(F.translate(nfkc(text), "​‌‍﻿", ""))


def normalize(text: Column) -> Column:
    """The base chain: mojibake, dimensions, Unicode and white space, scripts, module codes. Null is empty."""

    def plain(t: Column) -> Column:  # nothing to heal, to fold or to vote on
        coded = let(squeeze_ascii(canonical_dimensions(t)), lambda s: F.when(s.rlike(r"(?<![A-Za-z0-9_])[HhBb]\s*[-_]?\s*\d"), squeeze(module_codes(s))).otherwise(s))
        return coded

    return let(F.coalesce(text, F.lit("")), lambda t: F.when(ascii_only(t), plain(t)).otherwise(squeeze(module_codes(vote_scripts(strip_special(canonical_dimensions(heal_mojibake(t))))))))


def incoming_text(text: Column) -> Column:
    """Cell text: Unicode folded but for the numero sign."""
    return squeeze(F.regexp_replace(nfkc(F.regexp_replace(heal_mojibake(F.coalesce(text, F.lit(""))), "№", "")), "", "№"))


def expand_abbreviations(text: Column) -> Column:
    def every(t: Column) -> Column:
        for pattern, full in ABBREVIATIONS:
            t = F.regexp_replace(t, f"(?iuU){pattern}", full)
        return squeeze(t)

    # All but one of the shorthands are Cyrillic.
    latin = lambda t: F.lower(t).contains("fe") & t.rlike(r"(?i)(?<![A-Za-z(])FE(?![A-Za-z)])|\(\s*FE\s*\)")
    return let(text, lambda t: F.when(ascii_only(t) & ~latin(t), squeeze_ascii(t)).otherwise(every(t)))


def expand_collections(text: Column) -> Column:
    def every(t: Column) -> Column:
        for key, full in COLLECTIONS.items():
            t = F.regexp_replace(t, rf"(?iuU)\bIMP\s+{key}\b", f"IMP {full}")
        return t

    return let(text, lambda t: F.when(ascii_only(t), t).otherwise(every(t)))


def wrap_ratios(text: Column) -> Column:
    """A bare ratio becomes a packaging phrase; one that is in such a phrase stays."""
    bare = r"(?iuU)(?<!упаковка )(?<!упаковка ун )(?<!упаковка ун)(?<![А-Яа-яA-Za-z0-9])((?:Ун\s*)?\d+/\d+)(?![А-Яа-яA-Za-z0-9/])"

    plain = r"(?<![A-Za-z0-9])(\d+/\d+)(?![A-Za-z0-9/])"

    def every(t: Column) -> Column:
        wrapped = F.regexp_replace(squeeze(t), bare, "упаковка $1")
        return squeeze(F.regexp_replace(F.regexp_replace(wrapped, r"(?iuU)ун\s*", "Ун"), "", ""))

    return let(text, lambda t: F.when(ascii_only(t), F.regexp_replace(squeeze_ascii(t), plain, "упаковка $1")).otherwise(every(t)))


def search_text(text: Column) -> Column:
    """The form in which order and catalog texts are compared."""
    return search_form(expand_abbreviations(normalize(text)))


def search_form(plain: Column) -> Column:
    """The same of a text that is normalised and has its abbreviations expanded."""
    return wrap_ratios(expand_collections(plain))


def sanitize_topology(text: Column) -> Column:
    """Without rack and section tokens."""
    text = F.regexp_replace(F.trim(text), r"(?iuU)Р\d+[.\w]+", " ")
    return squeeze(F.regexp_replace(text, r"(?iuU)секция\s+\d+", " "))


def slug(text: Column) -> Column:
    """What is left of a product name in lower case without packaging and ratios."""

    def without(t: Column, *patterns: str) -> Column:
        for pattern in patterns:
            t = F.regexp_replace(t, f"(?iuU){pattern}", "")
        return t

    packed = let(F.lower(canonical_dimensions(text)), lambda t: F.when(t.contains("упаковка"), without(t, r"упаковка\s+\S+")).otherwise(t))
    bare = let(packed, lambda t: F.when(t.contains("/"), without(t, r"\d+/\d+/\d+", r"\d+/\d+", r"ун\s*\d+/\d+")).otherwise(t))
    return let(bare, lambda t: F.when(ascii_only(t), squeeze_ascii(t)).otherwise(squeeze(t)))


def core_slug(text: Column) -> Column:
    return slug(search_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iuU)\bбез\s+цвета\b", " ")))


def name_key(text: Column) -> Column:
    return name_form(normalize(text))


def name_form(normal: Column) -> Column:
    return let(F.lower(normal), lambda t: F.when(ascii_only(t), squeeze_ascii(t)).otherwise(squeeze(t)))


def significant_tokens(text: Column) -> Column:
    return F.filter(matches(F.lower(text), "[а-яa-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def identity_tokens(text: Column) -> Column:
    return F.filter(significant_tokens(slug(search_text(text))), lambda t: (F.length(t) >= 4) & ~t.isin(GENERIC_TOKENS))


def clean_alias(alias: Column) -> Column:
    """A factory's name of a product without what it is compatible with and its import prefix."""
    # The patterns that go.
    for pattern in (r"(?s)совместимость\s*:.*", r"д/шкаф[а-яё]*\s+[^;,.]*", r"^IMP\s+ст\s+"):
        alias = F.regexp_replace(alias, f"(?iuU){pattern}", "")
    return squeeze(F.replace(alias, F.lit("="), F.lit(" ")))


def package_ratio(text: Column) -> Column:
    """The first ratio outside width lists, or null."""
    def first(t: Column) -> Column:
        found = F.regexp_extract(F.regexp_replace(t, WIDTH_LIST, " "), f"(?iuU){RATIO}", 1)
        return F.nullif(F.regexp_replace(F.trim(found), r"(?iuU)^ун\s*", "Ун"), F.lit(""))

    def plain(t: Column) -> Column:  # no places but bare ones
        return F.nullif(F.regexp_extract(F.regexp_replace(t, WIDTH_LIST, " "), r"\b\d+/\d+\b", 0), F.lit(""))

    return let(text, lambda t: F.when(t.contains("/"), F.when(ascii_only(t), plain(t)).otherwise(first(t))))


def default_ratio(ratio: Column, item_type: Column) -> Column:
    return F.coalesce(ratio, F.when(F.lower(F.trim(item_type)) == "стекло", F.lit("Ун1/1")).otherwise(F.lit("1/1")))


def alternative_widths(text: Column) -> Column:
    """Widths of slash lists in millimetres, distinct, in order."""
    values = F.flatten(F.transform(matches(text, WIDTH_LIST), lambda m: F.transform(F.split(m, "/"), lambda v: v.cast("int"))))
    return F.array_distinct(F.transform(values, lambda v: F.when(v < CM_LIMIT, v * 10).otherwise(v)))


def dimensions(text: Column) -> Column:
    """Width lists, then metres and dimension chains, without blanks, distinct, in order."""
    chains = F.transform(matches(text, r"(?iuU)\d+[,.]?\d*\s*м\b|\d+(?:x\d+)+"), lambda m: F.regexp_replace(m, r"(?U)\s+", ""))
    return F.array_distinct(F.concat(matches(text, WIDTH_LIST), chains))


def thicknesses(text: Column) -> Column:
    return F.array_distinct(F.transform(matches(text, r"(?iuU)\d+\s*мм\b"), lambda m: F.regexp_replace(m, r"(?U)\s+", "")))


def linear_metres(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?iuU)(\d+[,.]?\d*)\s*м\b"), F.lit(1))
    return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))


def candidate_widths(text: Column) -> Column:
    """Distinct numbers of three or four digits that stand alone, outside ratios."""
    stripped = F.regexp_replace(text, r"(?U)\b\d+/\d+\b", " ")
    return F.array_distinct(F.transform(matches(stripped, r"(?U)\b\d{3,4}\b"), lambda v: v.cast("int")))


def sub_brands(text: Column) -> Column:
    return brand_words(normalize(text))


def brand_words(normal: Column) -> Column:
    """Sub-brand words of a normalised text, distinct, sorted."""
    words = "|".join(sorted(SUB_BRANDS, reverse=True))
    return F.array_sort(F.array_distinct(F.transform(matches(normal, rf"(?iuU)\b(?:{words})\b"), F.lower)))


def composite_color(text: Column) -> Column:
    return text.rlike(r"(?iuU)[а-яё]{3,}(?:\s+[а-яё]{3,}){0,2}\s*[/\-]\s*[а-яё]{3,}(?:\s+[а-яё]{3,}){0,2}")


def article_tokens(text: Column) -> Column:
    """Dotted numbers, then runs of four digits and more outside dimensions; distinct."""
    dotted = r"(?U)\b\d+(?:\.\d+){2,}\b"

    def found(t: Column) -> Column:
        masked = F.regexp_replace(F.regexp_replace(t, r"\d+(?:\s*[хxX×]\s*\d+)+", " "), dotted, " ")
        return F.array_distinct(F.concat(matches(t, dotted), matches(masked, r"\d{4,}")))

    none = F.array().cast("array<string>")
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.contains(".") | t.rlike(r"\d{4}"), let(canonical_dimensions(t), found)).otherwise(none))


def hardware_types(text: Column) -> Column:
    """Hardware words; the one that is also a plain word counts only in its context."""

    def found(low: Column) -> Column:
        context = low.contains("цокол") | low.rlike(r"\d+\s*гр")
        return F.array_distinct(F.filter(matches(low, f"(?iuU){HARDWARE}"), lambda t: (t != "угол") | context))

    none = F.array().cast("array<string>")  # the words are Cyrillic
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(ascii_only(low), none).otherwise(found(low)))


def is_hardware(text: Column) -> Column:
    corpus = text.rlike(r"(?iuU)\(\s*корпус\s*\)|\bкорпус\b") & ~text.rlike(r"(?iuU)ящик\s+с\s+доводчиком|комплект\s+ящиков|направляющ")
    plain = F.regexp_replace(expand_abbreviations(text), r"(?iuU)\([^()]{0,80}ручк[^)]*\)", " ")
    return ~corpus & (text.rlike("(?iu)полкодерж") | plain.rlike(f"(?iuU){HARDWARE_HINT}") | (F.size(hardware_types(plain)) > 0))


def multi_place(ratio: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(ratio, r"(\d+)\s*/\s*(\d+)", 2), F.lit("")).cast("int") > 1, F.lit(False))


def packaging_key(value: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(value), r"(?iuU)^упаковка\s+", "")
    spelled = F.when(cleaned.rlike(r"(?iuU)^ун.*/"), F.regexp_replace(F.regexp_replace(cleaned, r"(?U)\s+", ""), "(?iu)^ун", "Ун")).otherwise(cleaned)
    return F.when(ascii_only(value), F.trim(value)).otherwise(spelled)


def packaging_equal(a: Column, b: Column) -> Column:
    """Ratios that are equal, or both say one place."""
    a, b = packaging_key(a), packaging_key(b)
    one = lambda x: x.isin("1/1", "Ун1/1")
    return F.coalesce((a == b) | (one(a) & one(b)), F.lit(False))


def pad_code(value: Column, width: int) -> Column:
    """Digits filled with zeros to a width; never cut."""
    value = F.trim(value)
    return F.when(value.rlike(r"^\d+$") & (F.length(value) < width), F.lpad(value, width, "0")).otherwise(value)


def restore_barcode(value: Column) -> Column:
    """A number in scientific notation written out, anything else trimmed; blank is null."""
    text = F.nullif(F.trim(value), F.lit(""))
    compact = F.replace(text, F.lit(" "), F.lit(""))
    number = F.replace(compact, F.lit(","), F.lit(".")).try_cast("double").try_cast("decimal(38,0)").cast("string")
    return F.when(compact.rlike(r"^[+-]?\d[\d,]*(?:[.,]\d+)?[eE][+-]?\d+$"), F.coalesce(number, text)).otherwise(text)


def ean13_valid(value: Column) -> Column:
    """Thirteen digits; the check digit isn't looked at."""
    return F.coalesce(F.trim(value).rlike(r"^\d{13}$"), F.lit(False))


def optional_text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def optional_number(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def quantity(*values: Column) -> Column:
    """The first value that is a number of one or more, decimals cut; else 1."""
    numbers = [optional_number(v).try_cast("int") for v in values]
    return F.coalesce(*(F.when(n >= 1, n) for n in numbers), F.lit(1))


def positive_int(value: Column) -> Column:
    n = F.when(F.trim(value).rlike(r"^\d+(?:\.0+)?$"), F.trim(value).try_cast("double").try_cast("int"))
    return F.when(n >= 1, n)


def safe_stem(name: Column, most: int = 80) -> Column:
    """A file name stem without characters that file systems refuse."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*\x00-\x1F]', "_"), r"\s+", "_")
    return F.coalesce(F.nullif(F.substring(stem, 1, most), F.lit("")), F.lit("order"))


def order_id(filename: Column, timestamp: Column, length: Column) -> Column:
    """A run's id: the first 16 digits of the digest of file name, time and size."""
    return F.left(F.sha2(F.concat_ws("|", filename, timestamp, length.cast("string")), 256), F.lit(16))


def document_label(kind: Column) -> Column:
    """What a class of documents is called in reports; a label is its own."""
    # The labels.
    soft = (kind == "SOFT_FURNITURE_TRANSFER") | F.lower(kind).contains("мягк")
    return F.when(soft, "Мягкая мебель (Перемещение)").otherwise("Корпусная мебель (1С 7.7)")
