"""Golden values of the text functions."""

import pytest
from pyspark.sql import functions as F

from orderweave.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


CASES = [
    (T.canonical_dimensions, "565х255", "565x255"), (T.canonical_dimensions, "565 x 255", "565x255"), (T.canonical_dimensions, "565X255", "565x255"),
    (T.canonical_dimensions, "565×255", "565x255"), (T.canonical_dimensions, "565*255", "565x255"), (T.canonical_dimensions, "116 х 596 х 16", "116x596x16"),
    (T.dimension_tokens, "116х596х16", ["116x596", "596x16", "116x596x16"]), (T.dimension_pairs, "116х596х16 5*7", ["116x596", "5x7"]),
    (T.vote_scripts, "Крoвать", "Кровать"), (T.vote_scripts, "Раvенна", "Равенна"), (T.vote_scripts, "shаdow", "shadow"), (T.vote_scripts, "аa", "аa"), (T.vote_scripts, "shadow SF", "shadow SF"),
    (T.module_codes, "H20", "Н20"), (T.module_codes, "h-60", "Н60"), (T.module_codes, "B-60", "В60"), (T.module_codes, "в-30", "В30"),
    (T.heal_mojibake, "Àâðîðà", "Аврора"), (T.heal_mojibake, "café", "cafй"), (T.heal_mojibake, "Аврора é", "Аврора é"), (T.heal_mojibake, "plain", "plain"), (T.heal_mojibake, "é漢", "é漢"),
    (T.incoming_text, "№ 5 ﬁ", "№ 5 fi"), (T.normalize, None, ""), (T.normalize, "  Фасад 116 х 596  ", "Фасад 116x596"),
    (T.package_ratio, "Йорк Комод 1/1 Белый", "1/1"), (T.package_ratio, "Нео (корпус и фасады) 2/2 белый", "2/2"), (T.package_ratio, "Система Йорк Стекло Ун1/1", "Ун1/1"),
    (T.package_ratio, "Стекло 4мм Ун 1/1 Йорк", "Ун1/1"), (T.package_ratio, "Чикаго Нео 160/140/120 1/1", "1/1"), (T.package_ratio, "Чикаго 160/140/120", None),
    (T.alternative_widths, "Чикаго Нео 160/140/120 1/1", [1600, 1400, 1200]), (T.alternative_widths, "Полка 30/40/50/60/80 (8 шт)", [300, 400, 500, 600, 800]), (T.alternative_widths, "1/1", []),
    (T.dimensions, "Столешница 40мм 2,00 м 3025/Q 116x596x16", ["2,00м", "116x596x16"]), (T.thicknesses, "Столешница 40 мм 4мм 40мм", ["40мм", "4мм"]), (T.linear_metres, "2,05 м и 3м", [2.05, 3.0]),
    (T.sub_brands, "Чикаго Вайт / Роял ВАЙТ", ["вайт", "роял"]), (T.composite_color, "Ателье светлый/Белый", True), (T.composite_color, "Белый", False),
    (T.article_tokens, "Планка 1516 угловая 38мм 1/1", ["1516"]), (T.article_tokens, "Светильник 04.002.20.312", ["04.002.20.312"]), (T.article_tokens, "Фасад 1116х5596 Плано", []), (T.article_tokens, None, []),
    (T.hardware_types, "Планка и угол", ["планка"]), (T.hardware_types, "Угол цоколя", ["угол"]), (T.is_hardware, "Корпус с планкой (корпус)", False), (T.is_hardware, "Полкодержатели", True), (T.is_hardware, "Комод", False),
    (T.expand_abbreviations, "Д. Сон шкаф 3 ящ FE", "дуб сонома шкаф 3ящик (FE) фасад эмаль"), (T.expand_collections, "IMP к стол", "IMP кухня стол"),
    (T.wrap_ratios, "Комод 1/1 белый", "Комод упаковка 1/1 белый"), (T.wrap_ratios, "Комод упаковка 1/1", "Комод упаковка 1/1"), (T.wrap_ratios, "Стекло Ун 1/1", "Стекло упаковка Ун1/1"),
    (T.slug, "Комод  упаковка 1/1 565 х 255 2/2", "комод 565x255"), (T.core_slug, "Комод без цвета 1/1", "комод"), (T.sanitize_topology, "Р1.16.Я2 Комод секция 12", "Комод"),
    (T.restore_barcode, "2,006E+12", "2006000000000"), (T.restore_barcode, "2.006E+12", "2006000000000"), (T.restore_barcode, "     ", None), (T.restore_barcode, " 2006000045445 ", "2006000045445"),
    (lambda c: T.pad_code(c, 11), "64794", "00000064794"), (lambda c: T.pad_code(c, 3), "64794", "64794"), (T.ean13_valid, "4006381333931", True), (T.ean13_valid, "4006381333932", True), (T.ean13_valid, "400638133393", False), (T.ean13_valid, None, False),
    (T.positive_int, "12", 12), (T.positive_int, "12.0", 12), (T.positive_int, "0", None), (T.positive_int, "1a", None), (T.quantity, "2,7", 2), (T.quantity, "x", 1), (T.optional_number, "1,5", 1.5), (T.optional_number, "-", None),
    (T.packaging_key, "упаковка ун 1/1", "Ун1/1"), (T.multi_place, "1/2", True), (T.multi_place, "1/1", False), (T.safe_stem, 'a/b: "c"', "a_b___c_"), (T.safe_stem, "", "order"),
    (T.candidate_widths, "шкаф 600 3/4 1200x80", [600]),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_golden(spark, f, value, want):
    assert one(spark, f, value) == [want]


def test_packaging(spark):
    df = spark.createDataFrame([("1/1", "Ун1/1"), ("1/2", "1/2"), ("1/2", "2/2"), ("1/1", None), (None, "1/1")], "a string, b string")
    assert [r[0] for r in df.select(T.packaging_equal(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]
