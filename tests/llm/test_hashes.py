"""Texts that a polynomial modulo a power of two can't tell apart."""

from lumenfold.llm.decontamination import decontamination
from lumenfold.llm.near_duplicates import near_duplicates
from lumenfold.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
#: Two words of 2,048 letters in the order of Thue and Morse, a and b swapped.
ONE = "".join("ab"[i.bit_count() % 2] for i in range(2048))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def test_substring_dedup(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    got = substring_dedup(docs(spark, f"{ONE} {rest}", f"{TWO} {rest}", f"{ONE} {rest} end")).collect()
    assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 20]


def test_near_duplicates(spark):
    got = near_duplicates(docs(spark, f"{ONE} a b c d", f"{TWO} a b c d", f"{ONE} a b c d")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == [0, 1, 0]


def test_decontamination(spark):
    rest = " ".join(f"w{i}" for i in range(9))
    items = spark.createDataFrame([(7, f"{ONE} {rest}")], "item_id long, text string")
    got = decontamination(docs(spark, f"x {TWO} {rest} y", f"x {ONE} {rest} y"), items).collect()
    assert [r.n_hit for r in sorted(got, key=lambda r: r.doc_id)] == [0, 10]
