import pytest
from pyspark.sql import functions as F

from deskloom.functions import text as t
from tests.conftest import one


@pytest.mark.parametrize(
    "given, expected",
    [
        ("ｉｇｎｏｒｅ", "ignore"),
        ("x² ①", "x2 1"),
        ("i​g‍n­ore", "ignore"),
        ("﻿start", "start"),
        ("іgnоrе", "ignore"),
        ("МОСТ", "MOCT"),
        ("a \t b\r c", "a b c"),
        ("a  \n  b", "a \n b"),
        ("a\n\nb", "a\n\nb"),
        ("Zürich é", "Zürich é"),
        ("é", "é"),
        ("plain ASCII text", "plain ASCII text"),
        ("two  blanks", "two blanks"),
        ("", ""),
    ],
)
def test_normalise(spark, given, expected):
    assert one(spark, t.normalise(F.col("x")), x=given) == expected


def test_normalise_null(spark):
    assert one(spark, t.normalise(F.col("x")), x=None) is None


def test_strip_all_white_space(spark):
    assert one(spark, t.strip(F.col("x")), x="　  a b \n") == "a b"


def test_squeeze(spark):
    assert one(spark, t.squeeze(F.col("x")), x=" a\n\n b c ") == "a b c"


def test_words_drop_stop_words_before_pairs(spark):
    tokens = t.words(F.col("x"))
    found = one(spark, t.words_and_pairs(tokens), x="The card of a user_1, é naïve")
    assert found == ["card", "user_1", "naïve", "card user_1", "user_1 naïve"]


@pytest.mark.parametrize("given, expected", [("", []), ("the a of", []), ("card", ["card"])])
def test_words_and_pairs_of_short_texts(spark, given, expected):
    assert one(spark, t.words_and_pairs(t.words(F.col("x"))), x=given) == expected


def test_contained_keeps_list_order(spark):
    assert one(spark, t.contained(F.col("x"), ["scam", "court", "sue"]), x="court or scam") == ["scam", "court"]
