import re

import pytest
from pyspark.sql import functions as F

from rolevec.functions import EXPAND_PARAM_INDEX, split_keep_inner, token_expand, token_motion


def jvm_split(s: str, sep: str) -> list[str]:
    """String.split(sep): regex split with trailing empty parts dropped."""
    parts = re.split(re.escape(sep), s)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@pytest.mark.parametrize("text", ["a@b@c", "a@b@", "a@@b@@", "@b", "a", "a@b@c,,d,,", "x,,,y,,,,"])
def test_split_keep_inner_matches_jvm_split(spark, text):
    for sep in ("@", ",,"):
        got = spark.range(1).select(split_keep_inner(F.lit(text), sep).alias("p")).first()["p"]
        want = jvm_split(text, sep)
        if text == "" or want == []:
            assert got == []
        else:
            assert got == want


def test_token_motion(spark):
    df = spark.createDataFrame([("1@5300100@a,,b",), ("2@m2@",), ("3",), ("4@m4@@@",)], "t string")
    got = [r[0] for r in df.select(token_motion("t")).collect()]
    assert got == ["5300100", "m2", None, "m4"]


def test_token_motion_strict_raises(spark):
    df = spark.createDataFrame([("3",)], "t string")
    with pytest.raises(Exception):
        df.select(token_motion("t", strict=True)).collect()


def test_token_expand_default_map(spark):
    rows = [("1@5300100@a,,b,,c,,d",), ("1@5300230@a,,b,,c,,d",), ("1@5300001@a,,b,,c,,d",),
            ("1@9999999@a,,b,,c,,d",), ("1@5300105@p0,,p1,,p2,,",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(token_expand("t")).collect()]
    assert got == ["a5300100", "c5300230", "d5300001", "9999999", "p25300105"]
    assert len(EXPAND_PARAM_INDEX) == 12


def test_token_expand_custom_map(spark):
    df = spark.createDataFrame([("7@m@x,,y",), ("7@n@x,,y",)], "t string")
    got = [r[0] for r in df.select(token_expand("t", {"m": 1})).collect()]
    assert got == ["ym", "n"]
