"""Text functions and packing folds against plain statements of what they mean."""

import hashlib
import math
import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.folds import split_lines, split_text

tokens = lambda s: max(1, math.ceil(len(s) / 4))
words = lambda s: len(s.split())


def plain_split_text(text, budget, count):
    if count(text) <= budget:
        return [text]
    out, held, n = [], [], 0
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        c = count(s)
        if c > budget:
            if held:
                out.append(" ".join(held))
            held = []
            for w in s.split():
                held.append(w)
                if count(" ".join(held)) >= budget:
                    out.append(" ".join(held))
                    held = []
            n = count(" ".join(held)) if held else 0
        else:
            if n + c > budget and held:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(s)
            n += c
    return [*out, " ".join(held)] if held else out


def plain_split_lines(body, budget, count, header):
    lines = body.split("\n")
    head, rest = (lines[:1], lines[1:]) if header else ([], lines)
    out, held = [], []
    for x in rest:
        if held and count("\n".join([*head, *held, x])) > budget:
            out.append(held)
            held = []
        held.append(x)
    if held:
        out.append(held)
    made = ["\n".join(([*head, *p] if head and head[0] else p)) for p in out]
    return [m for m in made if m.strip()]


SENTENCES = st.lists(st.lists(st.sampled_from(["a", "bb", "longer", "wordwordword", "x.", "y!", "z?", "."]), max_size=12).map(" ".join), max_size=8).map(" ".join)
LINES = st.lists(st.sampled_from(["", "a", "a | b", "a long line of words", " "]), min_size=1, max_size=14).map("\n".join)
ONCE = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@ONCE
@given(rows=st.lists(st.tuples(SENTENCES, st.integers(1, 12)), min_size=60, max_size=80))
def test_split_text(spark, rows):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "i int, t string, b int")
    got = df.select("i", split_text(F.col("t"), F.col("b")).alias("x"), split_text(F.col("t"), F.col("b"), T.word_count).alias("y")).collect()
    for r in got:
        t, b = rows[r.i]
        if tokens(t) > b or t:
            assert r.x == [p for p in plain_split_text(t, b, tokens) if p or tokens(t) <= b]
            assert r.y == [p for p in plain_split_text(t, b, words) if p or words(t) <= b]


@ONCE
@given(rows=st.lists(st.tuples(LINES, st.integers(1, 12)), min_size=60, max_size=80))
def test_split_lines(spark, rows):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "i int, t string, b int")
    got = df.select("i", split_lines(F.col("t"), F.col("b")).alias("x"), split_lines(F.col("t"), F.col("b"), repeat_header=True).alias("y")).collect()
    for r in got:
        t, b = rows[r.i]
        assert r.x == plain_split_lines(t, b, tokens, False)
        assert r.y == plain_split_lines(t, b, tokens, True)


def test_scalars(spark):
    row = spark.createDataFrame([("  Title\n", "body é", "42:7", " a  b\t", 'x, ,y ,"')], "title string, text string, k string, w string, c string")
    got = row.select(
        T.content_hash(F.col("title"), F.col("text")).alias("h"),
        T.point_id(F.col("k")).alias("p"),
        T.normalise(F.col("w")).alias("w"),
        T.comma_list(F.col("c")).alias("c"),
        T.token_estimate(F.lit("")).alias("t0"),
        T.token_estimate(F.lit("12345")).alias("t5"),
        T.breadcrumb(F.lit("S"), F.array(F.lit(""), F.lit("A")), F.lit("T")).alias("b"),
        T.page_url(F.lit("https://x//"), F.lit("/p")).alias("u"),
        T.page_url(F.lit(None).cast("string"), F.lit("/p")).alias("u2"),
    ).first()
    assert got.h == hashlib.sha256("Title\nbody é".encode()).hexdigest()
    assert got.p == str(uuid.uuid5(uuid.UUID(T.POINT_NAMESPACE), "42:7"))
    assert (got.w, got.c, got.t0, got.t5, got.b, got.u, got.u2) == ("a b", ["x", "y", '"'], 1, 2, "S > A > T", "https://x/p", "/p")
