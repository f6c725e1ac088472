"""The pipeline against a plain version of each stage, on a small table with odd rows."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from corvane.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_turn(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from corvane.llm.bpe import public_vocabulary

    from .test_mixing import plain_mix
    from .test_near import plain_kept
    from .test_repeats import brute_bytes

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "mixing", "bpe"]
    steps = dict(corpus_pipeline.STAGES)

    def stage(name, frame):
        steps[name](spark, frame, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    rows = lambda f: {r.doc_id: r for r in f.collect()}
    a = stage("quality", docs)
    assert a.columns == list(corpus_pipeline.COLUMNS)
    predicted = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(rows(a)) == predicted
    b = stage("simhash", a)
    assert sorted(rows(b)) == plain_kept([(d, r.text) for d, r in rows(a).items()])
    c = stage("suffix", b)
    kept = {d: (n, gone) for d, n, gone, _, _ in brute_bytes([(d, r.text) for d, r in rows(b).items()], 200)}
    assert len(rows(c)) == len(kept)
    for d, r in rows(c).items():
        n, gone = kept[d]
        assert n - gone - 6 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)
        assert gone or r.text == rows(b)[d].text
    d = stage("mixing", c)
    times = Counter(r.doc_id for r in d.collect())
    want = plain_mix([(r.doc_id, r.source, r.text) for r in c.collect()])
    assert times == {k: v for k, v in want.items() if v}
    e = stage("bpe", d)
    t = Tokenizer.from_file(public_vocabulary())
    for r in e.collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "ids", "n_tokens", "round_trip"] and out.count() > 0


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns, and an empty table."""
    rows = [(1, "a b c d. " * 40, "en", "s", 5, "extra"), (1, "a b c d. " * 40, "en", "s", 5, "extra"), (2, None, None, None, None, None), (None, "", "en", "s", 0, "x"), (None, "some words here", None, "t", 3, "x"), (3, "Long text of words. " * 30_000, "en", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == list(corpus_pipeline.COLUMNS), name
        n = len(out.collect())
        assert (n == 6 if name in ("suffix", "bpe") else n <= 12), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
