"""The pipeline's stages against what their operators say of each stage's own input."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOREM, ODD, WORD, check_packing, dedup_rows, hamming_rows, sha

from citeweave.llm import language, pii
from citeweave.llm.common import materialize, table


def texts(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


@pytest.fixture(autouse=True)
def key(spark):
    spark.conf.set("spark.citeweave.pseudonymKey", "a secret")
    yield
    spark.conf.unset("spark.citeweave.pseudonymKey")


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "substring_dedup", "pii", "packing"]
    one = materialize(cp.language_id(spark, docs, sf))
    assert one.columns == columns
    gone = docs.join(one, "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone)

    two = materialize(cp.near_dedup(spark, one, sf))
    assert two.columns == columns
    want = {d for d, _, c in hamming_rows(texts(one)).elements() if d == c}
    assert Counter(r.doc_id for r in two.collect()) == Counter(want)

    three = materialize(cp.substring_dedup(spark, two, sf))
    assert three.columns == columns
    kept = Counter((d, sha(" ".join(WORD.findall(x)))) for d, x, _ in texts(three))
    assert kept == Counter((d, k) for d, _, _, k in dedup_rows(texts(two)).elements())

    four = materialize(cp.pseudonyms(spark, three, sf))
    assert four.columns == columns
    p = pii.Permutation("a secret")
    assert Counter(texts(four)) == Counter((d, pii.pseudonymise(x, p)[0], lang) for d, x, lang in texts(three))
    assert all(r.n_chars == len(r.text) for r in four.collect())

    check_packing(cp.packed(spark, four, sf), texts(four))


SAID = "The quick brown fox jumps over the lazy dog and then runs away from all of them again. "
ROWS = [
    *ODD, (20, SAID * 3, "en"), (21, SAID * 3, "en"), (21, SAID * 3, "en"), (22, "Call +1 (743) 555-3824 or ٠١٢-٤٥٦-٨٩٠١ now, " + SAID, None), (23, "x " + LOREM + " y", "en"), (None, None, None),
]


def odd_documents(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    clash = {c: F.lit(f"own {c}") for c in ("lang_pred", "score", "pii_kinds", "fp", "component_id", "anchor", "mark", "start", "piece", "length")}
    return df.withColumns(clash)


def test_stages_on_odd_rows(spark, sf):
    docs = odd_documents(spark)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    one = materialize(cp.language_id(spark, docs, sf))
    want = Counter()
    for d, x, lang in ROWS:
        guess, score = model.predict(x)
        if guess != language.UNKNOWN and score >= cp.MIN_SCORE:
            want[d, x, lang or guess] += 1
    assert Counter(texts(one)) == want and sum(want.values()) > 5
    two = materialize(cp.near_dedup(spark, one, sf))
    parts = Counter((d, x, lang) for d, x, lang in texts(one))
    stays = {d for d, _, c in hamming_rows(texts(one)).elements() if d is None or d == c}
    assert Counter(texts(two)) == Counter({k: n for k, n in parts.items() if k[0] in stays})
    three = materialize(cp.substring_dedup(spark, two, sf))
    assert Counter((d, sha(" ".join(WORD.findall(x or "")))) for d, x, _ in texts(three)) == Counter((d, k) for d, _, _, k in dedup_rows(texts(two)).elements())
    four = materialize(cp.pseudonyms(spark, three, sf))
    p = pii.Permutation("a secret")
    assert Counter(texts(four)) == Counter((d, pii.pseudonymise(x, p)[0], lang) for d, x, lang in texts(three))
    for df in (one, two, three, four):
        assert df.columns == docs.columns
        assert all(r.score == "own score" and r.pii_kinds == "own pii_kinds" and r.lang_pred == "own lang_pred" and (r.text is None or r.n_chars == len(r.text)) for r in df.collect())
    check_packing(cp.packed(spark, four, sf), texts(four))


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_few_rows(spark, sf, name, stage):
    docs = odd_documents(spark)
    assert stage(spark, docs.where("doc_id = -1"), sf).count() == 0
    nulls = docs.where("text is null")
    assert stage(spark, nulls, sf).count() == {"language_id": 0, "near_dedup": 2}.get(name, 2)


def test_unclear_language_goes(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    score = {d: model.predict(x)[1] for d, x, _ in texts(docs)}
    cut = sorted(score.values())[len(score) // 2]
    monkeypatch.setattr(cp, "MIN_SCORE", cut)
    assert {d for d, _, _ in texts(cp.language_id(spark, docs, sf))} == {d for d, s in score.items() if s >= cut}
