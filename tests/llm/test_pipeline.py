from collections import Counter

import corpus_pipeline
import pytest

from ..oracle import DATA
from . import plain


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of the last."""
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    from voxlake.llm.storage import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], str(DATA)), name))
    return frames


def test_stages_return_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "tokens"]
    assert all(f.columns == stages[0].columns for f in stages[:-1])


def test_quality_keeps_what_is_labelled_good(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_dedup_stages_against_plain_versions(stages):
    rows = {r.doc_id: r.text for r in stages[1].collect()}
    first: dict = {}
    for i in sorted(rows):
        first.setdefault((rows[i] or "").translate(plain.ASCII_LOWER), i)
    exact = sorted(first.values())
    assert sorted(r.doc_id for r in stages[2].collect()) == exact
    roots = plain.near_groups(exact, [rows[i] for i in exact])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(roots.values()))


def test_mix_meets_its_targets(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(plain.words(r.text))
    for r in stages[4].collect():
        taken[r.source] += len(plain.words(r.text))
    want = plain.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_tokens_decode_to_the_texts(stages):
    texts = Counter(plain.sha(r.text or "") for r in stages[4].collect())
    rows = stages[5].collect()
    assert Counter(r.decoded_sha256 for r in rows) == texts
    assert all(len(r.token_ids) == r.n_tokens and plain.sha(",".join(map(str, r.token_ids))) == r.ids_sha256 for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(corpus_pipeline.run(spark, str(DATA))) == key(stages[5])


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, node string, least string, __id string, `a b` string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_columns(spark, name, stage):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    texts = [*plain.odd_texts(), None, ""]
    rows = [(i if i % 7 else None, t, None, None if i % 3 else "s", None, "x", "y", "z", "n", "l", "i", "ab") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[5:9], ODD)
    got = stage(spark, docs, str(DATA))
    left = [tuple(r) for r in got.select("doc_id", "`a b`").collect()]
    assert {r[0] for r in left} <= {r[0] for r in rows} and all(r[1] == "ab" for r in left)
    if name != "tokens":
        assert got.columns == [c for c in docs.columns if c != "__id"]
        assert {r.text for r in got.select("text").collect()} <= set(texts) or name == "mix"
    else:
        assert len(left) == len(rows) + 4
    empty = stage(spark, docs.limit(0), str(DATA))
    assert empty.columns == got.columns and empty.count() == 0


def test_near_dedup_keeps_the_smallest_identifier_and_takes_nulls_last(spark):
    texts = [(None, "a b c d e f"), (9, "a b c d e f"), (4, "A b c d e f"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(DATA)).collect()) == [4, 7]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, str(DATA)).collect()) == [4, 7]
