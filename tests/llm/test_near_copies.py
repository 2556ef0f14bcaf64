import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from voxlake.llm import near_copies

from ..oracle import DATA
from . import plain


def made_texts() -> list:
    """Families of copies with words changed, some near the limit, beside odd texts and texts that share one long line."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, line = plain.odd_texts(), words(40)
    for n, copies, most in ((200, 40, 2), (300, 8, 12), (60, 12, 3), (120, 30, 6), (30, 6, 1)):
        base = words(n)
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randint(0, most)):
                new[rng.randrange(n)] = f"x{rng.randrange(9)}"
            out.append(" ".join(new))
    out += [" ".join(line + words(rng.randint(3, 30))) for _ in range(40)]
    # 40 shingles against 50: a similarity of exactly 0.8, and 40 against 51 just below
    exact = [f"e{k}" for k in range(55)]
    return out + [" ".join(exact[:44]), " ".join(exact[:54]), " ".join(["f" + x for x in exact[:44]]), " ".join(["f" + x for x in exact[:55]])]


def stage(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return corpus_pipeline.drop_near_copies(spark, docs, str(DATA))


def wanted(ids, texts):
    return sorted(set(plain.near_groups(ids, texts).values()))


@pytest.mark.parametrize("block", [5, 512])
def test_near_copies_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = made_texts()
    left = stage(spark, texts)
    assert left.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in left.collect()) == wanted(range(len(texts)), texts)


def test_scattered_changes_are_near_copies_and_clean_texts_stay(spark):
    base = [f"w{k}" for k in range(230)]
    near = [w if k not in (40, 90, 140, 190) else "other" for k, w in enumerate(base)]
    clean = [w if k % 8 else "other" for k, w in enumerate(base)]
    texts = [" ".join(x) for x in (base, near, clean)]
    assert (plain.simhash(texts[0]) ^ plain.simhash(texts[1])).bit_count() > 4
    assert sorted(r.doc_id for r in stage(spark, texts).collect()) == [0, 2]


def test_documents_against_all_pairs(spark):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(DATA)).collect())
    assert got == wanted(rows, rows.values())


def test_repeated_and_null_identifiers(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "x y z w v"), (None, "A  b c d"), (None, None)], "doc_id long, text string")
    got = near_copies.near_copies(docs).collect()
    assert len(got) == 4 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (None, None)}
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part, block", [(4, 7), (16, 256)])
def test_large_buckets_in_blocks(spark, part, block, monkeypatch):
    """Every pair of blocks of every bucket is compared, wherever a row's only partner lies."""
    monkeypatch.setattr(near_copies, "PART", part)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{k}" for w in base) for k in range(90)] + made_texts()
    assert sorted(r.doc_id for r in stage(spark, texts).collect()) == wanted(range(len(texts)), texts)


def meet(prints: np.ndarray, key: int, part: int = 1 << 40):
    """What one bucket of these fingerprints hands on, dealt in blocks of ``part`` rows."""
    n, w = len(prints), near_copies.WORDS
    blocks = -(-n // part)
    rows = []
    for i in range(n):
        own = i % blocks
        rows += [(min(own, o), max(own, o), own, i) for o in range(blocks)] if blocks > 1 else [(0, 0, 0, i)]
    rows = sorted(rows)
    deal = np.array([a << 40 | b << 20 | own for a, b, own, _ in rows], np.int64)
    who = np.array([r[3] for r in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key << 32 | 100, np.int64)), pa.array(deal), pa.array(who.astype(np.int64)), *(pa.array(prints[who, k].view(np.int64)) for k in range(w))], names=["bucket", "deal", "node", *near_copies._FP])
    out = pa.Table.from_batches(list(near_copies._meet(0.8)([batch.slice(at, 700) for at in range(0, len(rows), 700)])))
    verify = out.column(2).to_numpy()
    pairs = list(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    return [p for p, v in zip(pairs, verify, strict=True) if v], [p for p, v in zip(pairs, verify, strict=True) if not v]


def test_a_large_group_hands_on_rows_by_its_size_not_by_its_pairs_of_blocks():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**63, near_copies.WORDS, dtype=np.uint64)
    prints = np.tile(one, (600, 1))
    prints[:, 1] ^= np.uint64(1) << rng.integers(0, 63, 600).astype(np.uint64)
    verify, hang = meet(prints, 0, 50)
    blocks = 12 * 11 // 2
    assert len(verify) <= 2 * 600 + blocks and len(hang) <= 600 + blocks
    label = np.arange(600)
    near_copies._spread(label, [tuple(np.array(hang, np.int64).T)])
    assert not label.any()


@pytest.mark.parametrize("n, part", [(150, 1 << 40), (360, 80)])
def test_buckets_hand_on_a_pair_once_and_lose_no_connection(n, part):
    """Over all buckets groups of near copies hand on some pairs a text, each once, and these join all texts that meet anywhere."""
    rng = np.random.default_rng(n)
    prints = np.tile(rng.integers(0, 2**63, (2, near_copies.WORDS), dtype=np.uint64), (n // 2, 1))
    for row in prints[: n - 30]:
        for bit in rng.choice(256, rng.integers(0, 24), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit) % 64)
    prints[n - 30 :] = rng.integers(0, 2**63, (30, near_copies.WORDS), dtype=np.uint64)
    handed, all_met = [], []
    for column in near_copies.segment_keys(prints).T:
        keys, rows_of = np.unique(column, return_counts=True)
        for key in keys[rows_of > 1]:
            rows = np.flatnonzero(column == key)
            verify, hang = meet(prints[rows], int(key), part)
            assert verify == hang
            handed += [(int(rows[a]), int(rows[b])) for a, b in verify]
            i, j = (rows[x] for x in np.triu_indices(len(rows), 1))
            ok = near_copies.in_chain(prints[i] ^ prints[j], np.full(len(i), key))
            all_met.append((i[ok], j[ok]))
    assert len(handed) == len(set(handed)) < 25 * n
    assert set(handed) <= {p for i, j in all_met for p in zip(i.tolist(), j.tolist(), strict=True)}
    got, want = np.arange(n), np.arange(n)
    near_copies._spread(got, [tuple(np.array(handed).T)])
    near_copies._spread(want, all_met)
    assert (got == want).all() and len(set(want.tolist())) < n - 60


@pytest.mark.parametrize("part", [512, 1 << 40])
def test_unlike_texts_of_a_bucket_do_not_hang_together(part):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (3000, near_copies.WORDS), dtype=np.uint64)
    mask = near_copies._MASKS[0, 0]
    prints = (prints & ~mask) | (prints[0] & mask)
    assert meet(prints, 0, part) == ([], [])
    # a text and its near copy among them are the only two that are handed on
    prints[2900] = prints[17] ^ np.uint64(1 << int(near_copies._ORDERS[0][40] % 64)) * (np.arange(near_copies.WORDS) == near_copies._ORDERS[0][40] // 64).astype(np.uint64)
    assert meet(prints, 0, part) == ([(17, 2900)], [(17, 2900)])


@pytest.mark.parametrize("n", [18, 90, 500])
def test_pairs_at_the_similarity_meet(n):
    """Of 1000 pairs of sets at a similarity of exactly 0.8, 99 in 100 or more meet and pass the chain."""
    rng = np.random.default_rng(n)
    both = []
    for _ in range(1000):
        a = rng.integers(0, 2**63, 10 * (n // 9), dtype=np.uint64)
        both.append((np.unique(a[: n // 9 * 9]), np.unique(np.r_[a[: n // 9 * 8], a[n // 9 * 9 :]])))
    one, two = (np.array([near_copies.fingerprint(p[k]) for p in both]) for k in (0, 1))
    equal, met = near_copies.segment_keys(one) == near_copies.segment_keys(two), np.zeros(1000, bool)
    for c in range(equal.shape[1]):
        at = np.flatnonzero(equal[:, c] & ~met)
        if len(at):
            met[at] = near_copies.in_chain(one[at] ^ two[at], near_copies.segment_keys(one[at])[:, c])
    assert met.mean() >= 0.99


def test_fingerprint_and_keys():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**63, 40_000, dtype=np.uint64))
    for n in (0, 1, 2, 255, 256, 17_000, len(grams)):
        got = near_copies.fingerprint(grams[:n])
        for w in range(near_copies.WORDS):
            h = near_copies._scrambled(grams[:n] * near_copies._MIX[w + 1])
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)
    prints = rng.integers(0, 2**63, (50, near_copies.WORDS), dtype=np.uint64)
    keys = near_copies.segment_keys(prints)
    for key, (a, b) in zip(keys.T, ((0, 1), (3, 4)) * near_copies.RINGS * 8, strict=True):
        where = int(key[0]) >> near_copies.WIDTH
        mask = near_copies._MASKS[where // near_copies.SEGMENTS, where % near_copies.SEGMENTS]
        assert (key[a] == key[b]) == (((prints[a] ^ prints[b]) & mask) == 0).all()


def test_chain_ends_with_the_hamming_distance():
    rng = np.random.default_rng(2)
    x = np.zeros((400, near_copies.WORDS), np.uint64)
    for row in x:
        for bit in rng.choice(256, rng.integers(0, 110), replace=False):
            row[bit // 64] |= np.uint64(1 << (int(bit) % 64))
    key = (rng.integers(0, near_copies.RINGS * near_copies.SEGMENTS, 400) << near_copies.WIDTH).astype(np.int64)
    within = np.bitwise_count(x).sum(1) <= near_copies.BUDGET
    ok = near_copies.in_chain(x, key)
    assert ok.any() and not (ok & ~within).any()
    # whatever is within the budget has a start from which the chain holds
    starts = np.arange(near_copies.SEGMENTS) << near_copies.WIDTH
    assert all(near_copies.in_chain(np.repeat(r[None], near_copies.SEGMENTS, 0), starts).any() for r in x[within])
