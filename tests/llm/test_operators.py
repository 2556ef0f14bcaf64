import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import bpe, components, embed_dedup, exact_dedup, mixing, pii, quality, simhash, suffix_array, suffix_dedup, token_counts, url_filter
from voxlake.llm.queries import QUERIES, SQL, tokenizer

from ..oracle import DATA, assert_same
from . import plain

#: Extra columns, some named like results.
CLASHING = {"kept": True, "score": 1.5, "size": 3, "spans": "x", "n_tokens": 1, "n_bytes": 2, "Component_Id": 9, "block": 4, "id": 5, "td": 6, "a": 7, "w": 8, "root": 1, "fp": 2, "key": 3, "source_size": 4}


def docs_of(spark, texts, clash=False, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, f"src{k % 3}" if k % 4 else None) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, source string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clash else df


@pytest.fixture(scope="module")
def texts():
    return plain.odd_texts()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_a_row_for_each_row(spark, name):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    table = {"op4_embedding_links": "embeddings", "op5_url_filter": "pages"}.get(name, "documents")
    rows, got = spark.read.parquet(f"{DATA}/{table}.parquet").count(), QUERIES[name](spark, str(DATA)).count()
    if name == "op12_source_audit":  # a row a pair of sources and a row a term instead
        sources = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "source").distinct().groupBy("lang").count().collect()
        assert got >= sum(r["count"] * (r["count"] - 1) for r in sources) > 0
        return
    assert got == rows if name != "op9_token_counts" else 0 < got <= rows


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from voxlake.llm import storage

    unset = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(cluster)


def test_tables_written_since_a_point_go(spark):
    from voxlake.llm import storage

    before = storage.materialize(spark.range(3), "kept")
    start = storage.point()
    one, two = (storage.materialize(spark.range(5), "t") for _ in range(2))
    storage.release_since(start, two)
    assert (before.count(), two.count()) == (3, 5)
    with pytest.raises(Exception):  # noqa: B017
        one.count()


def test_empty_tables_give_empty_results(spark):
    docs = docs_of(spark, ["x"]).where("doc_id < 0")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    for df in (
        exact_dedup.exact_dedup(docs), pii.find_spans(docs), simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs), embed_dedup.link_vectors(vectors), quality.score(docs, model), bpe.bpe_round_trip(docs, *tokenizer()),
        mixing.mix(docs), mixing.mixed(docs), suffix_dedup.remove_repeats(docs), token_counts.length_histogram(token_counts.token_lengths(docs, *tokenizer())),
        url_filter.filter_captures(spark.createDataFrame([], "page_id long, url string, fetched date"), url_filter.entries(spark)),
    ):
        assert df.count() == 0


# exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_exact_dedup(spark, texts, keep, ranges, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGES", ranges)
    many = texts + ["hot"] * 60 + ["Hot"] * 30
    ids = list(range(len(many)))
    ids[0], ids[40] = None, None
    got = exact_dedup.exact_dedup(docs_of(spark, many, True, ids), keep=keep).collect()
    norm = [(t or "").translate(plain.ASCII_LOWER) for t in many]
    groups = plain.groups(norm)
    assert len(got) == len(many)
    best = {k: {"min": min, "max": max}[keep]([ids[i] for i in v if ids[i] is not None], default=None) for k, v in groups.items()}
    for r in got:
        key = (r.text or "").translate(plain.ASCII_LOWER)
        assert (r.keep_id, r.group_size, r.text_sha256) == (best[key], len(groups[key]), plain.sha(key))
        assert r.source in ("src0", "src1", "src2", None)
    assert Counter(r.text_sha256 for r in got if r.kept) == {plain.sha(k): 1 for k in groups}


def test_of_repeated_rows_one_stays(spark):
    got = exact_dedup.exact_dedup(docs_of(spark, ["same"] * 50, ids=[5] * 50), keep="max").collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {50}


# personal data


def test_base_spans(spark, texts):
    tricky = [
        "a@b.c_d@e.f", "a@b..c x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.001", "4111 1111-1111 1111, 4111  1111 1111 1111 é\U0001f600 4111111111111111", "+1 (555) 123-4567 +49..1234567890 +1-2",
        "1-" * 5000 + "4111111111111111", "a@" + "b." * 6000 + "c", "a" * 20000 + "@b.c", "1" * 3000, "+1" + "2" * 3000, "4111111111111111 ab@c.d", "x.y@-.-",
    ]
    rng = np.random.default_rng(1)
    tricky += ["".join(rng.choice(list("ab1.@-_+ 94().\n"), rng.integers(1, 80))) for _ in range(400)]
    every = texts + tricky
    found = pii.find_spans(docs_of(spark, every, True))
    got = {r.doc_id: r.s for r in found.select("doc_id", pii.digest(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))).alias("s")).collect()}
    assert [got[i] for i in range(len(every))] == [plain.pii_spans(t) for t in every]


def test_added_kinds_need_checksums_and_context(spark):
    rows = ["pay to GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "his social security number 123-45-6789", "order 123-45-6789", "sample iban DE89370400440532013000"]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows += [f'token = "{key}"', f"commit {key}", f"API-key:{key.upper()}/x", key, f"token {'a' * 40}", f"token {'donaudampfschifffahrt'}", "card 4111111111111111", "part 4111111111111111"]
    got = pii.find_spans(docs_of(spark, rows)).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in got] == [["iban"], [], ["ssn"], [], ["iban"], ["secret"], [], ["secret"], [], [], [], ["card"], ["card"]]
    assert got[11].spans[0].score > got[12].spans[0].score and [(s.start, s.end) for s in got[5].spans] == [(9, 49)]
    assert got[0].spans[0].score > got[4].spans[0].score - 1e-9


def test_redaction(spark):
    df = docs_of(spark, ["mail a@b.cd or +1 555 123 4567 now", None, "none"])
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail [email] or [phone] now", "", "none"]


# near duplicates


def test_fingerprints_and_components(spark, texts):
    rng = np.random.default_rng(2)
    base = " ".join(f"w{k}" for k in range(400)).split()
    near = [" ".join(w if k != j else "other" for k, w in enumerate(base)) for j in rng.integers(0, 400, 30)]
    every = texts + near
    prints = [plain.simhash(t) for t in every]
    assert prints == [simhash.fingerprint(t) for t in every]
    want = plain.components(list(range(len(every))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, every, True)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(enumerate(prints))
    assert sorted(i for i, r in got.items() if r.kept) == sorted(set(want.values()))
    left = simhash.drop_near_duplicates(docs_of(spark, every))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values())) and left.columns == ["doc_id", "text", "source"]


@pytest.mark.parametrize("strip", [4, 256])
def test_no_link_within_four_bits_is_lost(spark, strip, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", strip)
    rng = np.random.default_rng(strip)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            prints.add(b ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64))))
    prints = sorted(prints)
    keyed = next(simhash._keys(iter([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(np.array(prints, np.uint64).view(np.int64))], names=["fp"])])))
    key, fp = keyed.column(0).to_numpy(), keyed.column(1).to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    a, b = simhash._linked(key[order], fp[order])
    assert all((int(x) ^ int(y)).bit_count() >= 1 for x, y in zip(a, b))
    want = plain.components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    label = {p: p for p in prints}
    edges = list(zip(a.tolist(), b.tolist()))
    for _ in range(len(prints)):
        before = dict(label)
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    assert label == want


@pytest.mark.parametrize("block", [2, 8])
def test_large_buckets_in_blocks(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64).tolist()
    prints = sorted({b ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64))) for b in base for _ in range(30)} | set(base))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", block)
    dealt = simhash._in_buckets(df)
    assert dealt.where("b > 0").count() > 0
    links = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(simhash._bucket_links, "a long, b long")
    got = {p: p for p in prints}
    got |= {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in components.connected_components(links).collect()}
    want = plain.components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    same = lambda label: sorted(sorted(g) for g in plain.groups([label[p] for p in prints]).values())
    assert same(got) == same(want)


def test_repeated_and_null_identifiers(spark):
    got = simhash.near_duplicates(docs_of(spark, ["a b c d", "x y z w v", "a b c d", None], ids=[1, 1, None, None])).collect()
    assert len(got) == 4 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (None, None)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 160)}


# embeddings


def vectors_of(rng, dim=24):
    base = rng.normal(size=(30, dim))
    near = [base[k % 30] + rng.normal(size=dim) * 0.1 for k in range(60)]
    rows = [list(map(float, v)) for v in [*base, *near, *near[:5], 3 * near[0]]]
    return rows + [None, [], [0.0] * dim, [1.0] * (dim - 1) + [float("nan")], [1.0] * (dim - 1) + [None], [float("inf")] * dim, [1e300] * dim, [1e-300] * dim, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("block", [3, 1024])
def test_vector_links(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "SKETCH_BLOCK", 2 * block)
    rows = vectors_of(np.random.default_rng(5))
    unit = []
    for v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / max(abs(x) for x in v) if ok else None)
        if ok:
            unit[-1] = unit[-1] / np.linalg.norm(unit[-1])
    linked = lambda a, b: unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    n = len(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumns({"kept": F.lit(1), "id": F.lit(2), "w": F.lit(3)}).repartition(3)
    got = {r.vec_id: r for r in embed_dedup.link_vectors(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i != j and linked(i, j) for j in range(n)) for i in range(n)}
    want = plain.components(list(range(n)), linked)
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.component_id == i) for i, r in got.items())


def test_null_and_repeated_vector_identifiers(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.link_vectors(df).collect()), key=repr)
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 0, None, False)]


@pytest.mark.parametrize("depth", [d[1:] for d in embed_dedup.DEPTHS])
def test_pairs_at_the_limit_are_found(depth):
    rng = np.random.default_rng(6)
    u = rng.normal(size=(600, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=u.shape)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = (embed_dedup.bucket_codes(x, depth) for x in (u, 0.9 * u + np.sqrt(0.19) * v))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.98


@pytest.mark.parametrize("depth", [d[1:] for d in embed_dedup.DEPTHS])
@pytest.mark.parametrize("dim", [64, 128, 512, 768])
def test_vectors_at_the_limit_are_linked(spark, dim, depth, monkeypatch):
    monkeypatch.setattr(embed_dedup, "depth_for", lambda n: depth)
    rng = np.random.default_rng(6)
    u = rng.normal(size=(1000, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=u.shape)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, 0.9001 * u + np.sqrt(1 - 0.9001**2) * v]))]
    found = embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).where("vec_id >= 1000 and component_id = vec_id - 1000").count()
    assert found >= 0.99 * 1000


def test_depth_is_the_same_for_any_number_of_vectors(spark, monkeypatch):
    asked, known = [], embed_dedup.depth_for
    monkeypatch.setattr(embed_dedup, "depth_for", lambda *a: asked.append(a) or known(*a))
    for n in (2, 40):
        rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(n)]
        embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert asked[0] == asked[1]


# URLs


def test_lists_are_judged_as_of_the_fetch(spark):
    rows = [("host", "bad.org", "spam", "2024-02-01", True), ("host", "bad.org", "spam", "2024-03-01", True), ("host", "bad.org", "spam", "2024-04-01", False), ("word", "casino", "play", "2024-01-01", True), ("host", None, "x", "2024-01-01", True)]
    urls = ["http://bad.org/", "https://u:p@WWW.Bad.org.:80/casino", "http://notbad.org/x", "mailto:x", None, "http:///casino/"]
    days = ["2024-01-31", "2024-02-01", "2024-03-15", "2024-04-01", None]
    pages = [(i * 10 + j, u, d) for i, u in enumerate(urls) for j, d in enumerate(days)]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched string").withColumns({"kind": F.lit("host"), "spans": F.lit(1), "pattern": F.lit("x")})
    got = {r.page_id: (r.n_hits, r.categories, r.blocked) for r in url_filter.filter_captures(df, url_filter.entries(spark, rows)).collect()}
    for page, url, day in pages:
        spam = bool(url and day and "2024-02-01" <= day < "2024-04-01" and "bad.org" in url.lower().replace("notbad", "fine"))
        play = bool(url and day and "casino" in url)
        assert got[page] == (spam + play, ",".join(c for c, on in (("play", play), ("spam", spam)) if on), spam or play)


def test_a_host_entry_covers_its_subdomains_at_any_depth(spark):
    long = ".".join("abcdefghijklmnopqrst") + ".example.org"
    rows = [("host", h, "spam", "2024-01-01", True) for h in ("b.c.d.e.f.example.org", long)]
    hosts = {"b.c.d.e.f.example.org": 1, "a.b.c.d.e.f.example.org": 1, "z.y.a.b.c.d.e.f.example.org": 1, "xb.c.d.e.f.example.org": 0, "c.d.e.f.example.org": 0, long: 1, "www." + long: 1}
    pages = spark.createDataFrame([(i, f"http://{h}/x", "2024-02-01") for i, h in enumerate(hosts)], "page_id long, url string, fetched string")
    got = {r.page_id: r.n_hits for r in url_filter.filter_captures(pages, url_filter.entries(spark, rows)).collect()}
    assert got == dict(enumerate(hosts.values()))


def test_hosts_and_prefixes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    label = lambda: str(rng.choice(["a", "b", "cc"]))
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda n: "".join("/" + str(rng.choice(["x", "y", "en", ""])) for _ in range(n))
    listed = [("host", host(int(rng.integers(1, 21))), f"h{k}") for k in range(40)] + [("prefix", host(int(rng.integers(1, 4))) + path(int(rng.integers(0, 6))), f"p{k}") for k in range(150)]
    listed += [("prefix", host(2) + path(10), f"q{k}") for k in range(5)]
    hosts = [str(rng.choice(["", "a.", "b.a."])) + (p.split("/")[0] if rng.random() < 0.7 else host(int(rng.integers(3, 20)))) for _, p, _ in listed]
    urls = [f"http://{h}{'/' + p.split('/', 1)[1] if '/' in p else ''}{path(int(rng.integers(0, 4)))}?q=/x" for h, (_, p, _) in zip(hosts, listed)]
    urls += urls[:3] + ["http://a" + "/x" * 5000, "http://" + "a." * 3000 + "b/"]

    def hits(url):
        h, _, p = url.split("://")[1].partition("?")[0].partition("/")
        h, whole = h.rstrip("."), (h + "/" + p if "/" in url.split("://")[1].partition("?")[0] else h)
        out = []
        for kind, pattern, category in listed:
            pattern = pattern.rstrip("/")
            if kind == "host" and (h == pattern or h.endswith("." + pattern)) or kind == "prefix" and (whole == pattern or whole.startswith(pattern + "/")):
                out.append(category)
        return sorted(out)

    pages = spark.createDataFrame([(i, u, "2024-02-01", i % 3) for i, u in enumerate(urls)], "page_id long, url string, fetched string, k long").withColumn("blocked", F.lit("x"))
    got = url_filter.filter_captures(pages, url_filter.entries(spark, [(*e, "2024-01-01", True) for e in listed]))
    assert got.columns == ["page_id", "url", "k", "host", "fetched", "n_hits", "categories", "blocked"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(urls) and sum(r.blocked for r in found.values()) > 50
    for i, url in enumerate(urls):
        assert (found[i].n_hits, found[i].categories, found[i].k) == (len(hits(url)), ",".join(hits(url)), i % 3), url


def test_an_empty_list_blocks_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "2024-01-01")], "page_id long, url string, fetched string")
    assert not url_filter.filter_captures(pages, url_filter.entries(spark).limit(0)).first().blocked


# quality


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    good = [" ".join(word() for _ in range(rng.integers(5, 200))) + "." for _ in range(150)]
    bad = [" ".join([word()] * int(rng.integers(10, 100))) for _ in range(40)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(40)]
    every = good + bad + [None, "", "\n"]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(230)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = docs_of(spark, every, True)
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(every)
    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    out = [i for i, r in got.items() if r.held_out and i < 230]
    assert np.mean([got[i].predicted == (i < 150) for i in out]) > 0.95
    assert quality.keep_good(docs, model).columns == docs.columns


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = docs_of(spark, [f"text {i} " * (i % 5 + 1) for i in range(60)])
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))


def test_scores_are_sums_of_looked_up_bins(spark, texts):
    rng = np.random.default_rng(9)
    every = texts + [" ".join(rng.choice(["a", "bb", "Ccc!", "9", "|"], rng.integers(1, 60))) for _ in range(200)]
    model = quality.train(docs_of(spark, every), spark.createDataFrame([(i, int(rng.integers(0, 2))) for i in range(len(every))], "doc_id long, quality int"))
    assert model.pairs

    def plain_score(text):
        x, total = quality.features(text), model.intercept
        bin_of = lambda cuts, v: sum(c <= v for c in cuts)
        for k, v in enumerate(x):
            total += model.tables[k][bin_of(model.cuts[k], v)]
        for (a, b), table in model.pairs.items():
            total += table[bin_of(model.coarse[a], x[a])][bin_of(model.coarse[b], x[b])]
        return 1 / (1 + np.exp(-total))

    docs = docs_of(spark, every)
    for r in quality.score(docs.union(docs.limit(30)), model).collect():
        assert abs(r.score - plain_score(every[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_labels_that_repeat_count_once(spark):
    docs = docs_of(spark, [f"text {i} " * (i % 5 + 1) for i in range(60)])
    labels = [(i, i % 2) for i in range(60)]
    a, b, c = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, labels + labels[:20], labels + [(i, 1 - i % 2) for i in range(60)]))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))
    assert quality.score(docs, c).where("abs(score - 0.5) > 1e-9").count() == 0


def test_one_label_gives_a_constant():
    x = np.zeros((4, len(quality.FEATURES)))
    assert quality.fit(x, np.ones(4)).scores(x).min() > 0.5 > quality.fit(x, np.zeros(4)).scores(x).max()
    assert quality.fit(x[:0], np.zeros(0)).scores(x)[0] == 0.5


# tokens


def reference_encoder():
    import base64

    import tiktoken

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("piece", [7, 50_000])
def test_tokens_are_those_of_the_whole_text(spark, texts, piece, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", piece)
    enc = reference_encoder()
    every = texts + ["it's  we'll\n\n  x\t  y 12 345!? ", "<|endoftext|> a" * 9, " " * 40 + "x" + " " * 40, "!\x1c?\x1d \x1e!a\x1f\x85b\u00a0c!\u2028d\u3000 e" * 5]
    for t in every:
        assert [i for p in bpe.pieces(t or "", piece) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t or "")
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs_of(spark, every, True), *tokenizer()).collect()}
    for i, t in enumerate(every):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].token_ids, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), ids, plain.sha(",".join(map(str, ids))), plain.sha(t or ""))


def test_length_histogram(spark, texts):
    enc = reference_encoder()
    n = sorted(len(enc.encode_ordinary(t or "")) for t in texts)
    hist = token_counts.length_histogram(token_counts.token_lengths(docs_of(spark, texts), *tokenizer()))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert (r.docs_up_to, r.tokens_up_to, r.docs_beyond, r.tokens_beyond) == (sum(x <= k for x in n), sum(x for x in n if x <= k), sum(x > k for x in n), sum(x for x in n if x > k))
        assert r.truncated_total == sum(min(x, k) for x in n) and r.quantile == pytest.approx(sum(x <= k for x in n) / len(n))
    assert token_counts.answer(hist, []).count() == 0
    assert [tuple(r) for r in token_counts.answer(hist.limit(0), [7, 7]).collect()] == [(7, 0, 0)] * 2
    got = {r.limit_tokens: (r.docs_within, r.truncated_total) for r in token_counts.answer(hist, [0, 5, 100, 10**6]).collect()}
    assert got == {k: (sum(x <= k for x in n), sum(min(x, k) for x in n)) for k in (0, 5, 100, 10**6)}


# mixing


@pytest.mark.parametrize("share,most", [(1.5, 2.0), (0.3, 2.0), (2.0, 2.0), (1.0, 5.0)])
def test_mix(spark, texts, share, most):
    docs = docs_of(spark, texts, True)
    rows = mixing.mix(docs, share=share, most=most).collect()
    again = mixing.mix(docs.repartition(5), share=share, most=most).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes: Counter = Counter()
    for r in rows:
        assert r.size == len(plain.words(r.text))
        sizes[r.source] += r.size
    want = plain.targets(dict(sizes), share=share, most=most)
    taken: Counter = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= np.ceil(most) * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(np.floor(want[s] + 1e-9)) for s in sizes)


def test_mixed_rows_hold_the_words_taken(spark, texts):
    docs = docs_of(spark, texts).withColumn("n_chars", F.length("text"))
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got: Counter = Counter()
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] += len(plain.words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in want.items() if v})


def test_source_without_words(spark):
    rows = mixing.mix(docs_of(spark, [None, "", " "])).collect()
    assert {(r.size, r.taken, r.target) for r in rows} == {(0, 0, 0.0)}


# repeats


@pytest.mark.parametrize("vector", [0, 10**9])
def test_both_ways_of_inducing(vector, monkeypatch):
    monkeypatch.setattr(suffix_array, "VECTOR", vector)
    rng = np.random.default_rng(12)
    for _ in range(150):
        t = np.r_[rng.integers(1, rng.integers(2, 300), rng.integers(1, 150)), 0].astype(np.uint16)
        for x in (t, np.r_[np.tile(t[:-1], 3), 0].astype(np.uint16)):
            assert list(suffix_array.suffix_array(x)) == sorted(range(len(x)), key=lambda i: tuple(x[i:]))


def test_suffix_arrays():
    rng = np.random.default_rng(9)
    for _ in range(200):
        t = np.r_[rng.integers(1, rng.integers(2, 7), rng.integers(1, 90)), 0].astype(np.uint16)
        b, sa = bytes(t.astype(np.uint8)), suffix_array.suffix_array(t)
        assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])
        phi, plcp = suffix_array.permuted_lcp(t, sa, 30)
        for before, here in zip(sa, sa[1:]):
            k = 0
            while max(before, here) + k < len(b) and b[before + k] == b[here + k]:
                k += 1
            assert phi[here] == before and plcp[here] == min(k, 30)


@pytest.mark.parametrize("length", [64, 400])
@pytest.mark.parametrize("contexts,block", [(2048, 1 << 17), (2, 512)])
def test_repeats(spark, texts, length, contexts, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(10)
    passage = "".join(rng.choice(list("abcdefgh "), 450))
    around = ["".join(rng.choice(list("xyz uvw"), rng.integers(0, 300))) for _ in range(40)]
    every = texts + [a[: len(a) // 2] + passage + a[len(a) // 2 :] for a in around]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, every, True), length=length, with_text=True).collect()}
    want = plain.without_repeats(every, length)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(every))] == want
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got.values())


def test_repeats_in_equal_rows_and_without_identifiers(spark):
    text = "".join(np.random.default_rng(11).choice(list("abcdefgh"), 500))
    rows = suffix_dedup.remove_repeats(docs_of(spark, [text, text, "short", text[:399]], ids=[1, 1, None, None])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(5, 0), (399, 0), (500, 500), (500, 500)]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs_of(spark, ["x"]), length=10)
