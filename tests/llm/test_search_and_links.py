"""URL rules, mixing, top-k search, components, SimHash and the pipeline against brute force."""

import math
import os
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from branchlight.llm import mixing, packing, queries, simhash, topk, url_rules
from branchlight.llm.components import components
from tools.check import TABLES, compare

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, key long, size long, n int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    problem, _ = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])
    assert problem is None, problem


def plain_rule(rules, host, path):
    fits = [(len(r), v == "block", r, v) for v, r in rules
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
            and path.startswith(r[len(r.partition("/")[0]):])]
    return max(fits)[2:] if fits else None


HOSTS = st.lists(st.sampled_from(["a", "b", "net", "org"]), min_size=1, max_size=4).map(".".join)
PATHS = st.lists(st.sampled_from(["/", "x", "xy", "y"]), max_size=5).map(lambda p: "/" + "".join(p) if p else "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.builds(lambda h, p: h + p, HOSTS, PATHS)), max_size=8), HOSTS, PATHS)
def test_trie_finds_the_longest_rule(rules, host, path):
    got, want = url_rules.RuleTrie(rules).match(host, path), plain_rule(rules, host, path)
    assert (got is None) == (want is None)
    if got:
        assert len(got[0]) == len(want[0]) and got[1] == want[1]


def test_urls_of_any_kind(spark):
    urls = [(1, "HTTP://WWW.Example.NET/en/1?x#y"), (2, None), (3, "no scheme/net/"), (4, "x://net"), (5, "x://net/"), (None, "x://a.b.net?q=/"),
            (6, "a://b://c.net/z"), (6, "a://b://c.net/z"), (7, "x://notnet/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    rows = Counter(tuple(r) for r in url_rules.judge_urls(pages, queries.URL_RULES).collect())
    assert rows == Counter([(1, "www.example.net", "/en/1", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
                            (4, "net", "", None, "allow"), (5, "net", "/", "net/", "block"), (None, "a.b.net", "", None, "allow"),
                            (6, "b:", "//c.net/z", None, "allow"), (6, "b:", "//c.net/z", None, "allow"), (7, "notnet", "/", None, "allow")])
    assert url_rules.judge_urls(pages.where("false"), queries.URL_RULES).collect() == []


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "abcde"[min(4, int(rng.exponential(1.0)))]) for i in range(600)]
    rows += [(600, None, "a"), (601, "", None), (602, "one two", None), (None, "three words here", "b"), (603, "same", "c"), (603, "same", "c")]
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes, of = Counter(), {}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        of.setdefault(i, s)
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(3 * sizes[s] for s in names if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * sizes[s] for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    taken = Counter()
    for r in out:
        s = next(x for x in names if r.source_size == sizes[x] and abs(r.target - target[x]) < 1e-6)
        taken[s] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(taken[s] - target[s]) <= 40 for s in names)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in out if r.size and r.doc_id not in (603,))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).collect() == [] == mixing.mixed_documents(docs.where("false")).collect()
    assert {r.taken for r in mixing.mix(docs.where("text IS NULL OR text = ''")).collect()} == {0}


@pytest.mark.parametrize("block", [3, 50])
def test_top_k(spark, block):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)]
    vectors += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(120, 180)]
    odd = [(180, None), (181, [1.0, None, 1.0, 1.0]), (182, [float("nan"), 1.0, 1.0, 1.0]), (183, [float("inf")] * 4), (184, [1.0]), (190, [2.0]),
           (None, [9.0] * 4), (200, [5.0, 5.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id long, embedding array<float>, score int, rank int")
    got = {}
    for r in topk.top_k(table, F.col("vec_id") % 10 == 0, k=5, block_rows=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = vectors + [(184, [1.0]), (190, [2.0]), (200, [5.0, 5.0])]
    scaled = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in usable}
    for q in [i for i in scaled if i % 10 == 0]:
        near = sorted((-int(scaled[q] @ scaled[c]), c) for c in scaled if c != q and len(scaled[c]) == len(scaled[q]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, c, -s) for n, (s, c) in enumerate(near)]
    assert topk.top_k(table.where("false"), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("size", [5e3, 1e6, 2e15])
def test_top_k_of_large_components(spark, size):
    """Components are not clamped, and scores are exact up to the whole range of longs."""
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(60)]
    # One large component; the others' are small where it is very large.
    vectors += [(i, [float(x) for x in (size * rng.normal(), *rng.normal(0, 1, 2))]) for i in range(60, 80)]
    if size > 1e9:
        vectors = [(i, [x if i >= 60 else x / 1e3, y, z]) for i, (x, y, z) in vectors if i <= 60]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in vectors}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    asked = [i for i in whole if i % 20 == 0]
    want = [(q, n + 1, c, -s) for q in asked for n, (s, c) in enumerate(sorted((-score(q, c), c) for c in whole if c != q)[:5])]
    assert max(abs(score(a, b)) for a in asked for b in whole if a != b) > 2 ** 31 and max(abs(w[3]) for w in want) < 2 ** 63
    assert sorted(map(tuple, topk.top_k(rows, F.col("vec_id") % 20 == 0, k=5).collect())) == sorted(want)


def test_inner_products_at_the_ends_of_longs():
    big = 2.0 ** 40
    queries = np.array([[2.0 ** 31, 2.0 ** 31, 0.0], [big, -big, 1.0]])
    matrix = np.array([[2.0 ** 31, 2.0 ** 31, 0.0], [-2.0 ** 31, -2.0 ** 31, 0.0], [2.0 ** 32, -2.0 ** 31, 5.0], [big, big, 7.0]])
    whole = [[sum(int(x) * int(y) for x, y in zip(q, c)) for c in matrix.tolist()] for q in queries.tolist()]
    fits = np.array([[-2 ** 63 <= x < 2 ** 63 for x in r] for r in whole])
    assert whole[0][:2] == [2 ** 63, -2 ** 63] and whole[1][3] == 7 and not fits.all()
    assert [x for r, f in zip(topk.inner_products(queries, matrix, fits).tolist(), fits) for x, y in zip(r, f) if y] == [
        x for r, f in zip(whole, fits) for x, y in zip(r, f) if y]
    for q, c in zip(*np.nonzero(~fits)):
        with pytest.raises(OverflowError):
            topk.inner_products(queries[[q]], matrix[[c]], np.array([[True]]))


def roots_of(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_components(spark):
    rng = np.random.default_rng(8)
    path = [(i, i + 1) for i in range(60)][::-1]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (150, 2))]
    links = path + star + some + [(5, 5), (70, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in roots_of([k for k in links if k[0] != k[1]]).items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_every_pair_within_the_radius_shares_a_table():
    rng = np.random.default_rng(9)
    for radius in (1, 2, 4):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & diff == 0 for m in masks)


def plain_print(text, shingle):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    rng = np.random.default_rng(10)
    long = [f"w{x}" for x in rng.integers(0, 900, 500)]
    rows = [(i, " ".join(long[:k] + ["changed"] + long[k + 1:]), "a") for i, k in enumerate(rng.integers(0, 500, 40))]
    rows += [(100 + i, f"short {i // 3} text number {i // 3}", "b") for i in range(30)]
    rows += [(200, None, "c"), (201, "", "c"), (202, " \n", "c"), (300, "A b C", "c"), (299, "a B c", "c"), (300, "A b C", "c"), (None, "a b c", "c"),
             (None, "alone without an id", "c"), (None, "alone without an id", "d")]
    docs = documents(spark, rows)
    prints = [plain_print(t, 4) for _, t, _ in rows]
    distinct = sorted(set(prints))
    root = roots_of([(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if (a ^ b).bit_count() <= 4])
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, p, least.get(root[p])) for (i, _, _), p in zip(rows, prints))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({i: 1 for i in set(least.values())} | {None: 1})
    assert simhash.near_duplicates(docs.where("false")).collect() == [] == simhash.one_of_each(docs.where("false")).collect()


def test_one_row_of_each_component(spark):
    """Ids that repeat with different texts: every component keeps exactly one row, its own."""
    texts = {n: " ".join(f"{n}{i}" for i in range(40)) for n in "abcd"}
    rows = [(1, texts["a"], "s"), (5, texts["a"], "s"), (5, texts["b"], "s"), (9, texts["b"], "s"), (12, texts["b"], "s"),
            (7, texts["c"], "s"), (7, texts["d"], "s"), (8, texts["d"], "s"), (None, texts["d"], "s")]
    for order in (rows, [(i, {texts["a"]: texts["b"], texts["b"]: texts["a"]}.get(t, t), s) for i, t, s in rows]):
        kept = simhash.one_of_each(documents(spark, order)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted({t: (i, t) for i, t, _ in sorted(
            (r for r in order if r[0] is not None), key=lambda r: -r[0])}.values())


def test_blocks_link_across_components(spark, monkeypatch):
    """Many fingerprints in one bucket that the first comparisons don't join."""
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 62, 4)]
    values = {b ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in range(9) for _ in range(12)}
    distinct = sorted(values)
    want = roots_of([(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if (a ^ b).bit_count() <= 4])
    got = {r.node: r.root for r in simhash.similar_classes(spark.createDataFrame([(v,) for v in distinct], "fp long"), 4).collect()}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    assert groups(got) == groups(want)


def test_pipeline_stages(spark, tmp_path):
    """Every stage does to its own input what its operator says, checked by plain Python."""
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        after = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert after and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {r.component_id for r in simhash.near_duplicates(docs).collect()} and set(after.values()) == {1}
        if name == "mixing":
            taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
            assert all(after[i] == n for i, n in taken.items())
        if name == "packing":
            lengths = Counter()
            for r in out.collect():
                lengths[r.doc_id] += r.length
            assert lengths == Counter({r.doc_id: before[r.doc_id] * r.doc_tokens for r in out.collect()})
            assert lengths.keys() == before.keys()
        kept[name], docs = after, out
    assert packing.PIECES.startswith("doc_id")
