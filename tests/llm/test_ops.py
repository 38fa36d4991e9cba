import datetime
import hashlib
import random
import re
import struct
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readweft.llm import op1_mixing as op1
from readweft.llm import op2_urls as op2
from readweft.llm import op3_neighbours as op3
from readweft.llm import op4_quality as op4
from readweft.llm import op5_sharding as op5
from readweft.llm import op6_bpe as op6
from readweft.llm import op7_near_dedup as op7
from readweft.llm import op8_substrings as op8
from readweft.llm import op9_line_dedup as op9
from readweft.llm import op10_pii as op10
from readweft.llm.common import components, work_folder
from readweft.llm.hnsw import Graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], schema)


#: Null, empty and blank texts, one very long one, odd white space, and repeats.
ODD = [None, "", " \t\n\x0b", "a", "a b c", "x" * 200_000, "The  cat\r\nsat\x0bon\x85the mat", "é" * 300 + " ü", ("one two three " * 4000).strip(), "a b c", "A B C"]
CLASHES = ["_row", "_text", "_host", "_rule", "rule", "n", "rep", "digest", "key", "component", "h", "t", "u", "whole", "rest", "_key", "_ids", "hits", "_tokens", "kept", "id", "_gone", "_arrival"]


def clashing(df):
    """df with columns whose names operators might use themselves."""
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def kept_columns(out, new):
    return all(out.where(F.col(f"`{c}`") != f"own {c}").isEmpty() for c in CLASHES if c not in new)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), work_folder(spark)).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), work_folder(spark)).isEmpty()


# 1


def test_shares_go_to_siblings_first(spark):
    leaves = [("web", "en", "a", 1000), ("web", "en", "b", 10), ("web", "de", "c", 1000), ("forum", "en", "d", 1000), ("reference", "fr", "e", 0)]
    plan = op1.budgets(spark.createDataFrame(leaves, "_domain string, _lang string, _source string, tokens long"), 100, 1, {"web": 100, "forum": 100}, {"en": 100, "de": 100})
    got = {r._source: r for r in plan.collect()}
    # 3010 of 3010: everything is full
    assert [got[k].budget for k in "abcde"] == [1000, 10, 1000, 1000, 0]
    half = op1.budgets(spark.createDataFrame(leaves, "_domain string, _lang string, _source string, tokens long"), 40, 1, {"web": 100, "forum": 100, "reference": 100}, {"en": 100, "de": 100})
    got = {r._source: r.budget for r in half.collect()}
    # 1204: nothing for e, so 602 each for web and forum; web's halves are 301; b is full with 10 and a has the rest
    assert got == {"a": 291, "b": 10, "c": 301, "d": 602, "e": 0}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(1, 30)), rng.choice(["en", "en", "de", None]), rng.choice(["src0"] * 8 + ["src6", "src9", None]), 0) for k in range(400)]
    rows += [(500, None, "en", "src0", None), (501, "", "en", "src0", 0), (None, "x y", "en", "src0", 0), (1, rows[1][1], rows[1][2], rows[1][3], 0), (502, prose(rng, 30000), "en", "src6", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    out = op1.mixed(df)
    assert kept_columns(out, {"_tokens"}) and out.columns[:5] == df.columns[:5]
    got = out.collect()
    assert all(len(brute.words(r.text)) == r._tokens for r in got)
    read = Counter((r._domain, r._lang, r._source) for r in got)
    assert read and Counter((r.doc_id, r._epoch) for r in got).most_common(1)[0][1] <= 2
    total = sum(len(brute.words(r[1])) for r in rows)
    assert sum(r._tokens for r in got) <= total * op1.PERCENT // 100
    again = op1.mixed(df.repartition(7)).collect()
    assert Counter((r.doc_id, r._epoch) for r in again) == Counter((r.doc_id, r._epoch) for r in got)
    assert {r._epoch for r in got} == {0, 1}
    assert op1.mixed(spark.createDataFrame([], DOCS)).isEmpty()


# 2


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x", "x://example.org/en/1", "x://example.org/en/12?q", "x://org/", "x://org", "x://notorg/", "http://a.b.com/fr/#f",
            "http://com/de/y", "http://example.org:80/es/", "u://" + "a." * 5000 + "com/de/" + "z" * 9000, "x://example.org/es", "x://y.com?/fr/", "a://b://com/fr/", "x://com/fr/\n1"]
    pages = clashing(spark.createDataFrame([(k, u) for k, u in enumerate(urls + urls[4:6])], "page_id long, url string"))
    rules = spark.createDataFrame(op2.RULES, op2.RULES_SCHEMA)

    def plain(u):
        host, path = "", ""
        if u is not None and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.translate(brute.FOLD)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in op2.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    for limit in (op2.BROADCAST_RULES, -1):
        op2.BROADCAST_RULES, before = limit, op2.BROADCAST_RULES
        out = op2.judged(pages, rules)
        got = out.collect()
        op2.BROADCAST_RULES = before
        assert len(got) == len(urls) + 2 and kept_columns(out, {"_host", "_rule"})
        for r in got:
            assert (r._host, r._path, r._rule, r._verdict) == plain(r.url), r.url
    assert {r._verdict for r in op2.judged(pages, rules.limit(0), "block").collect()} == {"block"}
    assert op2.judged(pages.limit(0), rules).isEmpty()
    ties = spark.createDataFrame([("allow", "a.b", "/"), ("block", "b", "/xy"), ("block", "a.b", "/"), ("allow", None, "/")], op2.RULES_SCHEMA)
    assert op2.judged(spark.createDataFrame([("x://a.b/xyz",)], "url string"), ties).first()["_rule"] == "a.b/"
    assert op2.judged(spark.createDataFrame([("x://a.b/xyz",)], "url string"), ties).first()["_verdict"] == "block"


# 3


def exact(ids, x, q, own, k=5):
    s = x @ q / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))
    order = sorted((-round(v, 12), i) for i, v in zip(ids, s, strict=True) if i != own)
    return [i for _, i in order[:k]]


def test_graph_finds_neighbours():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    found = g.search(x[:200], 10, 150)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want, strict=True)]) > 0.95
    assert Graph.of(x, [a.copy() for a in g.flat()]).search(x[:5], 3).tolist() == g.search(x[:5], 3).tolist()
    assert Graph(x[:1]).search(x[:2], 3).tolist() == [[0, -1, -1]] * 2 and Graph(x[:0]).search(x[:2], 2).tolist() == [[-1, -1]] * 2


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[300:700] = x[300]  # a large group of equal vectors
    x[700] = x[300] * 2  # equal direction
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [1.0, None] + [0.0] * 6, 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (2250, [], 0), (2300, [1.0, 2.0], 0), (50, rows[50][1], 0)]
    df = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in op3.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 50))
    ids, full, hit = list(range(1200)), x.astype(np.float64), 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, v, s in found:
            assert s == pytest.approx(full[v] @ full[q] / np.sqrt((full[v] @ full[v]) * (full[q] @ full[q])), abs=1e-12)
        hit += len(set(exact(ids, full, full[q], q)) & {v for _, v, _ in found})
    assert hit >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in got[500]] == [300, 301, 302, 303, 304]  # ties go to smaller ids
    assert op3.nearest(df.limit(0), df.limit(0)).isEmpty()
    # an id with several vectors has the least one, as a candidate and as a query; doubles keep their precision
    many = spark.createDataFrame([(0, [1.0, 1e-9]), (0, [2.0, 0.5]), (0, [1.0, 1e-9]), (0, None), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in op3.nearest(many, many).collect()}
    assert set(found) == {(a, b) for a in range(3) for b in range(3) if a != b} and found[2, 0] == found[0, 2] == 1e-9 / np.sqrt(1 + 1e-18)
    few = df.where("vec_id < 3")
    assert op3.nearest(few, few.where("vec_id = 0")).count() == 2


# 4


def test_statistics():
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["a", "b", "c", "#d", "E!"]) for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) + "x\nx\n \ny" for _ in range(50)]
    got = op4.stats(pa.array(texts))
    for row, text in zip(got.tolist(), texts, strict=True):
        assert tuple(row[:5]) == brute.stats(text)
    old, op4.SLICE_BYTES = op4.SLICE_BYTES, 50
    try:
        assert (op4.stats(pa.array(texts)) == got).all()
    finally:
        op4.SLICE_BYTES = old
    codes = np.array([1, 2, 3, 1, 2, 3, 9, 2, 3])
    assert op4._repeats(codes) == op4._repeats_wide(codes) == 6


def test_forest(spark):
    rng = random.Random(6)
    clean = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) + "." for _ in range(300)]
    junk = [" ".join(f"W{rng.randrange(5000)}!!" for _ in range(80)) for _ in range(60)] + [" ".join(f"w{rng.randrange(5000)} |" for _ in range(80)) for _ in range(60)]
    docs = docs_of(spark, clean + junk + ODD)
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 420, 2)] + [(1, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    forest = op4.fit(docs, labels)
    got = {r.doc_id: r for r in op4.judged(docs, forest).collect()}
    assert sum(got[k].kept for k in range(300)) >= 294 and sum(got[k].kept for k in range(300, 420)) <= 6
    for k, text in enumerate(clean + junk + ODD):
        n, chars, symbols, dup, repeat = brute.stats(text)
        assert tuple(got[k])[1:7] == (n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n)
    own = clashing(docs)
    kept = op4.kept(own, forest)
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    # verdicts: paths walked one by one, and the threshold of the best balance among all that lose few good rows
    x = op4.features(op4.stats(pa.array(clean + junk)))

    def score(row):
        total = 0.0
        for f, cut, left, length in zip(forest.feature, forest.cut, forest.left, forest.length, strict=True):
            at = 0
            while f[at] >= 0:
                at = left[at] + (row[f[at]] >= cut[at])
            total += length[at]
        return 2 ** (-total / 100 / forest.norm)

    scores = [score(r) for r in x]
    assert all(got[k].kept == (s <= forest.threshold) for k, s in enumerate(scores) if not got[k].base_failed)
    own = [(scores[k], k < 300) for k in range(0, 420, 2) if not got[k].base_failed]
    n_good = sum(g for _, g in own)
    balance = lambda t: (sum(s > t for s, g in own if not g) / max(len(own) - n_good, 1) - sum(s > t for s, g in own if g) / n_good, sum(s > t for s, g in own if g))
    fine = [balance(t)[0] for t, _ in own if balance(t)[1] <= 0.003 * n_good]
    assert balance(forest.threshold)[1] <= 0.003 * n_good and balance(forest.threshold)[0] == max(fine)
    # labels of other documents do not use up the sample, and repeated ids and labels count once
    many = labels.unionByName(labels).unionByName(spark.range(10**6, 10**6 + 8000).selectExpr("id as doc_id", "1 as quality", "0 as toxic"))
    assert {tuple(r) for r in op4.labelled(docs, many, 210).select("doc_id", "quality").collect()} == {(k, int(k < 300)) for k in range(0, 420, 2)}
    assert (op4.fit(docs.unionByName(docs), many, 210).threshold, op4.labelled(docs, many, 7).count()) == (forest.threshold, 7)
    nothing = op4.fit(docs, labels.limit(0))
    assert nothing is None and {r.kept == (not r.base_failed) for r in op4.judged(docs, nothing).collect()} == {True}
    assert op4.judged(docs.limit(0), forest).isEmpty() and op4.fit(docs.limit(0), labels) is None


# 5


def test_compaction(spark):
    rng = random.Random(7)
    store = op5.Store(spark, work_folder(spark), target=4000, fan=3, least=100)
    rows = [(k, prose(rng, rng.randrange(0, 40))) for k in range(600)] + [(3, None), (3, ""), (None, "x"), (7, "long " * 3000)]
    df = spark.createDataFrame([(*r, k % 7) for k, r in enumerate(rows)], "doc_id long, text string, a int")
    df = df.withColumns({"_run": F.lit("own"), "_shard": F.lit("own"), "_metadata": F.lit("own"), "name": F.lit("own"), "path": F.lit("own")})
    names = store.staged(df, "a")
    assert len(names) == 7 and store.versions() == []
    sizes, layout = [], []  # of the runs, oldest first: bytes and shards; and what the tiers make of them
    for k in range(7):
        own = [r for i, r in enumerate(rows) if i % 7 == k]
        m = store.append(store.manifest(), names[k], sum(len(t or "") for _, t in own), len(own), df.drop("a").schema)
        store.commit(m)
        with pytest.raises(op5.Conflict):
            store.commit(m)
        before = store.manifest()
        layout.append((m["runs"][-1]["bytes"], m["runs"][-1]["shards"]))
        store.compact()
        layout = brute.compacted(layout, 4000, 3, 100, store.most)
        now = store.manifest()
        assert [r["bytes"] for r in now["runs"]] == [b for b, _ in layout] and all(r["shards"] <= n for r, (_, n) in zip(now["runs"], layout, strict=True))
        layout = [(r["bytes"], r["shards"]) for r in now["runs"]]
        found = store.rows(run="_place", shard="_file").collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter(r for i, r in enumerate(rows) if i % 7 <= k)
        assert all(r._run == r._shard == r._metadata == r.name == r.path == "own" for r in found)
        for i, r in enumerate(now["runs"]):
            files = {x._file for x in found if x._place == i}
            assert len(files) == r["shards"] and sum(len((x.text or "").encode()) for x in found if x._place == i) == r["bytes"]
        assert store.rows(before["version"]).count() == len(found) and now["version"] >= before["version"]  # old versions can be read
    m = store.manifest()
    assert not store.picks(m) and sum(r["rows"] for r in m["runs"]) == len(rows)
    full = [r for r in m["runs"] if store.tier(r) is None]
    assert full and all(2 * r["bytes"] / r["shards"] >= 4000 for r in full)
    assert store.versions() == list(range(1, m["version"] + 1)) and store.manifest(0)["runs"] == []
    store.expire(2)
    assert store.versions() == [m["version"] - 1, m["version"]] and store.rows().count() == store.rows(m["version"] - 1).count() == len(rows)
    assert op5.Store(spark, work_folder(spark)).rows().isEmpty()


def test_sharding_query(spark, tmp_path):
    docs_of(spark, ODD * 5).write.parquet(str(tmp_path / "documents.parquet"))
    got = op5.op5_sharding(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(5 * len(ODD))) and sum(r.n_bytes for r in got) == 5 * sum(len((t or "").encode()) for t in ODD)
    docs_of(spark, ODD).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert op5.op5_sharding(spark, str(tmp_path / "none")).isEmpty()


# 6


@pytest.fixture(scope="module")
def reference():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(op6.default_path())


def test_automaton_is_bpe():
    """Random small merge lists against merging by rank."""
    rng = random.Random(8)
    for trial in range(400):
        labels, pairs, merges = [b"a", b"b", b"c"], set(), []
        for _ in range(rng.randrange(1, 12) if trial else 0):
            u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[u] + labels[v] not in labels and (u, v) not in pairs:
                pairs.add((u, v))
                merges.append((u, v, len(labels)))
                labels.append(labels[u] + labels[v])
        if not trial:  # the second merge can never be made after the first, nor the third
            labels, merges = [b"a", b"b", b"c", b"bc", b"ab", b"abc"], [(1, 2, 3), (0, 1, 4), (4, 2, 5)]
        ranks = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}

        def merged(word):
            own = [labels.index(bytes([c])) for c in word]
            while found := [(ranks[p][0], i) for i, p in enumerate(zip(own, own[1:], strict=False)) if p in ranks]:  # noqa: B023
                k, _ = min(found)
                u, v, w = merges[k]  # noqa: B023
                out, i = [], 0
                while i < len(own):
                    step = own[i : i + 2] == [u, v]
                    out.append(w if step else own[i])
                    i += 1 + step
                own = out
            return own

        a = op6.Automaton(labels, merges, {ord("a"): 0, ord("b"): 1, ord("c"): 2})
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            assert a.encode(word) == merged(word), (merges, word)
    with pytest.raises(ValueError, match="order"):
        op6.Automaton([b"a", b"b", b"c", b"ab", b"abc"], [(3, 2, 4), (0, 1, 3)], {97: 0, 98: 1, 99: 2})


def test_tokens_match(reference):
    t, rng = op6.tokenizer(op6.default_path()), random.Random(9)
    parts = ["a", "b", "'", "'s", "ve", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", "　", "\x1c", "​", "1", "²", "Ⅷ", "é", "ß", "日本", "🙂", "_", "!!", "<|endoftext|>", "́", "ا", "ing", "The", "\x00", "\U00020000"]
    texts = [x or "" for x in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for x in texts:
        want = reference.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == want and t.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_token_query(spark, reference):
    texts = [*ODD, "<|endoftext|> twice <|endoftext|>"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in op6.digests(docs).collect()}
    for k, x in enumerate(texts):
        ids = reference.encode(x or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert tuple(got[k]) == (k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    own = clashing(docs)
    both = op6.decoded(op6.encoded(own))
    assert kept_columns(both, {"_ids"}) and all(r._decoded == (r.text or "") for r in both.collect())
    assert op6.digests(docs.limit(0)).isEmpty() and op6.tokenised(docs).count() == len(texts)


# 7


def varied(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(10)
    base, other = prose(rng, 150, 10**6), prose(rng, 60, 10**6)
    texts = ODD + [base] * 30 + [varied(rng, base, rng.randrange(8)) for _ in range(150)] + [varied(rng, other, rng.randrange(4)) for _ in range(40)]
    texts += [prose(rng, rng.randrange(1, 40)) for _ in range(60)] + [base + " " + prose(rng, 150, 10**6) for _ in range(20)] + [other.upper(), other.replace(" ", "\n"), "one two three four", "One  two three four"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3 + 1, texts[k]) for i, k in enumerate(order)]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS))
    got = {r.doc_id: r for r in op7.near_duplicates(df).collect()}
    want = brute.near(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())
    out = op7.deduplicated(df.unionByName(df.limit(5)).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept_columns(out, set()) and out.columns == df.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert out.where("doc_id is null").count() == 1
    assert op7.near_duplicates(df.limit(0)).isEmpty()


def test_estimates():
    rng = np.random.default_rng(11)
    for share in (0.0, 0.5, 0.75, 1.0):
        both, only = rng.integers(0, 1 << 63, int(600 * share)), rng.integers(0, 1 << 63, 1200)
        a, b = (np.concatenate([both, only[k::2][: 600 - len(both)]]).astype(np.uint64) for k in (0, 1))
        sig = op7.packed(op7.minima(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), op7.HASHES, op7.SIGNED))
        true = len(both) / (len(a) + len(b) - len(both))
        assert abs(float(op7.estimates(sig[0], sig[1])) - true) < op7.MARGIN


# 8


def test_chains():
    at, ref = np.array([0, 5, 10, 12, 40, 45, 50]), np.array([100, 105, 110, 3, 145, 150, 155])
    found = op8.chains(at, ref)
    assert [list(c) for c in found] == [[0, 1, 2, 4, 5, 6]]
    assert op8.chains(np.array([], int), np.array([], int)) == []
    tree, best = op8.Fenwick(50), {}
    rng = random.Random(12)
    for k in range(400):
        r, s = rng.randrange(1, 51), rng.random()
        tree.put(r, s, k)
        best[r] = max(best.get(r, (-1e18, -1)), (s, k))
        q = rng.randrange(0, 51)
        assert tree.upto(q) == max((v for r, v in best.items() if r <= q), default=(-1e18, -1))


def test_chains_are_cut(spark):
    """Passages in the same order in both texts, with other words between them, have a row each."""
    rng = random.Random(14)
    own = lambda n: prose(rng, n, 10**6)
    texts, want = [], []
    for gap, other in ((60, 60), (100, 200), (200, 200), (400, 300)):
        a, b, at = own(60), own(60), len(texts)
        texts += [f"{a} {own(gap)} {b}", f"{own(9)} {a} {own(other)} {b}"]
        want += [(at + 1, 9, 69, at, 0, 60, 60), (at + 1, 69 + other, 129 + other, at, 60 + gap, 120 + gap, 60)]
    assert sorted(map(tuple, op8.repeated_passages(docs_of(spark, texts)).collect())) == want


def pairs_with_rows(spark, texts):
    return {(r.doc_id, r.ref_doc_id) for r in op8.repeated_passages(docs_of(spark, texts)).collect()}


def test_parts_that_stand_alone(spark):
    """A passage whose parts are in other texts too, before and after its own two."""
    rng = random.Random(16)
    own = lambda n: prose(rng, n, 10**6)
    texts, want = [], set()
    for sizes in ((30, 30), (40, 40), (20, 20, 20), (30, 30, 30)) * 5:
        parts = [own(n) for n in sizes]
        alone, at = [f"{own(20)} {p} {own(20)}" for p in parts], len(texts) + len(parts)
        texts += [*alone, f"{own(40)} {' '.join(parts)} {own(9)}", f"{own(9)} {' '.join(parts)} {own(40)}", *alone]
        want.add((at + 1, at))
    assert want <= pairs_with_rows(spark, texts)


def test_worn_passages(spark):
    """Passages with 10 % of their words replaced."""
    rng = random.Random(17)
    own = lambda n: prose(rng, n, 10**6).split(" ")
    texts, want = [], set()
    for n in (60, 100, 200) * 10:
        passage = own(n)
        worn = passage.copy()
        for k in rng.sample(range(n), n // 10):
            worn[k] = "changed"
        want.add((len(texts) + 1, len(texts)))
        texts += [" ".join(own(40) + passage + own(40)), " ".join(own(40) + worn + own(40))]
    assert want <= pairs_with_rows(spark, texts)


def test_segments_are_whole():
    """Every stretch of 50 words from an equal one to an equal one, 80 % of them equal, shares words with a passage of a random
    alignment, and all passages are such."""
    rng = random.Random(15)
    for _ in range(300):
        runs = []
        for _ in range(rng.randrange(1, 12)):
            n = rng.choice([1, 3, 8, 30, 60])
            runs += [(n, n, n), rng.choice([(1, 1, 0), (0, 2, 0), (3, 0, 0), (9, 7, 0), (20, 20, 0)])]
        got = op8.segments(runs)
        edges, x, y, e = [], 0, 0, 0
        for a, b, same in runs:
            edges.append((x, y, e))
            x, y, e = x + a, y + b, e + same
        edges.append((x, y, e))
        alike = lambda long, ref, same: long >= 50 and same >= 0.8 * max(long, ref)
        assert all(alike(z - a, rz - ra, same) for a, ra, z, rz, same in got)
        assert all(p[2] <= q[0] for p, q in zip(got, got[1:], strict=False))
        for i, s in list(enumerate(edges))[:-1:2]:
            for t in edges[i + 1 :: 2]:
                if alike(t[0] - s[0], t[1] - s[1], t[2] - s[2]):
                    assert any(a < t[0] and s[0] < z for a, _, z, _, _ in got)


def test_passages(spark):
    rng = random.Random(13)
    own = lambda n: prose(rng, n, 10**6)
    passage, fuzzy = own(70), own(120)
    worn = fuzzy.split(" ")
    for k in (30, 61, 90):
        worn[k] = "changed"
    texts = ODD + [own(200) for _ in range(20)]
    at = len(texts)
    texts += [own(30) + " " + passage + " " + own(20), passage.upper() + " " + own(40), own(5) + "\n" + passage]
    texts += [own(50) + " " + fuzzy + " " + own(9), own(10) + " " + " ".join(worn[:50]) + " inserted " + " ".join(worn[50:])]
    texts += [own(40) + " " + own(30).join(["", ""]) + " ".join(passage.split(" ")[:20]) + " " + own(40)]
    df = clashing(docs_of(spark, texts))
    got = {}
    for r in op8.repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[at + 1] == [(0, 70, at, 30, 100, 70)]  # rows lead to earlier places only
    assert got[at + 2] == [(5, 75, at, 30, 100, 70)]
    (s, e, ref, rs, re_, n), = got[at + 4]
    assert (s, e, ref, rs, re_) == (10, 131, at + 3, 50, 170) and n == 117
    assert set(got) <= {at + 1, at + 2, at + 4, *range(len(ODD))}  # clean documents have none
    assert op8.repeated_passages(df.limit(0)).isEmpty()


def test_every_exact_run_is_covered(spark):
    """Against all runs of 50 words: pieces of a pool in any order, also alone, twice in one text, in circles, and of one word."""
    rng = random.Random(18)
    pool = [prose(rng, rng.choice([20, 45, 48, 50, 51, 70, 120]), 10**6) for _ in range(25)] + ["la " * 70, "do re mi fa " * 40, prose(rng, 9, 10**6) + " "]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            piece = rng.choice(pool).split()
            cut = rng.choice([0, 0, 0, rng.randrange(len(piece))])
            parts += piece[cut : rng.choice([len(piece), len(piece), cut + 46])] * rng.choice([1, 1, 1, 9])
            parts += prose(rng, rng.choice([0, 0, 3, 30]), 10**6).split()
        texts.append(" ".join(parts))
    passage = prose(rng, 120, 10**6).split()  # pieces of 45 words that overlap stand alone before and after the two texts with all of it
    alone = [" ".join(passage[k : k + 45]) + " " + prose(rng, 30, 10**6) for k in range(0, 76, 5)]
    at = len(texts) + len(alone)
    texts += [*alone, " ".join(passage), *alone, prose(rng, 20, 10**6) + " " + " ".join(passage), *alone]
    texts += [prose(rng, 60, 10**6) + " " + " ".join(passage[:80] + ["x"] + passage[:80])]
    rows = op8.repeated_passages(docs_of(spark, texts)).collect()
    assert any(r.doc_id == at + len(alone) + 1 and r.ref_doc_id == at for r in rows)
    brute.check_passages(texts, rows)


def worn(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return words


def test_worn_passages_whose_parts_stand_before(spark):
    """Each seed that two texts share stands first in a text of its own, so that none of them leads from one to the other."""
    rng = random.Random(20)
    own = lambda n: prose(rng, n, 10**6).split(" ")
    texts, want = [], set()
    for n in (60, 90, 120, 200) * 3:
        passage = own(n)
        texts += [" ".join(own(20) + passage[k : k + 16] + own(20)) for k in range(0, n, 5)]
        want.add((len(texts) + 1, len(texts)))
        texts += [" ".join(own(30) + passage + own(30)), " ".join(own(9) + worn(rng, passage, n // 12) + own(50))]
    assert want <= pairs_with_rows(spark, texts)


def all_passages(texts):
    """(document, ref, start, stop, ref start, ref stop) of the passages of all pairs of documents, from all seeds that both have."""
    at, word = op8.hashed_words(pa.array(texts))
    place, got = op8.minimizers(word, at)
    text = np.searchsorted(at, place, "right") - 1
    fine = op8._kinds(text, place, got) != op8.AGAIN
    place, got, text, low = (place - at[text])[fine], got[fine], text[fine], (word >> np.uint64(33)).astype(np.int32)
    seeds = [list(zip(got[text == k].tolist(), place[text == k].tolist(), strict=True)) for k in range(len(texts))]
    out = []
    for d in range(len(texts)):
        for r in range(d):
            there = {}
            for h, y in seeds[r]:
                there.setdefault(h, []).append(y)
            ties = sorted((x, y) for h, x in seeds[d] for y in there.get(h, ()))
            x, y = (np.array([t[k] for t in ties], int) for k in (0, 1))
            for chain in op8.chains(x, y) if len(ties) >= op8.MIN_SEEDS else ():
                p, q = x[chain], y[chain]
                cut = low[at[d] : at[d + 1]][max(0, p[0] - op8.REACH) : p[-1] + op8.KMER + op8.REACH]
                out += [(d, r, s, e, rs, re_) for s, e, rs, re_, _ in op8.aligned(int(p[0]), int(q[0]), p.tolist(), q.tolist(), cut, low[at[r] : at[r + 1]])]
    return out


def test_every_worn_passage_is_linked(spark, monkeypatch):
    """Against the chains of all pairs of texts: worn lines of a few pools, pieces of them, and lines that many texts have."""
    monkeypatch.setattr(op8, "BLOCK", 16)
    rng = random.Random(21)
    own = lambda n: prose(rng, n, 10**6).split()
    pool, lines = [own(rng.choice([40, 60, 90, 150])) for _ in range(8)], [own(n) for n in (7, 13, 20, 30)]
    texts = []
    for _ in range(160):
        parts = own(rng.choice([0, 10, 40]))
        for _ in range(rng.randrange(1, 4)):
            piece = rng.choice(pool)
            if rng.random() < 0.6:
                cut = rng.randrange(len(piece))
                piece = piece[cut : cut + rng.choice([16, 30, 60])]
            parts += worn(rng, piece, int(len(piece) * rng.choice([0, 0.05, 0.1, 0.15]))) + own(rng.choice([0, 3, 30]))
            parts += rng.choice(lines) + own(rng.choice([0, 5, 40]))
        texts.append(" ".join(parts))
    rows = op8.repeated_passages(docs_of(spark, texts)).collect()
    meets = lambda a, b, c, d: a < d and c < b
    refs = lambda d, s, e: [(d, s, e)] + [(r.ref_doc_id, r.ref_start_word, r.ref_end_word) for r in rows if r.doc_id == d and meets(r.start_word, r.end_word, s, e)]
    wanted = all_passages(texts)
    assert len(wanted) > 300
    for d, r, s, e, rs, re_ in wanted:
        there = refs(r, rs, re_)
        assert any(a[0] == b[0] and meets(*a[1:], *b[1:]) for a in refs(d, s, e) for b in there), (d, r, s, e, rs, re_)


def test_passages_of_repeated_ids(spark):
    """Of rows that repeat an id the least text counts; rows that repeat as a whole count once."""
    rng = random.Random(19)
    a, b = prose(rng, 80, 10**6), prose(rng, 80, 10**6)
    rows = [(1, "b " + a), (1, "a " + b), (1, "a " + b), (2, a), (2, a), (3, b), (None, b), (None, b)]
    got = op8.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 80, 1, 1, 81, 80)]


# 9


def test_lines(spark):
    rng = random.Random(14)
    rows = [(rng.choice(["h1", "h1", "h1", "h2", None]), "\n".join(rng.choice(["Home", "About us", "", " ", f"line {rng.randrange(10**6)}", f"line {rng.randrange(40)}"]) for _ in range(8))) for _ in range(300)]
    rows += [("h1", None), ("h1", ""), ("h3", "Home"), ("h1", "Home\nHome"), ("h1", "x " * 100_000), rows[0]]
    df = clashing(spark.createDataFrame([(k, t, "en", h, 0) for k, (h, t) in enumerate(rows)], DOCS))
    want = brute.without_boilerplate(rows)
    for limit in (op9.BROADCAST_LINES, -1):
        op9.BROADCAST_LINES, before = limit, op9.BROADCAST_LINES
        out = op9.cleaned(df)
        got = {r.doc_id: r for r in out.collect()}
        op9.BROADCAST_LINES = before
        assert kept_columns(out, {"_text"}) and len(got) == len(rows)
        for k, (_, t) in enumerate(rows):
            assert got[k]._text == want[k] and got[k]._lines == (0 if t is None else t.count("\n") + 1)
    assert any(r._dropped for r in got.values()) and op9.cleaned(df.limit(0)).isEmpty()


# 10


def replaced(spark, texts):
    return [tuple(r) for r in op10.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string"), "k").select("_text", "_found").collect()]


def cards(n):
    found, k = [], 4 * 10**15
    while len(found) < n:
        k += 7919
        if brute.luhn(str(k)):
            found.append(str(k))
    return found


@pytest.mark.parametrize(
    ("values", "fine"),
    [
        (cards(600), lambda x: len(x) == 16 and brute.luhn(x)),
        ([(datetime.date(1800, 1, 1) + datetime.timedelta(243 * k)).isoformat() for k in range(600)], lambda x: 1800 <= datetime.date.fromisoformat(x).year <= 2199),
        ([f"+1 ({200 + k % 800}) {200 + k * 7 % 800}-{k * 13 % 10000:04d}" for k in range(600)], lambda x: re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x)),
        ([f"{k % 665 + 1:03d}-{k % 99 + 1:02d}-{k * 3 % 9999 + 1:04d}" for k in range(600)] + ["667-01-0001", "899-99-9999"], lambda x: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x)),
        ([f"{k % 256}.{k * 3 % 256}.{k * 5 % 256}.{k // 256}" for k in range(600)], lambda x: all(0 <= int(o) < 256 for o in x.split("."))),
    ],
)
def test_permutations(spark, values, fine):
    got = [t for t, _ in replaced(spark, values)]
    assert len(set(got)) == len(values) and all(map(fine, got)) and sum(a == b for a, b in zip(values, got, strict=True)) <= 2


def test_phones_of_any_area(spark):
    values = [f"+1 ({k * 37 % 1000:03d}) {k * 7 % 1000:03d}-{k * 13 % 10000:04d}" for k in range(1000)]
    values += ["+1 (017) 555-7713", "000-000-0000", "199 999 9999", "999.199.9999", "(200) 000-0000", "1-200-200-0000"]
    got = replaced(spark, values)
    number = lambda x: re.sub("[^0-9]", "", x)[-10:]
    dialled = lambda x: number(x)[0] >= "2" and number(x)[3] >= "2"
    assert all(n == 1 for _, n in got) and len({number(x) for x, _ in got}) == len({number(x) for x in values})
    for v, (x, _) in zip(values, got, strict=True):
        assert v != x and re.sub("[0-9]", "0", v) == re.sub("[0-9]", "0", x) and dialled(v) == dialled(x)


def test_feistel_is_a_permutation(spark):
    got = spark.range(7 * 11).select(op10.permuted("x", "k", F.col("id"), 7, 11)).collect()
    assert sorted(r[0] for r in got) == list(range(77))


def test_pii(spark):
    card = "4111111111111111"
    (new, n), = replaced(spark, [card])
    assert n == 1 and brute.luhn(new)
    texts = [None, "", "4111111111111112", "2023-02-30", "666-12-1234", "300.1.1.1", "01.2.3.4", "1.2.3.4.5", "v2.0.1 2.0.", "1" * 24, "plain words, 12 of them"]
    assert replaced(spark, texts) == [(t, 0) for t in texts]
    spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert replaced(spark, [f"a {card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}!", f"{card} " * 3000]) == [(f"a {new}, {spaced}!", 2), (f"{new} " * 3000, 3000)]
    (dates, n), = replaced(spark, ["2023-02-28 28.02.2023 02/28/2023"])
    a, b, c = dates.split(" ")
    y, m, d = a.split("-")
    assert n == 3 and b == f"{d}.{m}.{y}" and c == f"{m}/{d}/{y}" and a != "2023-02-28"
    (mail, n), = replaced(spark, ["Write to jo.doe-1@mail2.example.com."])
    assert n == 1 and re.fullmatch(r"Write to u[0-9a-f]{32}@mail2\.example\.com\.", mail)
    df = clashing(docs_of(spark, [*ODD, card]))
    out = op10.pseudonymised(df, "k")
    assert kept_columns(out, {"_text"}) and [r._text for r in out.orderBy("doc_id").collect()] == [*ODD, new] and op10.pseudonymised(df.limit(0), "k").isEmpty()


def test_pii_against_a_plain_version(spark):
    """Every kind at random, valid or not, in every surrounding; and what each kind looks like at its edges."""
    rng = random.Random(20)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    issued = ["4", "51", "27", "34", "36", "35", "62", "50"]

    def card():
        body = rng.choice([*issued, digits(2)]) + digits(rng.randrange(10, 17))
        body += rng.choice([str(-sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(body[::-1])) % 10), digits(1)])
        cut = rng.choice([(4, 4, 4, 9), (4, 6, 5, 0), (99, 0, 0, 0)])
        at, parts = 0, []
        for n in cut:
            parts.append(body[at : at + n])
            at += n
        return rng.choice(" -").join(x for x in parts if x)

    kinds = [
        card, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{rng.choice(['19', '20', '17'])}{digits(2)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}",
        lambda: f"{rng.randrange(33):02d}.{rng.randrange(14):02d}.19{digits(2)}", lambda: f"{rng.randrange(14):02d}/{rng.randrange(33):02d}/20{digits(2)}",
        lambda: f"{rng.choice(['a.b', 'Jo', 'x+y'])}{digits(1)}@{rng.choice(['mail', 'x-y.z'])}.{rng.choice(['org', 'co', 'x'])}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([39, 40, 40, 40, 41]))), lambda: digits(rng.randrange(1, 30)), lambda: "word",
    ]
    around = [" ", " ", ", ", "\n", ": ", "='", "' ", '"', ".", "-", "_", "(", ")", "T10:00:00Z ", "é", "x"]
    texts = ["".join(rng.choice(kinds)() + rng.choice(around) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts += [f'key="{"deadbeef" * 5}"', f"token='{'abcdefabcd' * 4}' 11", "2024-05-01T10:00:00Z", "3782-822463-10005", "3782 822463 10005 x", "1234567890128", "4222222222222", "a@b.co", "1.2.3.4"]
    want = [brute.pseudonymised(t, "k") for t in texts]
    assert replaced(spark, texts) == want
    assert [n for _, n in want[-9:]] == [1, 1, 1, 1, 1, 0, 1, 1, 1] and sum(n for _, n in want) > 3000


def test_schema_of_results(spark, tmp_path):
    """The contracts' columns and kinds."""
    docs_of(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long, text, yes = T.LongType(), T.StringType(), T.BooleanType()
    for f, want in (
        (op4.op4_quality_rules, {"doc_id": long, "n_words": long, "word_chars": long, "n_symbols": long, "n_dup_lines": long, "n_repeat_words": long, "base_failed": yes, "kept": yes}),
        (op6.op6_bpe, {"doc_id": long, "n_tokens": long, "ids_sha256": text, "decoded_sha256": text}),
        (op7.op7_minhash_near_dedup, {"doc_id": long, "n_shingles": long, "component_id": long, "kept": yes}),
    ):
        out = f(spark, str(tmp_path))
        assert {c.name: c.dataType for c in out.schema} == want and out.count() == len(ODD)
