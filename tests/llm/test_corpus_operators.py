"""Operators that relate texts or rows to each other, against brute force."""

import collections
import math
import random
import zlib

import numpy as np

from pricelens.llm import components, minhash_dedup, ngram_lm, voronoi_topk, warc


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, num):
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


def near_texts(seed=1):
    """Groups of copies with few and many edits, chains, exact copies, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    shared, rows = [word() for _ in range(40)], []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([30, 120]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
        for _ in range(5):  # each an edit further
            base = [word() if rng.random() < 0.02 else x for x in base]
            rows.append(" ".join(base))
    rows += [" ".join(shared + [word() for _ in range(30)]) for _ in range(30)]
    rows += ["one", "ONE", "one two", "", None, "   ", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_lose_no_link(spark):
    for size, num, seed in ((3, 85, 1), (5, 80, 2)):
        rows = near_texts(seed)
        want, sets = brute_components(rows, size, num)
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(4)
        got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df, size=size, num=num).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_without_chance_and_by_sql(spark, tmp_path):
    import duckdb

    rows = near_texts(3) + [(1000, "w " * 30_000)]
    want, sets = brute_components(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    exact = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, size=3, num=85, exact=True).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert exact == {i: (len(sets[i]), want[i], want[i] == i) for i in want} == {i: (n, c, k) for i, n, c, k in con.execute(minhash_dedup.OP8_SQL).fetchall()}


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "e f g")], "doc_id long, text string")
    got = sorted(minhash_dedup.near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (0, 4, False), (4, 4, True), (4, 4, True)]
    assert minhash_dedup.near_duplicates(df.filter("false")).collect() == []


def test_matches_counts_equal_bytes(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (50, 64), dtype=np.uint8), rng.integers(0, 4, (50, 64), dtype=np.uint8)
    rows = [(x.view("<i8").tolist(), y.view("<i8").tolist(), int((x == y).sum())) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.filter(minhash_dedup.matches(df["a"], df["b"]) != df["n"]).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lm(rows):
    """Plain dictionaries of all n-grams."""
    words = {i: (t or "").encode().lower().split() + [" end"] for i, t in rows}
    train = [i for i in words if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in words[i])
    total, types = sum(count.values()), len(count)
    threes = lambda ws: list(zip(["begin", "begin", *ws], ["begin", *ws], ws))
    c3 = collections.Counter(g for i in train for g in threes(words[i]))
    c2, c1 = collections.Counter(), collections.Counter()
    for (_, b, c), n in c3.items():
        c2[b, c] += n if b == "begin" else 1
    for _, c in c2:
        c1[c] += 1
    d3, d2, d1 = ((0, *ngram_lm.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)])) for x in (c3, c2, c1))
    t3, b3, t2, b2 = (collections.Counter() for _ in range(4))
    for (a, b, _), n in c3.items():
        t3[a, b] += n
        b3[a, b] += d3[min(n, 3)]
    for (b, _), n in c2.items():
        t2[b] += n
        b2[b] += d2[min(n, 3)]
    n1 = sum(c1.values())
    rest = sum(d1[min(n, 3)] for n in c1.values()) / n1 / (len(c1) + 1)

    def p(a, b, c):
        x = max(c1[c] - d1[min(c1[c], 3)], 0) / n1 + rest
        x = max(c2[b, c] - d2[min(c2[b, c], 3)], 0) / t2[b] + b2[b] / t2[b] * x if t2[b] else x
        return max(c3[a, b, c] - d3[min(c3[a, b, c], 3)], 0) / t3[a, b] + b3[a, b] / t3[a, b] * x if t3[a, b] else x

    some = rows[3][1].encode().lower().split()
    for a, b in (("begin", "begin"), ("begin", some[0]), (some[0], some[1]), (b"never", some[1]), (b"never", b"heard")):
        assert math.isclose(sum(p(a, b, c) for c in [*count, b"unknown"]), 1)  # one outcome besides the training words
    out = {}
    for i, ws in words.items():
        s = sum(math.log10(p(*g)) for g in threes(ws))
        out[i] = (len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws), s)
    return out


def lm_rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(2, 60)), f"once{i}", "after"])) for i in range(150)]
    return rows + [(500, None), (501, "unheard-of É e"), (502, ""), (None, "w1 w2"), (503, "w0 w1 " * 3000)]


def same_scores(got, rows):
    want = brute_lm(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and math.isclose(r.base_score, w[3], rel_tol=1e-9, abs_tol=1e-8) and math.isclose(r.score, w[4], rel_tol=1e-9, abs_tol=1e-8), r.doc_id
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_language_model_against_plain_counts(spark):
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    same_scores(ngram_lm.ngram_lm(df).collect(), rows)


def test_language_model_in_many_shards_with_spread_words(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 5 = 1, false) held_out", "encode(text, 'UTF-8') raw")
    model = ngram_lm.train(docs.filter("NOT held_out"), shard_tokens=300)  # words seen more than 64 times are spread
    assert model.shards >= 16
    same_scores(ngram_lm.lm_score(docs, model).collect(), rows)


def test_repeated_rows_count_each(spark):
    rows = [(i, f"a b c{i % 3}") for i in range(20)]
    score = lambda rs: {r.doc_id: r.score for r in ngram_lm.ngram_lm(spark.createDataFrame(rs, "doc_id long, text string")).collect()}
    assert score(rows + [(2, "a b c2")] * 30)[2] > score(rows)[2]
    assert ngram_lm.ngram_lm(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(5, "a b")], "doc_id long, text string")  # held out
    held = zlib.crc32(b"5") % 5
    (r,) = ngram_lm.ngram_lm(df, held=held).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def brute_topk(rows, k=10):
    """Over rows, repeated ones each a candidate, in Python's integers."""
    whole = lambda v: [math.floor(float(np.float32(x)) * 1024) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def topk(df, k=10):
    return sorted(tuple(r) for r in voronoi_topk.voronoi_topk(df, lambda i: i % 100 == 0, k).collect())


def test_topk_is_exact_and_sends_little(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(12)] + 0.05 * rng.normal(size=8)).astype("float32").tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(40)] + [(5007, rows[0][1])] * 25  # ties, repeated rows
    rows += [(6000, None), (6100, [float("nan")] * 8), (6200, [None] * 8), (6300, [1.0, 2.0]), (6400, []), (6500, [0.0] * 8), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    monkeypatch.setattr(voronoi_topk, "QUERIES_A_GROUP", 5)
    monkeypatch.setattr(voronoi_topk, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(voronoi_topk, "HOME_ROWS", 40)
    assert topk(df) == brute_topk(rows)
    # the empty and the zero vector need every row, so without them
    sent, asked = voronoi_topk.voronoi_parts(df.filter("vec_id < 6000"), lambda i: i % 100 == 0, 10, "vec_id", "embedding", 1024)
    groups = asked.select("group").distinct().count()
    share = sent.count() / (len(rows) * groups)
    print(f"rows sent: {share:.3f} of all to each of {groups} groups")
    assert groups > 4 and share < 0.3


def test_topk_of_huge_components(spark):
    rng = np.random.default_rng(10)
    size = lambda i: 10.0 ** rng.integers(-3, 5 if i % 3 else 3)
    rows = [(i, (rng.normal(size=4) * size(i)).astype("float32").tolist()) for i in range(0, 600, 4)]
    rows += [(800, [2.0**21] * 3), (801, [2.0**20] * 3), (900, [1.0, 1e6, 0.0]), (902, [1e6, -1e-5, 0.0])]
    assert topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3) == brute_topk(rows, 3)
    import pytest

    with pytest.raises(Exception, match="beyond a long"):
        topk(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>"))


def test_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in voronoi_topk.voronoi_topk(df, lambda i: i % 100 == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert voronoi_topk.voronoi_topk(df.filter("false"), lambda i: i % 100 == 0).collect() == []


def test_warc_round_trip(spark, tmp_path):
    """Against the SQL, with repeated rows, tied ids and null ids; and every payload back."""
    import duckdb

    pages = [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "same"), (3, "http://a/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "z" * 300_000), (None, "n", "same"), (3, "http://a/\r\nX: y", "same"), (3, "v", "same"), (None, None, "alone"), (None, None, "alone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(warc.OP6_SQL).fetchall(), key=str)
    assert len(want) == len(pages)
    assert sorted((tuple(r) for r in warc.op6_warc(spark, str(tmp_path)).collect()), key=str) == want
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.read.parquet(f"{tmp_path}/pages.parquet"), path, least=10)
    nested = warc.assemble(warc.read_warc(spark, path)).collect()
    assert all(r.response.type == "response" and r.request.type == "request" and r.metadata.type == "metadata" for r in nested)
    text = lambda p: (p[2] or "").encode()
    assert sorted(bytes(r.response.payload) for r in nested) == sorted(text(p) for p in pages)
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    assert warc.op6_warc(spark, empty).collect() == []


def test_warc_reads_plain_files_and_tells_what_is_damaged(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(whole + b"no record\r\n" + whole.replace(b"<m>", b"<n>") + whole[:-9])
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r.record_id, r.type, r.block_bytes) for r in rows] == [("<m>", "metadata", 6), (None, "damaged", 11), ("<n>", "metadata", 6), (None, "damaged", 1)]
    got = warc.assemble(warc.read_warc(spark, f"file://{tmp_path}")).collect()
    assert sorted(r.transaction for r in got) == ["<m>", "<n>"] and all(r.response is None and r.request is None for r in got)
    import gzip

    (tmp_path / "z").mkdir()
    (tmp_path / "z/y.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole * 500)[:-30])
    assert warc.read_warc(spark, f"file://{tmp_path}/z").filter("type = 'damaged'").count() == 1
