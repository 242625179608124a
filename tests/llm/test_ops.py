"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloam.llm import ann, bpe, html_extract, langid, license_scan, minhash, mixing, quality, suffix_array, url_filter
from sparkloam.llm.common import Words, prepare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_key", "_comp", "_counts", "_domain", "_epoch", "_tokens", "_lang", "_source", "_row", "_new", "_keep", "_group"]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank, very long and repeated texts, repeated rows, and columns with internal names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "src0", None), (2, "", "en", "src0", 0), (2, "", "en", "src0", 0), (3, " \n\t ", None, None, 3), (None, "one word", "en", "src1", 8), (None, None, None, None, None),
        (4, long, "en", "src2", len(long)), (5, long, "en", "src2", len(long)), (6, "x", "de", "src3", 1), (6, "x", "de", "src3", 1), (7, "Ünï çödé 漢字   a", "fr", "src4", 16), (8, "a" * 3000, "en", "src0", 3000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASH})


OPS = {
    "near": minhash.drop_near_copies, "passages": suffix_array.drop_repeated_passages, "quality": quality.reject_outliers,
    "mix": lambda d: mixing.mix_sources(d, mixing.domain_of(F.col("source")), mixing.WEIGHTS), "lang": langid.identify, "bpe": lambda d: bpe.encode_documents(d, cache=8), "license": license_scan.scan_licenses,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert OPS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def _rows(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_odd_near(odd):
    got = _rows(minhash.drop_near_copies(odd))
    want = _rows(odd.where("text is not null").dropDuplicates(["text"])) + _rows(odd.where("text is null"))
    assert sum(got.values()) == sum(want.values()) and got[(4, odd.where("doc_id = 4").first().text)] == 1 and got[(5, None)] == 0
    assert minhash.drop_near_copies(odd).columns == odd.columns


def test_odd_passages(odd):
    got = suffix_array.drop_repeated_passages(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    by = {(r.doc_id): r for r in got.where("doc_id in (4, 5)").collect()}
    assert by[5].text == "" and by[5].n_chars == 0 and by[4].n_chars == len(by[4].text) and by[4]._key == "mine"
    assert _rows(got.where("doc_id not in (4, 5) or doc_id is null")) == _rows(odd.where("doc_id not in (4, 5) or doc_id is null"))


def test_odd_rows_pass(odd):
    assert _rows(quality.reject_outliers(odd)) == _rows(odd)  # too few to judge
    out = quality.reject_outliers(odd, distance_column="_key")
    assert out.columns.count("_key") == 1 and out.where("_key is not null").count() == 0
    lang = langid.identify(odd).collect()
    assert len(lang) == odd.count() and all(r.language == "und" and r.distance == 1 for r in lang if r.doc_id in (1, 2, 3))
    coded = bpe.encode_documents(odd, cache=8).collect()
    assert len(coded) == odd.count() and all(r.round_trip or r.tokens is None for r in coded) and all(r.n_tokens == 0 for r in coded if r.doc_id == 2)
    mixed = mixing.mix_sources(odd, mixing.domain_of(F.col("source")), mixing.WEIGHTS, share=(1, 1))
    assert mixed.columns == [*odd.columns, "epoch"] and mixed.where("text is null or trim(text) = ''").count() == 0 and mixed.count() > 0
    assert license_scan.scan_licenses(odd.withColumn("text", F.lit("Released under the MIT License."))).count() == 9


def test_near_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for i, x in rows:
        w = x.lower().split()
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else set(w)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= minhash.THRESHOLD * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in minhash.drop_near_copies(docs).collect()}
    want = {i for i in ids if top(i) == i}
    assert len(kept ^ want) <= 0.1 * (len(ids) - len(want))


def test_sketch_concentrates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 200):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)])
        t = minhash.sketch(np.repeat([0, 1], n), np.concatenate([a, b]), 2, 128)
        assert (t < np.iinfo(np.uint64).max).all()
        assert abs((t[0] == t[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.17


def test_groups_of_many_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[: k % 60], f"x{k}", *base[k % 60 + 1 :]])) for k in range(80)] + [(1000 + k, " ".join(f"z{k}q{i}" for i in range(60))) for k in range(5)]
    kept = {r.doc_id for r in minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 1000, 1001, 1002, 1003, 1004}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(25), 200, 300]:
        for k in (1, 2, 4):
            t = rng.integers(0, k, n)
            s = t.tolist()
            order = suffix_array.suffix_array(t).tolist()
            assert order == sorted(range(n), key=lambda i: s[i:])
            for a, b, h in zip(order, order[1:], suffix_array.common_prefixes(t, np.array(order)).tolist()):
                assert s[a : a + h] == s[b : b + h] and (max(a, b) + h == n or s[a + h] != s[b + h])


def _without(text, gone):
    spans = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\f]+", text)]
    out = text[: spans[0][0]] if spans else text
    for q, (a, _) in enumerate(spans):
        if not gone[q]:
            out += text[a : spans[q + 1][0] if q + 1 < len(spans) else len(text)]
    return out


def test_passages_are_brute_force(docs):
    seen, want = set(), {}
    for i, x in sorted((r.doc_id, r.text) for r in docs.collect()):
        w = re.findall(r"[^ \t\n\r\x0b\f]+", x)
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            if g in seen:
                gone[p : p + 50] = [True] * 50
            seen.add(g)
        want[i] = _without(x, gone) if any(gone) else x
    assert {r.doc_id: r.text for r in suffix_array.drop_repeated_passages(docs).collect()} == want


def test_quality_tells_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in quality.reject_outliers(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id").collect()}
    rate = {q: np.mean([r.doc_id in kept for r in spark.read.parquet(f"{d}/labels.parquet").where(f"quality = {q}").collect()]) for q in (0, 1)}
    assert rate[1] > 0.98 and rate[0] < 0.1
    assert abs(quality.chi2(quality.chi2_point(0.75, 6), 6) - 0.75) < 1e-9


def test_counts():
    import pyarrow as pa

    got = np.array(quality.counts(pa.array(["Ab1, ÄÖ!", None, "", "x x x y"])).to_pylist())
    assert got[0].tolist() == [2, 7, 4, 3, 2] and not got[1].any() and not got[2].any() and got[3][[0, 4]].tolist() == [4, 2]


def test_quality_is_brute_force(spark):
    """Distances are those of concentration steps that sort all of a group, but for the width of a range of distances."""
    import pyarrow as pa

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    far = {r.doc_id: r.distance for r in quality.reject_outliers(docs, limit=1e9, distance_column="distance").select("doc_id", "distance").collect()}
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).collect()
    x = np.array(quality.counts(pa.array([r.text for r in rows])).to_pylist())
    at = {c: k for k, c in enumerate(quality.COUNTS)}
    names = np.array([f"{r.lang}|{r.source}" for r in rows])
    judged = 0
    for name in np.unique(names):
        m = np.flatnonzero(names == name)
        if len(m) < quality.LEAST_GROUP:
            continue
        judged += 1
        g = x[m]
        base = [g[:, at[a]].sum() / g[:, at[b]].sum() for a, b in quality.RATIOS]
        ratio = [(g[:, at[a]] + quality.PRIOR[b] * z) / (g[:, at[b]] + quality.PRIOR[b]) for (a, b), z in zip(quality.RATIOS, base)]
        y = np.arcsin(np.sqrt(np.clip(np.array(ratio).T, 0, 1)))
        centre = np.median(y, axis=0)
        cov = np.diag((1.4826 * np.median(abs(y - centre), axis=0)) ** 2)
        for _ in range(30):
            gap = y - centre
            d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov + quality.RIDGE * np.eye(quality.P)), gap)
            near = y[np.argsort(d2, kind="stable")[: int(np.ceil(quality.SHARE * len(y)))]]
            centre = near.mean(axis=0)
            q = len(near) / len(y)
            cov = np.cov(near.T) * q / quality.chi2(quality.chi2_point(q, quality.P), quality.P + 2)
        assert np.diag(cov).min() > 10 * quality.RIDGE and abs(np.corrcoef(near.T) - np.eye(quality.P)).max() > 0.1
        gap = y - centre
        want = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov + quality.RIDGE * np.eye(quality.P)), gap)
        got = np.array([far[rows[k].doc_id] for k in m])
        assert np.median(abs(got / want - 1)) < 0.15
        assert ((got > quality.LIMIT**2) == (want > quality.LIMIT**2)).mean() > 0.98
    assert judged >= 1


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))  # odd ids are held out
    got = {r.doc_id: r.language for r in langid.identify(model).collect()}
    held = docs.where("doc_id % 2 = 1 and n_chars > 50").collect()
    assert np.mean([got[r.doc_id] == r.lang for r in held]) > 0.97


def test_licenses_against_duckdb(docs):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, license_scan.scan_licenses(docs).collect())) == sorted(c.sql(license_scan.oracle()).fetchall())


def test_every_template_matches_itself(spark):
    rows = [(k, text) for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {(r.doc_id, r.license): r.score for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get((k, name), 0) >= 0.8 for k, (name, _) in enumerate(license_scan.TEMPLATES))


def test_mixture_against_duckdb(docs):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = mixing.mix_sources(docs, mixing.domain_of(F.col("source")), mixing.WEIGHTS).select("doc_id", "epoch").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(mixing.oracle()).select("doc_id, epoch").fetchall())


def test_bpe_is_tiktoken(docs):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    extra = docs.sparkSession.createDataFrame([(-1, "don't  I'LL\n\n \u0085é漢字🤣 12½  ", "", "", 0), (-2, "z" * 200, "", "", 0)], SCHEMA)
    rows = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in bpe.encode_documents(rows, cache=500).collect():
        assert list(r.tokens) == enc.encode_ordinary(texts[r.doc_id]) and r.round_trip


def test_bpe_folds_at_bounds_and_from_both_tables(spark, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    seen = [" the"] * 9 + [" of"] * 7 + [" osmentementei"] * 3 + [" byanblentor"] * 2
    rare = ["q", "qx", "zzz", "\x00\xff", "aaaaaaaaab", "baaaaaaaaa", "Thheheti", " \u6f22\u5b57\u6f22\u5b57", "x" * 31, " laeviree", "the"]
    docs = spark.createDataFrame([(0, "".join(seen)), *enumerate(rare, 1)], "doc_id long, text string")
    monkeypatch.setattr(bpe, "HOT", 2)
    # The two most frequent words have a table of their own, the next two another.
    assert [n for _, n in bpe.codec(spark, docs, cache=4).cached] == [2, 2] and [n for _, n in bpe.codec(spark, docs, cache=2).cached] == [2]
    for cache in (0, 4):
        out = bpe.encode_documents(docs, cache=cache)
        assert out.schema["tokens"].dataType.simpleString() == "array<int>"
        got = {r.doc_id: list(r.tokens) for r in out.where("round_trip").collect()}
        assert got == {i: enc.encode_ordinary(t) for i, t in [(0, "".join(seen)), *enumerate(rare, 1)]}


def test_bpe_literals_hold_their_own_bytes_and_few_places(spark, monkeypatch):
    monkeypatch.setattr(bpe, "HOT", 64)
    words = [f" word{i}" for i in range(1000)]
    table, n = bpe._table(spark, spark.createDataFrame([(w, [i, i + 1]) for i, w in enumerate(words)], "_w string, _c array<int>"), len(words))
    # Four words a place beyond HOT; at one a place the data took a fourth more.
    assert n == 256 and bpe._table(spark, spark.createDataFrame([(w, [1]) for w in words[:64]], "_w string, _c array<int>"), 64)[1] == 64
    data = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(table._jc).value()
    # A part of a row's bytes would be copied each time that a plan with it is shipped.
    assert len(data.getBaseObject()) == data.getSizeInBytes() < 75 * len(words)
    rows = spark.createDataFrame([(w,) for w in [*words, " word", "", " word1000"]], "w string")
    got = {r.w: r.c for r in rows.select("w", bpe._lookup((table, n), F.col("w")).alias("c")).collect()}
    assert got == {w: [i, i + 1] for i, w in enumerate(words)} | {" word": None, "": None, " word1000": None}


def test_bpe_decodes_only_its_ids(spark):
    made = bpe.Codec(spark, bpe.read_ranks(bpe.default_vocabulary()))
    rows = spark.createDataFrame([([0, 60_000],), ([None],), ([],), (None,)], "ids array<int>")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in rows.select(made.decode(F.col("ids"))).collect()] == [None, None, b"", None]


def test_html_is_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", html_extract.host_of(F.col("url")).alias("h"), html_extract.stream_of(F.col("html")).alias("s")).collect()
    n, held = html_extract.LENGTH, collections.defaultdict(set)
    words = {r.page_id: re.findall(r"[^ \t\n\r\x0b\f]+", r.s) for r in rows}
    for r in rows:
        for p in range(len(words[r.page_id]) - n + 1):
            held[r.h, tuple(words[r.page_id][p : p + n])].add(r.s)
    got = {r.page_id: r.text for r in html_extract.extract_unique(pages).collect()}
    for r in rows:
        w, gone = words[r.page_id], [False] * len(words[r.page_id])
        for p in range(len(w) - n + 1):
            if len(held[r.h, tuple(w[p : p + n])]) > 1:
                gone[p : p + n] = [True] * n
        assert got[r.page_id] == html_extract.plain_text(_without(r.s, gone))


def test_html_streams_are_computed_once_a_pass(spark, monkeypatch):
    plans, store = [], suffix_array.store
    monkeypatch.setattr(suffix_array, "store", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    menu = "<p>" + "".join(f"item{i} " for i in range(18))
    rows = [(1, "http://a/1", menu + "one"), (2, "http://a/2", menu + "two"), (3, "http://a/3", None), (4, None, "")]
    out = html_extract.extract_unique(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {1: "one", 2: "two", 3: None, 4: ""}
    plans = [p for p in plans if "regexp_replace" in p]
    assert len(plans) == 2
    for plan in plans:
        assert [x.split()[0] for x in (line.lstrip(" :+-") for line in plan.splitlines()) if "regexp_replace" in x] == ["Project"]
        assert plan.count("regexp_replace(regexp_replace(") == 1


def test_html_runs_that_repeat_within_pages_of_several_tasks(spark):
    rows = [(i, f"http://a/{i}", "<p>" + "menu item " * 9 + own) for i, own in ((1, "one"), (2, "two"))]
    for tasks in (1, 2):
        pages = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "page_id long, url string, html string")
        assert {r.page_id: r.text for r in html_extract.extract_unique(pages).collect()} == {1: "one", 2: "two"}


def test_html_cases(spark):
    rows = [(1, None, "<p>a &amp; b</p>"), (2, "http://h/x", None), (3, "http://h/x", ""), (4, "http://h/y", "<script>var t='</p>';"), (5, "no url", "x <b title='>'>y</b><!-- c"), (5, "no url", "x <b title='>'>y</b><!-- c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("_spans", F.lit(1))
    out = html_extract.extract_unique(df)
    assert out.columns == ["page_id", "url", "_spans", "text"]
    assert sorted((r.page_id, r.text) for r in out.where("page_id != 2").collect()) == [(1, "a & b"), (3, ""), (4, ""), (5, "x y"), (5, "x y")] and out.where("page_id = 2").first().text is None
    assert html_extract.extract_unique(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(i, f"http://H.example/{'good' if i % 2 else 'bad'}/{i}.html?b={i}&a=1", i % 2) for i in range(200)] + [(500, None, 1), (501, "not a url", None), (502, "http://one.example/a/deadbeef01", None), (502, "http://one.example/a/deadbeef01", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, good int").withColumn("template", F.lit("old")).withColumn("_host", F.lit(1))
    got = url_filter.filter_urls(df, F.col("good"))
    assert got.columns == ["page_id", "url", "good", "_host", "template", "purity", "rejected"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert by[0].template == "h.example/bad/#.html/?a&b" and by[0].rejected and by[1].template == "h.example/good/#.html/?a&b" and not by[1].rejected
    assert by[500].template is None and not by[500].rejected and by[502].template == "one.example/a/{hex}"
    assert url_filter.filter_urls(df.limit(0), F.col("good")).count() == 0
    # Alike and rare branches are merged.
    many = spark.createDataFrame([(i, f"http://h/{'ab'[i % 2]}/{'xyz'[i % 3]}{chr(97 + i % 26) * 2}{chr(97 + i // 26)}", (i // 2) % 2) for i in range(300)], "page_id long, url string, good int")
    assert {r.template for r in url_filter.filter_urls(many, F.col("good")).collect()} == {"h/*/*"}
    deep = spark.createDataFrame([(1, "http://h/" + "/".join("s" * 1 for _ in range(60)), 1)], "page_id long, url string, good int")
    assert url_filter.filter_urls(deep, F.col("good")).count() == 1


def test_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ x.T
    np.fill_diagonal(like, -2)
    best = np.argsort(-like, axis=1)[:, :10]
    got = collections.defaultdict(list)
    at = {r.vec_id: k for k, r in enumerate(rows)}
    for r in ann.neighbours(vectors, block=200).orderBy("vec_id", "rank").collect():
        assert abs(r.cosine - like[at[r.vec_id], at[r.neighbour_id]]) < 1e-6 and r["rank"] == len(got[r.vec_id]) + 1
        got[r.vec_id].append(r.neighbour_id)
    ids = [r.vec_id for r in rows]
    for i, names in got.items():
        c = [like[at[i], at[j]] for j in names]
        assert all(x >= y - 1e-6 for x, y in zip(c, c[1:]))
    assert np.mean([len(set(got[i]) & {ids[j] for j in best[k]}) / 10 for k, i in enumerate(ids)]) > 0.9
    named = ann.neighbours(vectors.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")), block=200)
    assert {(r.vec_id, r.neighbour_id) for r in named.collect()} == {(f"v{i}", f"v{j}") for i, names in got.items() for j in names}


def test_neighbour_cases(spark):
    rows = [(1, [1.0, 0.0] * 8), (2, [1.0, 0.1] * 8), (None, [1.0] * 16), (3, None), (4, [0.0] * 16), (5, [float("nan")] * 16), (6, [1.0]), (7, [None] * 16), (1, [1.0, 0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_row", F.lit(0))
    got = {(r.vec_id, r.neighbour_id) for r in ann.neighbours(df, radius=16).collect()}
    assert got == {(1, 2), (2, 1)}
    assert ann.neighbours(df.limit(0)).count() == 0


def test_probing_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (300, 4)).astype(np.uint8)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.arange(300)
    a, b, _ = ann.search((codes, x, keys), (codes, x, keys), 9, 300)
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*np.nonzero(apart <= 9)) if i != j}


def test_url_templates_are_brute_force(spark):
    """The tree of each host, built by plain loops."""
    import math
    from urllib.parse import urlsplit

    pages = url_filter.labelled_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    deep = spark.createDataFrame([(10_000 + i, f"http://deep.example/{'/'.join('ab'[i % 2] for _ in range(40))}/{i}", i % 2) for i in range(60)], "page_id long, url string, good int")
    pages = pages.unionByName(deep)
    rows = pages.collect()

    def generalised(url):
        u = urlsplit(url)
        out = []
        for s in [x for x in u.path.split("/") if x]:
            hexed = re.fullmatch(r"(?=.*\d)(?:[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", s) and not s.isdigit()
            out.append("{hex}" if hexed else re.sub(r"\d+", "#", s))
        names = sorted({p.split("=")[0] for p in u.query.split("&") if p.split("=")[0]})
        return u.hostname or "", tuple(out + (["?" + "&".join(names)] if names else []))

    paths = [(*generalised(r.url), r.good) for r in rows]
    name = {}

    def grow(group, depth, prefix):
        branches = collections.defaultdict(list)
        for h, segs, good in group:
            if len(segs) > depth:
                branches[segs[depth]].append((h, segs, good))
            else:
                name[h, segs] = prefix
        every = [x for b in branches.values() for x in b]
        stat = lambda g: (len(g), sum(x[2] is not None for x in g), sum(x[2] or 0 for x in g), sum(len(x[1]) - depth for x in g))
        n_all, lab_all, good_all, deep_all = stat(every)
        joined = set()
        for seg, b in branches.items():
            n, lab, good, deep_ = stat(b)
            others = lab_all - lab
            alike = True
            if lab and others:
                pool = good_all / lab_all
                error = math.sqrt(pool * (1 - pool) * (1 / lab + 1 / others))
                alike = abs(good / lab - (good_all - good) / others) <= url_filter.ALIKE_Z * error
            alike = alike and abs(deep_ / n - deep_all / n_all) <= url_filter.ALIKE_DEPTH
            if len(branches) > 1 and (n < url_filter.SUPPORT or alike):
                joined.add(seg)
        merged = collections.defaultdict(list)
        for seg, b in branches.items():
            merged["*" if seg in joined and len(joined) > 1 else seg] += b
        for seg, b in merged.items():
            grow(b, depth + 1, f"{prefix}/{seg}")

    hosts = collections.defaultdict(list)
    for p in paths:
        hosts[p[0]].append(p)
    for h, group in hosts.items():
        grow(group, 0, h)
    part = lambda g: (sum(x is not None for x in g), sum(x or 0 for x in g))
    known, good = part([p[2] for p in paths])
    p0 = good / known if known else 1.0
    smooth = lambda g, to: (part(g)[1] + url_filter.PRIOR * to) / (part(g)[0] + url_filter.PRIOR)
    of_host = {h: smooth([p[2] for p in g], p0) for h, g in hosts.items()}
    members = collections.defaultdict(list)
    for h, segs, g in paths:
        members[h, name[h, segs]].append(g)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, F.col("good")).collect()}
    for r, (h, segs, _) in zip(rows, paths):
        purity = smooth(members[h, name[h, segs]], of_host[h])
        assert got[r.page_id].template == name[h, segs] and abs(got[r.page_id].purity - purity) < 1e-9 and got[r.page_id].rejected == (purity < url_filter.LEAST_PURITY)


def test_languages_are_brute_force(docs):
    """Frequencies, vectors, cosines and limits of a model's answers, by plain loops over n-grams."""
    import math

    model = langid.fit(docs)
    rows = docs.select("doc_id", F.lower("text").alias("text")).collect()

    def grams(text):
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
        raw = re.sub(rb" +", b" ", raw)
        out = collections.Counter()
        for g in langid.GRAMS:
            for i in range(len(raw) - g + 1):
                code = g
                for b in raw[i : i + g]:
                    code = code << 8 | b
                x = code
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                out[(x ^ x >> 31) % langid.DIMS] += 1
        return out

    counted = {r.doc_id: grams(r.text) for r in rows}
    held = collections.Counter(p for c in counted.values() for p in c)
    idf = [math.log((1 + len(rows)) / (1 + held[p])) + 1 for p in range(langid.DIMS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    for r in langid.identify(docs).collect():
        c = counted[r.doc_id]
        if not c:
            assert r.language == langid.UNKNOWN and r.distance == 1
            continue
        v = {p: math.log1p(k) * idf[p] for p, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        like = [sum(x * float(m[p]) for p, x in v.items()) / norm for m in model.matrix]
        best = max(range(len(like)), key=like.__getitem__)
        least = model.least[best, min(langid._LENGTHS - 1, int(math.log2(1 + sum(c.values()))))]
        assert abs(r.distance - (1 - like[best])) < 1e-4
        if abs(like[best] - least) > 1e-4:
            assert r.language == (model.names[best] if like[best] >= least else langid.UNKNOWN)


def test_maps_are_part_of_a_row(spark):
    df = spark.createDataFrame([(1, "a b c", {"x": 1, "y": 2}), (1, "a b c", {"x": 3})], "doc_id long, text string, m map<string,int>")
    assert len({tuple(sorted(r.m.items())) for _ in range(2) for r in minhash.drop_near_copies(df).collect()}) == 1


def test_ids_may_be_texts(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([("b", long), ("a", "x " + long), (None, long)], "doc_id string, text string")
    got = {r.doc_id: r.text for r in suffix_array.drop_repeated_passages(df).collect()}
    assert got == {"a": "x " + long, "b": "", None: ""}
    assert {r.doc_id for r in minhash.drop_near_copies(df).collect()} == {"a"}


def test_words_split_at_texts():
    w = Words(np.frombuffer(b"ab cd", np.uint8), np.array([0, 1, 1, 4, 5]))
    assert w.counts.tolist() == [1, 0, 2, 1]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
    assert sizes[0] <= 200 and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[4] == sizes[3] > 0
    assert docs.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in docs.collect())
