"""Cases that an operator once left out."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloam.llm import bpe, license_scan, minhash, mixing, quality, url_filter


def test_licenses_at_the_threshold(spark):
    import duckdb

    texts = ["CC BY-SA 4.0", "CC-BY-NC-4.0", "x\nCC BY-ND 4.0\ny", "CC BY 4.0", "under CC BY 4.0"]
    rows = list(enumerate(texts))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    got = sorted(map(tuple, license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(c.sql(license_scan.oracle()).fetchall())
    assert {0, 1, 2} <= {r[0] for r in got}
    anchors = license_scan.anchors(0.8)
    for _, text in license_scan.TEMPLATES:
        b = license_scan._bigrams(text)
        free = [x for x in b if not any(f" {a} " in f" {x} " for a in anchors)]
        assert len(free) < len(b) * 0.8 / 1.2 - 1e-9


def test_licenses_within_longer_texts(spark):
    import textwrap

    prose = [f"Sentence {i} is about nothing in particular, number {i * i}." for i in range(80)]
    full = {name: text for name, text in reversed(license_scan.TEMPLATES)}
    rows, want = [], set()
    for k, (name, text) in enumerate(full.items()):
        rows.append((k, "\n".join([*prose, *(f" * {x}," for x in textwrap.wrap(text, 30)), *prose])))
        want.add((k, name))
    rows += [(100, " ".join([*prose, "Released under the", "MIT License.", *prose])), (101, "\n".join([*prose, "This work is licensed under the GNU General Public License, version 3, and so on, for a long line of prose of many words.", *prose]))]
    want |= {(100, "MIT"), (101, "GPL-3.0")}
    rows += [(102, "\n".join(prose)), (103, "the software license is under the terms of\n" * 3000), (104, "\n".join([*prose, "Released under\nthe MIT", "License.", *prose, "Released under the\nMIT License", *prose]))]
    want.add((104, "MIT"))
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == want
    assert all(got[x].score == 1 for x in want) and got[(104, "MIT")].units == 2


def test_runs_are_brute_force():
    import random

    rng = random.Random(0)
    for trial in range(40):
        words = []
        for _ in range(4):
            w = license_scan.normal(rng.choice(license_scan.TEMPLATES[7:])[1]).split()
            words += [rng.choice("abc") for _ in range(rng.randrange(4))] + [x for x in w if rng.random() < 0.97]
        best = {}
        for name, text in license_scan.TEMPLATES:
            b = set(license_scan._bigrams(text))
            for i in range(len(words)):
                for j in range(i + 2, len(words) + 1):
                    a = {f"{x} {y}" for x, y in zip(words[i:j], words[i + 1 : j])}
                    s = 2.0 * len(a & b) / (len(a) + len(b))
                    if s >= 0.8 and s > best.get(name, 0):
                        best[name] = s
        got = {}
        for name, s in license_scan.runs(" ".join(words), 0.8):
            got[name] = max(got.get(name, 0), s)
        assert set(got) <= set(best) and all(got[n] <= best[n] for n in got)
        top = max(best.values(), default=0)
        assert {n for n, s in best.items() if s == top} == {n for n, s in got.items() if s == top}


def test_branches_of_a_big_host_are_tested(spark):
    def page(host, n, branch, good):
        return spark.range(n).select(F.concat(F.lit(f"http://{host}/"), branch, F.lit("/p")).alias("url"), F.lit(good).alias("good"))

    def host(name, size):
        word = F.concat(F.lit("s"), F.translate((F.col("id") % 40).cast("string"), "0123456789", "abcdefghij"))
        rows = page(name, size, word, 1).unionByName(page(name, 100, F.lit("junk"), 0))
        for k in "abcdef":  # rare and clean
            rows = rows.unionByName(page(name, 100, F.lit(f"rare{k}"), 1))
        return rows

    got = url_filter.filter_urls(host("small", 2_000).unionByName(host("big", 200_000)), F.col("good"))
    junk = {(r.template, r.rejected) for r in got.where("url like '%/junk/%'").distinct().collect()}
    assert junk == {("small/junk/p", True), ("big/junk/p", True)}
    assert got.where("url not like '%/junk/%' and rejected").count() == 0


def test_documents_of_small_groups_are_judged(spark):
    import random

    rng = random.Random(0)
    words = ["river", "stone", "walked", "the", "a", "of", "evening", "and", "quiet", "under", "light", "found"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(120)) + "."
    groups = [("en", "web", 400), ("en", "rare", 20), ("es", "web", 20), (None, None, 10)]
    rows = [(prose(), lang, source, "prose") for lang, source, n in groups for _ in range(n)]
    rows += [("#$% 0193 @@ {} 77 " * 60, lang, source, "junk") for lang, source, _ in groups[1:] for _ in range(4)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, kind string")
    got = quality.reject_outliers(df, distance_column="distance").collect()
    assert all(r.distance is not None and r.kind == "prose" for r in got)
    assert len(got) > 440


def _kept_by_quality(rows):
    import pyarrow as pa

    x = np.array(quality.counts(pa.array([r["text"] for r in rows])).to_pylist())
    at = {c: k for k, c in enumerate(quality.COUNTS)}
    names = [(r["lang"] or "", r["source"] or "") for r in rows]
    size, langs = collections.Counter(names), collections.Counter(a for a, _ in names)
    pools = {}
    for k, (lang, source) in enumerate(names):
        if size[lang, source] >= quality.LEAST_GROUP:
            pools[k] = (lang, source)
        elif langs[lang] >= quality.LEAST_GROUP:
            pools[k] = (lang,)
        else:
            pools[k] = ()
    kept = []
    for pool in set(pools.values()):
        g = x[[n[: len(pool)] == pool for n in names]]
        if len(g) < quality.LEAST_GROUP:
            kept += [k for k in pools if pools[k] == pool]
            continue
        base = [g[:, at[a]].sum() / g[:, at[b]].sum() for a, b in quality.RATIOS]
        vectors = lambda c: np.arcsin(np.sqrt(np.clip(np.array([(c[:, at[a]] + quality.PRIOR[b] * z) / (c[:, at[b]] + quality.PRIOR[b]) for (a, b), z in zip(quality.RATIOS, base)]).T, 0, 1)))
        y = vectors(g)
        centre = np.median(y, axis=0)
        cov = np.diag((1.4826 * np.median(abs(y - centre), axis=0)) ** 2)
        far = lambda v: np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov + quality.RIDGE * np.eye(quality.P)), v - centre)
        for _ in range(30):
            near = y[np.argsort(far(y), kind="stable")[: int(np.ceil(quality.SHARE * len(y)))]]
            q = len(near) / len(y)
            centre, cov = near.mean(axis=0), np.cov(near.T) * q / quality.chi2(quality.chi2_point(q, quality.P), quality.P + 2)
        mine = [k for k in pools if pools[k] == pool]
        kept += [k for k, d in zip(mine, far(vectors(x[mine]))) if d <= quality.LIMIT**2]
    return [rows[k] for k in sorted(kept)]


def _kept_by_likeness(rows):
    sets = []
    for r in rows:
        w = r["text"].lower().split()
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else set(w))
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            like = rows[a]["text"] == rows[b]["text"] or (sets[a] and len(sets[a] & sets[b]) >= minhash.THRESHOLD * len(sets[a] | sets[b]))
            if like:
                x, y = sorted((top(a), top(b)), key=lambda k: rows[k]["doc_id"])
                up[y] = x
    return [r for k, r in enumerate(rows) if top(k) == k]


def _without_passages(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        x = r["text"]
        spans = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\f]+", x)]
        w = [x[a:b] for a, b in spans]
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            if g in seen:
                gone[p : p + 50] = [True] * 50
            seen.add(g)
        if any(gone):
            x = x[: spans[0][0]] + "".join(x[a : spans[q + 1][0] if q + 1 < len(spans) else len(x)] for q, (a, _) in enumerate(spans) if not gone[q])
        out.append({**r, "text": x, "n_chars": len(x)})
    return out


def test_pipeline_is_brute_force(spark):
    """The rows of the whole job are those of plain loops, stage after stage, and of DuckDB's mixture and another encoder."""
    import corpus_pipeline
    import duckdb
    import pandas as pd
    import public_tokenizers as P
    import tiktoken

    d = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = _without_passages(_kept_by_likeness(_kept_by_quality(rows)))
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_vocabulary()), special_tokens={})
    want = sorted((i, tuple(enc.encode_ordinary(x))) for i, x in c.sql(mixing.oracle(columns="doc_id, text")).fetchall())
    got = sorted((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "src0", None), (2, "", "en", "src0", 0), (2, "", "en", "src0", 0), (None, "one word", None, None, 8), (4, "w " * 30_000, "de", "src1", 60_000), (5, "a b c d", "en", "src0", 7), (5, "a b c d", "en", "src0", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "")
            if name != "bpe":
                assert out.columns == docs.columns
            some = out
        assert some.where("not round_trip").count() == 0


def test_tokens_do_not_hold_the_codec(spark):
    """The last stage's result is a table: a caller that keeps it keeps none of the codec's literals in the driver."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words and words"), (2, None), (None, ""), (4, "w" * 300)], "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Relation ")
    assert out.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    assert sorted(map(str, out.collect())) == sorted(map(str, bpe.encode_documents(docs).collect()))
