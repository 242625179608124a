"""Near-duplicate removal: fast similarity sketching, banding, exact verification.

Sketches follow Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017). With
``t`` coordinates, round ``i < t`` hashes every element of the set to a coordinate and a value and
keeps each coordinate's least ``(round, value)``; the rounds end when every coordinate is full. From
round ``t`` on, round ``i`` puts all elements into coordinate ``i - t``, so ``2 t`` rounds fill every
sketch, whatever the set. A set of ``n`` elements takes about ``t log t / n`` rounds, and the share
of equal coordinates concentrates about the Jaccard similarity as it does for ``t`` independent hashes.

Documents whose bands agree are candidates. Each bucket first pairs its members with its least
member only, so a group of a thousand copies is a thousand pairs, and verified pairs are joined into
components. Buckets that still hold several components then pair all members across
components. Every candidate pair is thus either verified or already joined through
verified pairs: the groups are those that comparing all candidates would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Hasher, Words, blobs, buffers, cut, discard, distinct_in_owner, lists, mix, row_hash, seeds, steps, store, unused

BANDS, ROWS = 32, 4
#: Least Jaccard similarity of two documents' sets of word pairs.
THRESHOLD = 0.55


def shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each pair of adjacent words; a text of one word is that word."""
    owner = words.owner()
    with np.errstate(over="ignore"):
        if len(hashes) < 2:
            return owner, mix(hashes)
        pair = np.empty_like(hashes)
        pair[:-1] = mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])
        pair[-1] = 0
        alone = words.counts[owner] == 1
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        pair[alone] = mix(hashes[alone])
        keep = alone | ~last
    return owner[keep], pair[keep]


def sketch(owner: np.ndarray, element: np.ndarray, n: int, t: int, salt: int = 11) -> np.ndarray:
    """The ``n x t`` sketches of sets given as (owner, element); a row of an empty set stays at the greatest value."""
    if t & (t - 1) or t > 128:
        raise ValueError("the number of coordinates is a power of two of at most 128")
    flat = np.full(n * t, np.iinfo(np.uint64).max, U64)
    keys = seeds(2 * t, salt)
    shift = U64(8)
    for i in range(2 * t):
        if not len(owner):
            break
        with np.errstate(over="ignore"):
            h = mix(element ^ keys[i])
        at = (h & U64(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + at, (U64(i) << U64(56)) | (h >> shift))
        table = flat.reshape(n, t)
        open_ = (table == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            keep = open_[owner]
            owner, element = owner[keep], element[keep]
    return flat.reshape(n, t)


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for i, j, data, offsets in steps(batch.column("text")):
            words = Words(data, offsets)
            owner, element = shingles(words, hasher.spans(data, words.start, words.end))
            n = j - i
            table = sketch(owner, element, n, bands * rows).reshape(n, bands, rows)
            out = np.full((n, bands), 0, U64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    out = mix(out * U64(0x9E3779B97F4A7C15) + table[:, :, r])
                out = mix(out + seeds(bands, 5)[None, :])
            full = words.counts > 0
            first = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key")[i:j], lists(out[full].reshape(-1).view(np.int64), first)], ["_key", "_bands"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for i, j, data, offsets in steps(batch.column("text")):
            words = Words(data, offsets)
            owner, value = distinct_in_owner(*shingles(words, hasher.spans(data, words.start, words.end)))
            first = np.searchsorted(owner, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column("_key")[i:j], blobs(value, first)], ["_key", "_set"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, at), (b, bt) = buffers(batch.column("_sa")), buffers(batch.column("_sb"))
        a, b, at, bt = a.view(np.uint64), b.view(np.uint64), at // 8, bt // 8
        ok = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]]
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if len(small) < threshold * len(large):
                continue
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[place] == small).sum())
            ok[k] = both >= threshold * (len(x) + len(y) - both)
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column("_a").filter(mask), batch.column("_b").filter(mask)], ["_a", "_b"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (_a, _b) whose sets have at least the Jaccard similarity ``threshold``, exactly."""
    a = sets.select(F.col("_key").alias("_a"), F.col("_set").alias("_sa"))
    b = sets.select(F.col("_key").alias("_b"), F.col("_set").alias("_sb"))
    both = pairs.join(b, "_b").join(a, "_a").select("_a", "_b", "_sa", "_sb")
    return both.mapInArrow(lambda it: _verify(it, threshold), "_a binary, _b binary")


def components(edges: DataFrame) -> DataFrame:
    """(_key, _comp) for the nodes of ``edges`` (_a, _b): the least node of each component.

    Alternating large and small stars (Kiveris and others, "Connected Components in MapReduce and
    Beyond", 2014), each a window over the edges of a node, until the edges stay as they are.
    """
    edges = cut(edges.where("_a != _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct())
    by = Window.partitionBy("_u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        low = F.least(F.col("_u"), F.min("_v").over(by))
        large = both.withColumn("_m", low).where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        low = F.min("_v").over(by)
        small = large.where("_u != _v").distinct().withColumn("_m", low)
        small = small.select(F.explode(F.array(F.struct("_v", "_m"), F.struct(F.col("_u").alias("_v"), "_m"))).alias("_e"))
        edges = cut(small.select(F.col("_e._v").alias("_u"), F.col("_e._m").alias("_v")).where("_u != _v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("_u").alias("_key"), F.col("_v").alias("_comp")).union(edges.select(F.col("_v").alias("_key"), F.col("_v").alias("_comp")).distinct())


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_key, _comp) of the distinct texts that have near copies; ``_key`` is the MD5 of the text."""
    base = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("_key"), F.lower("text").alias("text"))
    # Copies have equal keys and count once from here on, however many there are.
    banded = store(base.mapInArrow(lambda it: _bands(it, bands, rows), "_key binary, _bands array<long>").dropDuplicates(["_key"]))
    flat = banded.select("_key", F.explode("_bands").alias("_bucket"))
    # Counted with partial sums first; only the members of buckets that several texts share are brought together.
    shared = flat.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_bucket")
    by = Window.partitionBy("_bucket")
    multi = store(flat.join(shared, "_bucket").withColumn("_lead", F.min("_key").over(by)).select("_bucket", "_key", "_lead"))
    discard(banded)
    wanted = multi.select("_key").distinct()
    # Each distinct text once: copies have equal keys.
    once = base.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    sets = store(once.mapInArrow(_sets, "_key binary, _set binary"))
    first = multi.where("_key != _lead").select(F.col("_lead").alias("_a"), F.col("_key").alias("_b")).distinct()
    edges = cut(verified(first, sets, threshold))
    comps = components(edges)
    placed = multi.join(comps, "_key", "left").select("_bucket", "_key", F.coalesce("_comp", "_key").alias("_comp"), "_lead")
    open_ = placed.withColumn("_x", F.min("_comp").over(by)).withColumn("_y", F.max("_comp").over(by)).where("_x != _y").select("_bucket", "_key", "_comp", "_lead")
    open_ = cut(open_.distinct())
    if open_.isEmpty():
        return comps
    a = open_.select("_bucket", F.col("_key").alias("_a"), F.col("_comp").alias("_ca"), "_lead")
    b = open_.select("_bucket", F.col("_key").alias("_b"), F.col("_comp").alias("_cb"))
    # Pairs with the bucket's least member are verified already.
    rest = a.join(b, "_bucket").where("_a < _b and _ca != _cb and _a != _lead").select("_a", "_b").distinct()
    more = verified(rest, sets, threshold)
    return components(edges.union(more))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` without near copies: of each group the document with the least ``doc_id`` stays.

    Two documents are near copies if the sets of pairs of adjacent words of their lower-cased texts
    have a Jaccard similarity of at least ``threshold``; groups are the connected components of
    that relation among candidates. A pair at the threshold is a candidate with a probability of
    ``1 - (1 - threshold**rows)**bands``, 0.95 by default, and more similar pairs with a higher one.

    Defined cases: rows with a null text have no copies and all stay; texts that are equal byte for
    byte (empty ones too) are always copies; texts without words are only copies of equal ones.
    Among equal ``doc_id`` the least text stays, a null ``doc_id`` comes last, and of fully
    equal rows one stays, maps being equal whatever the order of their entries. Long texts count whole. All columns pass
    through whatever their names, and an empty table gives an empty one.
    """
    names = docs.columns
    key, keep, comp = (unused(x, names) for x in ("_key", "_keep", "_comp"))
    groups = near_groups(docs.select("doc_id", "text"), threshold, bands, rows).select(F.col("_key").alias(key), F.col("_comp").alias(comp))
    told = docs.where(F.col("text").isNotNull()).withColumn(key, F.unhex(F.md5("text")))
    # Per distinct text its least id, then per group the least of those.
    texts = told.groupBy(key).agg(F.min("doc_id").alias("_id")).join(groups, key, "left")
    first = Window.partitionBy(comp).orderBy(F.col("_id").asc_nulls_last(), F.col(key))
    texts = texts.withColumn(comp, F.coalesce(F.col(comp), F.col(key))).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    keepers = texts.select(F.col(key), F.col("_id").alias(keep))
    kept = told.join(keepers, key).where(F.col("doc_id").eqNullSafe(F.col(keep)))
    row = unused("_row", names)
    kept = kept.withColumn(row, F.row_number().over(Window.partitionBy(key).orderBy(row_hash(docs)))).where(F.col(row) == 1)
    cols = [F.col(f"`{c}`") for c in names]
    return kept.select(*cols).unionByName(docs.where(F.col("text").isNull()))
