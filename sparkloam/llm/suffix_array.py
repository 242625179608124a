"""Removal of repeated passages by suffix arrays, and the induced sorting that it rests on.

The corpus is not one string here. A passage of ``length`` words that occurs twice holds, at the same
place of both occurrences, a winnowed fingerprint (Schleimer, Wilkerson and Aiken, 2003): the least
hash of some run of words in every window. So a first pass hashes all words of all documents and
keeps those fingerprints that repeat; no repeated passage is without one. Each is then taken with
all windows of ``length`` words around it to a shard chosen by the fingerprint. A shard's
contexts are concatenated, apart by separators that occur once, and their suffix array is built by
induced sorting (Nong, Zhang and Chan, 2009): suffixes are classified, the leftmost smaller
substrings sorted recursively, and the array induced from them in linear time. Permuted common
prefixes (Kaerkkaeinen, Manzini and Puglisi, 2009) then give the groups of equal windows.

Equal contexts are merged before shards form, so that a passage with a million copies is one
row there, and the marks of a context are joined back to its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Hasher, Words, discard, lists, mix, row_hash, steps, store, unused

#: Words of a passage whose repeats go, and words of a fingerprint.
LENGTH, GRAM = 50, 25
#: Tokens at which a shard is closed; the contexts of one fingerprint are never parted.
SHARD_TOKENS = 60_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string of integers from 0 on, by induced sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    upper = int(text.max()) + 1
    # Types: a suffix is smaller than its successor's if its next different character is larger.
    step = np.sign(np.diff(text))
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    small = np.zeros(n, bool)
    small[:-1] = (nearest < n - 1) & (np.append(step, -1)[nearest] > 0)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    total = np.bincount(text, minlength=upper)
    large_first = np.concatenate([[0], np.cumsum(total)])
    small_first = large_first[:-1] + np.bincount(text[~small], minlength=upper)
    s, is_small = text.tolist(), small.tolist()
    heads, tails, mids = large_first[:-1].tolist(), large_first[1:].tolist(), small_first.tolist()

    def induce(order: list[int]) -> list[int]:
        out = [-1] * n
        at = mids.copy()
        for p in order:
            c = s[p]
            out[at[c]] = p
            at[c] += 1
        at = heads.copy()
        c = s[n - 1]
        out[at[c]] = n - 1
        at[c] += 1
        for p in out:  # reads what the loop itself has put in
            if p > 0:
                p -= 1
                if not is_small[p]:
                    c = s[p]
                    out[at[c]] = p
                    at[c] += 1
        at = tails.copy()
        for p in reversed(out):
            if p > 0:
                p -= 1
                if is_small[p]:
                    c = s[p]
                    at[c] -= 1
                    out[at[c]] = p
        return out

    m = len(lms)
    first = np.array(induce(lms.tolist()), dtype=np.int64)
    if m < 2:
        return first
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(m)
    ordered = first[number[first] >= 0]
    # Names: neighbours of the same length are compared character by character.
    end = np.append(lms[1:], n - 1)
    a, b = ordered[:-1], ordered[1:]
    la, lb = end[number[a]] - a, end[number[b]] - b
    same = la == lb
    # The last substring runs into the end of the string, which no other does.
    same &= (a != lms[-1]) & (b != lms[-1])
    ca, cb, size = a[same], b[same], la[same] + 1
    if len(ca):
        start = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(start, size)
        equal = text[np.repeat(ca, size) + inside] == text[np.repeat(cb, size) + inside]
        same[np.flatnonzero(same)] = np.logical_and.reduceat(equal, start)
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < m:
        reduced = np.empty(m, np.int64)
        reduced[number[ordered]] = names
        ordered = lms[suffix_array(reduced)]
    return np.array(induce(ordered.tolist()), dtype=np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix of ``order`` but the first, its common prefix with the one before it.

    They are computed in text order, where each is at least its predecessor's less one.
    """
    n = len(order)
    if n < 2:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    s, phi = text.tolist(), before.tolist()
    s.append(-1)  # differs from every character
    out = [0] * n
    h = 0
    for i in range(n):
        j = phi[i]
        if j < 0:
            h = 0
            continue
        while s[i + h] == s[j + h] and s[i + h] >= 0:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, dtype=np.int64)[order[1:]]


# --- fingerprints and contexts -------------------------------------------------------------------


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each window of ``width`` values, by doubling."""
    have, done = key, 1
    while done * 2 <= width:
        have = np.minimum(have[:-done], have[done:])
        done *= 2
    if done < width:
        have = np.minimum(have[: len(key) - width + 1], have[width - done :])
    return have


def _grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    n = len(hashes) - gram + 1
    out = np.zeros(max(0, n), U64)
    with np.errstate(over="ignore"):
        for j in range(gram):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        return mix(out)


_LOW = U64((1 << 26) - 1)


def winnow(words: Words, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of the fingerprints.

    Each window of ``length`` words chooses the last of its least hashes, so equal windows choose alike; the windows
    that choose one fingerprint follow each other.
    """
    hashed = _grams(hashes, gram)
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(hashed) < width:
        return none, np.zeros(0, U64), none, none
    at = np.arange(len(hashed), dtype=U64)
    key = (hashed & ~_LOW) | (_LOW - (at & _LOW))
    least = _least(key, width)
    owner = words.owner()
    begin = np.flatnonzero(owner[: len(least)] == owner[length - 1 : length - 1 + len(least)])
    if not len(begin):
        return none, np.zeros(0, U64), none, none
    low = _LOW - (least[begin] & _LOW)
    # The position's low bits, taken to the window that they lie in.
    chosen = begin + ((low.astype(np.int64) - begin) & int(_LOW))
    edge = np.flatnonzero(chosen[1:] != chosen[:-1])
    first = np.concatenate([[0], edge + 1])
    last = np.concatenate([edge, [len(chosen) - 1]])
    return chosen[first], hashed[chosen[first]], begin[first], begin[last]


#: Fingerprints that a task gathers before it sends them on, by ranges of their values.
FLUSH = 2_000_000
_BLOB = [("_bin", pa.int32()), ("_blob", pa.binary()), ("_id", pa.int64()), ("_at", pa.list_(pa.int32()))]


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of unsigned 64-bit values, all first bytes before all second ones: what hardly varies compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").reshape(n)


def _packed(f: np.ndarray, ids: np.ndarray, pos: np.ndarray, done: np.ndarray) -> bytes:
    """Fingerprints cut to 48 bits, each with its text's number in a list of ids, its position, and whether it is asked for already."""
    names, which = np.unique(ids, return_inverse=True)
    raw = _planes(f >> U64(16), 6) + _planes(which.astype(U64), 4) + _planes((pos.astype(U64) << U64(1)) | done.astype(U64), 5) + names.tobytes()
    head = np.array([len(f), len(names), len(raw)], np.int64).tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, size = np.frombuffer(blob[:24], np.int64).tolist()
    raw = np.frombuffer(pa.decompress(blob[24:], size, "zstd", asbytes=True), np.uint8)
    which = _unplanes(raw[6 * n : 10 * n], n, 4).astype(np.int64)
    pos = _unplanes(raw[10 * n : 15 * n], n, 5)
    return _unplanes(raw[: 6 * n], n, 6), raw[15 * n :].view(np.int64)[which], (pos >> U64(1)).astype(np.int64), (pos & U64(1)) == 1


def _asked(ids: np.ndarray, pos: np.ndarray, bins: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per text: the positions of its fingerprints that repeat."""
    by = np.lexsort((pos, ids))
    ids, pos = ids[by], pos[by]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    at = lists(pos.astype(np.int32), np.append(first, len(ids)))
    n = len(first)
    where = pa.nulls(n, pa.int32()) if bins is None else pa.array(bins[:n].astype(np.int32))
    return pa.RecordBatch.from_arrays([where, pa.nulls(n, pa.binary()), pa.array(ids[first]), at], schema=pa.schema(_BLOB))


def _shares(f: np.ndarray) -> np.ndarray:
    """Number of each run of equal values of ``f``, which ascends."""
    return np.cumsum(np.concatenate([[False], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)


def _varies(number: np.ndarray, ids: np.ndarray, pos: np.ndarray, places: bool) -> np.ndarray:
    """Whether a run has occurrences in several texts, or in several places of one."""
    head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    other = ids != ids[head][number]
    if places:
        other |= pos != pos[head][number]
    return np.logical_or.reduceat(other, head) if len(head) else np.zeros(0, bool)


def _prints(batches: Iterator[pa.RecordBatch], length: int, gram: int, bins: int, places: bool) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a task's texts, packed by ranges of their values.

    Fingerprints that repeat within the task are asked for at once, and sent on as one occurrence: so what meets at a
    range grows with the tasks that hold a fingerprint, not with its occurrences.
    """
    hasher = Hasher()
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        f, ids, pos = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(f, kind="stable")
        f, ids, pos = f[by], ids[by], pos[by]
        number = _shares(f >> U64(16))
        often = _varies(number, ids, pos, places)[number]
        # Which range a row travels with is of no matter; it is spread.
        yield _asked(ids[often], pos[often], np.arange(len(f)) % bins)
        # Places within one text don't ask for each other unless ``places``: another task's text may ask for all of them.
        head = np.concatenate([[True], number[1:] != number[:-1]]) | ~often
        f, ids, pos, often = f[head], ids[head], pos[head], often[head]
        edge = np.append(np.searchsorted(f, np.array([b * 2**64 // bins for b in range(bins)], U64)), len(f))
        rows = [b for b in range(bins) if edge[b + 1] > edge[b]]
        blobs_ = [_packed(*(x[edge[b] : edge[b + 1]] for x in (f, ids, pos, often))) for b in rows]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs_, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, _BLOB[3][1])], schema=pa.schema(_BLOB))

    for batch in batches:
        scopes = batch.column("_scope").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = batch.column("_id").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in steps(batch.column("_text")):
            words = Words(data, offsets)
            at, f, _, _ = winnow(words, hasher.spans(data, words.start, words.end), length, gram)
            row = np.searchsorted(words.first, at, "right") - 1
            held.append((mix(f ^ scopes[i:j][row]), ids[i:j][row], at - words.first[row]))
            count += len(at)
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
    if count:
        yield from flush()


def _repeated(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    """(_id, _at) of the fingerprints that several texts have, or several places; the rows come ordered by range."""
    held: list[bytes] = []
    now = None

    def settle() -> Iterator[pa.RecordBatch]:
        f, ids, pos, done = (np.concatenate(x) for x in zip(*map(_unpacked, held)))
        by = np.argsort(f, kind="stable")
        f, ids, pos, done = f[by], ids[by], pos[by], done[by]
        number = _shares(f)
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        often = (_varies(number, ids, pos, places) | np.logical_or.reduceat(done, head))[number] & ~done
        yield _asked(ids[often], pos[often])

    for batch in batches:
        told = batch.filter(pc.is_valid(batch.column("_id")))
        if told.num_rows:
            yield told
        rest = batch.filter(pc.is_valid(batch.column("_blob")))
        for b, blob in zip(rest.column("_bin").to_pylist(), rest.column("_blob").to_pylist()):
            if held and b != now:
                yield from settle()
                held = []
            now = b
            held.append(blob)
    if held:
        yield from settle()


def packed(text: pa.Array) -> pa.Array:
    """Each text compressed, with its size before it; null for null."""
    out = [None if t is None else len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True) for t in text.cast(pa.binary()).to_pylist()]
    return pa.array(out, pa.binary())


def unpacked(blob: pa.Array) -> pa.Array:
    out = [None if b is None else pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True) for b in blob.to_pylist()]
    return pa.array(out, pa.binary())


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint that is asked for its context: the words of all windows that choose it.

    A context's text is given once in a task.
    """
    hasher = Hasher()
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        scopes = batch.column("_scope").to_numpy(zero_copy_only=False).view(np.uint64)
        asked = batch.column("_at")
        keys, ords = batch.column("_key"), batch.column("_ord")
        for i, j, data, offsets in steps(unpacked(batch.column("_text"))):
            words = Words(data, offsets)
            at, f, left, right = winnow(words, hasher.spans(data, words.start, words.end), length, gram)
            part = asked[i:j]
            row = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            wanted = np.zeros(len(words.start) + 1, bool)
            wanted[np.minimum(words.first[row] + part.flatten().to_numpy().astype(np.int64), len(words.start))] = True
            mine = wanted[at]
            at, f, left, right = at[mine], f[mine], left[mine], right[mine]
            row = np.searchsorted(words.first, at, "right") - 1
            f = mix(f ^ scopes[i:j][row]).view(np.int64)
            raw = data.tobytes()
            text = [raw[x:y] for x, y in zip(words.start[left].tolist(), words.end[right + length - 1].tolist())]
            hashes = [int.from_bytes(md5(x).digest()[:8], "little", signed=True) for x in text]
            for k, name in enumerate(zip(f.tolist(), hashes)):
                if name in seen:
                    text[k] = None
                elif len(seen) < FLUSH:
                    seen.add(name)
            take, scope = pa.array(row), batch.column("_scope")[i:j]
            for x in range(0, len(text), 20_000):
                y = x + 20_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[x:y]), pa.array(hashes[x:y], pa.int64()), keys[i:j].take(take[x:y]), ords[i:j].take(take[x:y]), pa.array((left - words.first[row])[x:y].astype(np.int32)), pa.array((right - left + length)[x:y].astype(np.int32)), scope.take(take[x:y]), pa.array(text[x:y], pa.binary())],
                    names,
                )


def windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal windows of ``length`` words: (group, context, word) of each window that has a group.

    Only windows that occur at least twice in ``contexts`` are given.
    """
    parts = [c.split() for c in contexts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ids: dict[bytes, int] = {}
    n = len(parts)
    number = ids.setdefault
    stream = np.empty(int(sizes.sum()) + n, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = 0
    for k, p in enumerate(parts):
        stream[at : at + len(p)] = [number(w, len(ids)) for w in p]
        at += len(p)
        stream[at] = -1
        at += 1
    # Separators are smaller than all words and occur once each.
    stream += n
    stream[first[1:] - 1] = np.arange(n)
    order = suffix_array(stream)
    prefix = common_prefixes(stream, order)
    joined = prefix >= length
    edge = np.concatenate([[False], joined, [False]])
    member = edge[:-1] | edge[1:]
    group = np.cumsum(~edge[:-1])[member]
    place = order[member]
    context = np.searchsorted(first, place, "right") - 1
    return group, context, place - first[context]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole fingerprints of a partition sorted by them, about SHARD_TOKENS at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        f = batch.column("_f").to_numpy()
        size = np.cumsum(batch.column("_n").to_numpy())
        new = np.flatnonzero(f[1:] != f[:-1]) + 1
        if held and f[0] != held[-1].column("_f")[-1].as_py():
            new = np.concatenate([[0], new])
        begin = 0
        for at in new.tolist():
            mine = int(size[at - 1] if at else 0) - int(size[begin - 1] if begin else 0)
            if count + mine >= SHARD_TOKENS:
                held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, count, begin = [], 0, at
        held.append(batch.slice(begin))
        count += int(size[-1]) - int(size[begin - 1] if begin else 0)
    if held:
        yield pa.Table.from_batches(held)


def _ranks(*columns: list) -> np.ndarray:
    """Dense ranks of rows by their columns; None comes last."""
    rows = list(zip(*columns))
    at = {r: k for k, r in enumerate(sorted(set(rows), key=lambda r: [(x is None, x) for x in r]))}
    return np.fromiter((at[r] for r in rows), np.int64, len(rows))


def _mark(batches: Iterator[pa.RecordBatch], length: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Spans to remove of each context: (_f, _hash, _spans as begin, end, begin, end ...)."""
    for shard in _shards(batches):
        contexts = shard.column("_ctx").to_pylist()
        group, context, word = windows(contexts, length)
        marks: list[list[int]] = [[] for _ in contexts]
        if first_stays:
            text = _ranks(shard.column("_ford").to_pylist(), shard.column("_fkey").to_pylist())
            place = shard.column("_fpos").to_numpy().astype(np.int64)
        else:
            who, many = shard.column("_who").to_numpy(), shard.column("_many").to_numpy()
            for k in np.flatnonzero(many).tolist():
                # Equal contexts of several texts: all their windows repeat.
                marks[k] = [0, len(contexts[k].split())]
        if len(group):
            scope = shard.column("_scope").to_numpy()[context]
            by = np.lexsort((scope, group))
            group, context, word, scope = group[by], context[by], word[by], scope[by]
            head = np.concatenate([[True], (group[1:] != group[:-1]) | (scope[1:] != scope[:-1])])
            number = np.cumsum(head) - 1
            if first_stays:
                rank, absolute = text[context], place[context] + word
                best = np.lexsort((absolute, rank, number))
                top = best[np.concatenate([[True], np.diff(number[best]) > 0])]
                # The earliest occurrence stays; it may lie in several contexts.
                drop = (rank != rank[top][number]) | (absolute != absolute[top][number])
            else:
                begins = np.flatnonzero(head)
                several = np.minimum.reduceat(who[context], begins) != np.maximum.reduceat(who[context], begins)
                drop = (several | np.logical_or.reduceat(many[context], begins))[number]
            context, word = context[drop], word[drop]
            by = np.lexsort((word, context))
            for k, at in _split(context[by], word[by]):
                marks[k] = marks[k] or _runs(at, length)
        yield from pa.table({"_f": shard.column("_f"), "_hash": shard.column("_hash"), "_spans": pa.array(marks, pa.list_(pa.int32()))}).to_batches()


def _runs(starts: np.ndarray, length: int) -> list[int]:
    """Union of the windows at ``starts``, which ascend, as begin, end, begin, end."""
    gap = np.flatnonzero(np.diff(starts) > length)
    lo = starts[np.concatenate([[0], gap + 1]).astype(np.int64)]
    hi = starts[np.concatenate([gap, [len(starts) - 1]]).astype(np.int64)] + length
    return np.column_stack([lo, hi]).reshape(-1).tolist()


def _split(owner: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(owner):
        edges = np.flatnonzero(np.diff(owner)) + 1
        yield from zip(owner[np.concatenate([[0], edges]).astype(np.int64)].tolist(), np.split(value, edges))


def _found(texts: DataFrame, length: int, gram: int, places: bool) -> DataFrame:
    """All occurrences of repeated fingerprints, with their contexts."""
    spark = texts.sparkSession
    # The first half of a text's MD5 stands for it here; what it can't tell apart is told apart by the whole.
    # A name that is never null, so that the join puts no filter on it before the text, which would compute the text once more.
    named = texts.withColumn("_id", F.coalesce(F.conv(F.hex(F.substring("_key", 1, 8)), 16, -10).cast("long"), F.lit(0)))
    bins = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    flat = named.select("_scope", "_id", "_text").mapInArrow(lambda it: _prints(it, length, gram, bins, places), "_bin int, _blob binary, _id long, _at array<int>")
    often = flat.repartition("_bin").sortWithinPartitions("_bin").mapInArrow(lambda it: _repeated(it, places), "_bin int, _blob binary, _id long, _at array<int>")
    asked = store(often.groupBy("_id").agg(F.flatten(F.collect_list("_at")).alias("_at")))
    small = named.withColumn("_text", F.arrow_udf(packed, "binary")(F.col("_text")))
    once = small.join(asked, "_id").groupBy("_id", "_key").agg(
        F.min("_ord").alias("_ord"), F.first("_scope").alias("_scope"), F.first("_text").alias("_text"), F.first("_at").alias("_at")
    )
    names = ["_f", "_hash", "_key", "_ord", "_pos", "_n", "_scope", "_ctx"]
    kind = texts.schema["_ord"].dataType.simpleString()
    return once.mapInArrow(lambda it: _contexts(it, length, gram, names), f"_f long, _hash long, _key binary, _ord {kind}, _pos int, _n int, _scope long, _ctx binary")


def repeated_spans(texts: DataFrame, length: int, gram: int, first_stays: bool) -> DataFrame:
    """(_key, _spans): ranges of words of ``texts`` (_scope long, _ord, _key binary of 16 bytes, _text) that repeat.

    Rows of one ``_key`` have one text and scope. Spans are begin, end, begin, end and so on, and may overlap;
    their union is that of all repeated windows of ``length`` words. Windows repeat within a ``_scope``. With
    ``first_stays`` the earliest occurrence, by (_ord, _key, position), is left out; else all
    occurrences of windows that at least two keys hold are given.
    """
    if not 1 < gram <= length:
        raise ValueError("a fingerprint has at least two words and at most those of a window")
    found = store(_found(texts, length, gram, first_stays))
    place = F.struct(F.col("_ord").isNull().alias("n"), F.col("_ord").alias("o"), F.col("_key").alias("k"), F.col("_pos").alias("p"))
    text = [F.first("_scope").alias("_scope"), F.first("_ctx", ignorenulls=True).alias("_ctx"), F.first("_n").alias("_n")]
    if first_stays:
        same = store(found.groupBy("_f", "_hash").agg(F.min(place).alias("_first"), *text))
        whose = [F.col("_first.o").alias("_ford"), F.col("_first.k").alias("_fkey"), F.col("_first.p").alias("_fpos")]
    else:
        who = F.xxhash64("_key")
        same = store(found.groupBy("_f", "_hash").agg(F.min(who).alias("_who"), (F.min(who) != F.max(who)).alias("_many"), *text))
        whose = ["_who", "_many"]
    shards = same.select("_f", "_scope", "_hash", "_ctx", "_n", *whose).repartition("_f").sortWithinPartitions("_f")
    marks = shards.mapInArrow(lambda it: _mark(it, length, first_stays), "_f long, _hash long, _spans array<int>")
    marks = store(marks.join(same.select("_f", "_hash", "_first"), ["_f", "_hash"]) if first_stays else marks.where(F.size("_spans") > 0))
    discard(same)
    told = found.select("_f", "_hash", "_key", "_pos", *([F.col("_n"), place.alias("_place")] if first_stays else [])).join(marks, ["_f", "_hash"])
    if first_stays:
        # Equal contexts after the first are repeats from end to end.
        told = told.withColumn("_spans", F.when(F.col("_place") == F.col("_first"), F.col("_spans")).otherwise(F.array(F.lit(0), F.col("_n"))))
        told = told.where(F.size("_spans") > 0)
    moved = F.transform("_spans", lambda x: x + F.col("_pos"))
    spans = store(told.groupBy("_key").agg(F.flatten(F.collect_list(moved)).alias("_spans")))
    discard(found)
    discard(marks)
    return spans


def without(words: Words, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes kept, offsets): texts less the words of ``spans`` and the white space behind each of these."""
    flat = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    b, e = flat[::2], flat[1::2]
    size = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(spans)), size // 2)
    gone = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(gone, words.first[row] + b, 1)
    np.add.at(gone, words.first[row] + e, -1)
    gone = np.cumsum(gone)[:-1] > 0
    # A word's bytes reach to the next word of its text, or to the text's end.
    nxt = np.append(words.start[1:], len(words.data))
    nxt = np.minimum(nxt, words.offsets[1:][words.owner()])
    cover = np.zeros(len(words.data) + 1, np.int32)
    cover[words.start[gone]] += 1
    np.add.at(cover, nxt[gone], -1)
    keep = np.cumsum(cover)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return words.data[keep], kept[words.offsets]


def _cut_text(text: pa.Array, spans: pa.Array) -> pa.Array:
    """``text`` less its words in ``spans``; null where ``spans`` is."""
    out = []
    for i, j, data, offsets in steps(text):
        kept, at = without(Words(data, offsets), spans[i:j])
        part = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
        out.append(pc.if_else(pc.is_valid(spans[i:j]), part, None))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def drop_repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with every passage of at least ``length`` words that repeats left in one place only.

    A window of ``length`` words (runs of other characters than ASCII white space, compared exactly)
    stays where it is found first: in the document with the least ``doc_id`` (null last; among equal
    ids in the text of least MD5), at its least position. All words of its other occurrences go,
    with the white space behind them; so of two equal documents of at least ``length`` words the second
    keeps its row, with an empty text. ``n_chars``, if there, is the new length of changed texts.

    Defined cases: null, empty and short texts stay as they are; rows that repeat with the same
    ``doc_id`` and text keep the text once; in a text that repeats itself the overlapping later
    windows go, whatever they share with the first; long texts are searched whole; ``doc_id`` is of any type that has
    an order; all other columns pass through whatever their
    names; an empty table gives an empty one.
    """
    names = docs.columns
    key, row, new = (unused(x, names) for x in ("_key", "_row", "_new"))
    told = docs.withColumn(key, F.unhex(F.md5("text")))
    texts = told.where(F.col("text").isNotNull()).select(
        F.lit(0).cast("long").alias("_scope"), F.col("doc_id").alias("_ord"), F.col(key).alias("_key"), F.col("text").alias("_text")
    )
    spans = repeated_spans(texts, length, gram, first_stays=True)
    spans = spans.select(F.col("_key").alias(key), F.col("_spans").alias(new))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_last(), row_hash(docs)))
    whole = told.where(F.col("text").isNotNull()).join(spans, key, "left").withColumn(row, first)
    again = (F.col(row) > 1) & (F.regexp_count("text", F.lit(r"[^ \t\n\r\x0B\f]+")) >= length)
    # Only texts that change go through Python.
    edit = F.arrow_udf(_cut_text, "string")
    part = edit(F.when(F.col(new).isNotNull(), F.col("text")), F.col(new))
    whole = whole.withColumn(new, F.when(again, F.lit("")).otherwise(F.coalesce(part, F.col("text"))))
    out = [F.col(f"`{c}`") for c in names]
    for at, c in enumerate(names):
        if c == "text":
            out[at] = F.col(new).alias(c)
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out[at] = F.when(F.col(new) == F.col("text"), F.col(c)).otherwise(F.length(new).cast(kind)).alias(c)
    return whole.select(*out).unionByName(docs.where(F.col("text").isNull()))
