"""Byte-level BPE: encoding by folds of ranked merges, decoding by concatenation, all of it in the JVM.

Texts are cut into words by the vocabulary's pattern. A word's bytes become the ids of their pieces, and this array is
folded: as long as two neighbours together are a piece of the vocabulary, the pair of least rank is merged, leftmost
first. A piece's id is its rank, so the rank of a pair is the id that it becomes, and pairs of ids are the keys of the
literal rank map: an array of small maps, chosen by bits of the key, since Spark looks through
the keys of a map one by one. Lambdas are interpreted, and what they mention twice is computed twice: so
keys are elements of an array and looked up by a lambda over it, and a word's bounds stand in its array as an id that
joins nothing. Every merge leaves pieces of the vocabulary, so the pairs of pieces whose join is a piece
are all that is ever looked up.

The distinct words of all documents are counted, and the most frequent ones folded once; what they
encode to are two literals of the same form, a small one and that of the rest. All other words are folded
where they stand, by the same expression, so the table's size only decides how often a fold is
repeated. No word is shuffled back to its document, and no document is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from .common import _release, store, unused

#: Words whose codes are kept in literals, and those of them that have one of their own: it stays in a core's cache, where nearly all words are found.
CACHE, HOT = 524_288, 8_192
#: Words for each map of a literal of more than ``HOT`` words: a map and its empty places take half as many bytes as a word, in the plan and in each copy that the driver ships.
CROWD = 4

#: White space is Unicode's, as the vocabulary's own pattern has it.
_WS = r"\p{IsWhite_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+"


def read_ranks(path: str | Path) -> dict[bytes, int]:
    """The vocabulary of a file with a base64 piece and its rank on each line; a piece's id is its rank."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in pairs}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _constant(rows: DataFrame) -> Column:
    """The one value of ``rows``, an array, as a literal in Spark's binary row format.

    Catalyst compares, prints and ships it as a block of bytes; as nested literals or JSON text the same
    tables would take the optimiser seconds for every mention.
    """
    plan = rows._jdf.queryExecution()
    # Of its own bytes, not a part of the row's: such a part is copied whenever a plan that has it is shipped.
    data = plan.executedPlan().executeCollect()[0].getArray(0).copy()
    jvm = rows.sparkSession._jvm.org.apache.spark.sql
    literal = jvm.catalyst.expressions.Literal(data, plan.analyzed().schema().apply(0).dataType())
    return ClassicColumn(jvm.classic.ExpressionUtils.column(literal))


def _values(spark: SparkSession, value: list, kind: str) -> Column:
    return _constant(spark.createDataFrame([(value,)], f"x {kind}").coalesce(1))


def _places(n: int) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, n - 1).bit_length()


def _slot(key: Column, n: int) -> Column:
    """The place of a string among ``n``, a power of two."""
    return F.hash(key).bitwiseAND(F.lit(n - 1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, as the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _joined(*parts: Column) -> Column:
    """Concatenation of arrays; within lambdas ``flatten`` is several times as fast as ``concat``."""
    return F.flatten(F.array(*parts))


def as_latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


#: Bits of an id, a number beyond all ids, and the id of the word's bounds, which no piece has.
_SHIFT = 20
_NONE = 1 << _SHIFT
_BOUND = _NONE - 1
#: A pair's key is its left id before its right one; the left one is laid over the right one from this many bits on to choose a map.
_FOLD = 13


class Codec:
    """Column expressions of one vocabulary, whose ids are its ranks, from 0 without a gap."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]) -> None:
        if {bytes([b]) for b in range(256)} - ranks.keys():
            raise ValueError("a byte-level vocabulary has a piece for every byte")
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks count up from 0")
        if len(ranks) > _BOUND:
            raise ValueError(f"a vocabulary has at most {_BOUND} pieces")
        n = 4 * _places(len(ranks))
        pairs: list[dict] = [{} for _ in range(n)]
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    key = (left << _SHIFT) + right
                    pairs[(key ^ key >> _FOLD) & n - 1][key] = (rank << _SHIFT) + left
        single = [bytes([b]) for b in range(256)]
        first = [(ranks.get(x + y, _NONE) << _SHIFT) + ranks[x] for x in single for y in single]
        self.pairs = _values(spark, pairs, "array<map<bigint,bigint>>"), n
        self.first = _values(spark, first, "array<bigint>")
        self.last = _values(spark, [(_NONE << _SHIFT) + ranks[x] for x in single], "array<bigint>")
        self.pieces = _values(spark, [p.decode("latin-1") for p in sorted(ranks, key=ranks.__getitem__)], "array<string>")
        known = spark.createDataFrame([(p.decode("latin-1"), [r]) for p, r in ranks.items()], "_w string, _c array<int>")
        self.whole = _table(spark, known, len(ranks))
        self.cached: list[tuple[Column, int]] = []

    def _held(self, pair: Column) -> Column:
        """A pair's left piece in the state of a fold: what both become, or ``_NONE``, and itself, in one number."""
        maps, n = self.pairs
        found = F.try_element_at(F.get(maps, pair.bitwiseXOR(F.shiftright(pair, _FOLD)).bitwiseAND(F.lit(n - 1))), pair)
        return F.coalesce(found, F.shiftright(pair, _SHIFT) + F.lit(_NONE << _SHIFT))

    def fold(self, word: Column) -> Column:
        """Ids of one word, given byte for character."""

        def own(x: Column) -> Column:
            return x.bitwiseAND(F.lit(_NONE - 1))

        def step(s: Column, _: Column) -> Column:
            def at(i: Column) -> Column:
                least = F.get(s, i - 1)
                best = F.shiftright(least, _SHIFT)
                pairs = F.array(F.shiftleft(own(F.get(s, i - 2)), _SHIFT) + best, F.shiftleft(best, _SHIFT) + own(F.get(s, i + 1)))
                merged = _joined(F.slice(s, F.lit(1), i - 2), F.transform(pairs, self._held), F.slice(s, i + 2, F.lit(_NONE * 1024)))
                return F.when(least < _NONE << _SHIFT, merged).otherwise(s)

            # The least of what neighbours would become decides, the leftmost of equal ones: these are the same pair.
            return _let(F.array_position(s, F.array_min(s)).cast("int"), at)

        bound = F.array(F.lit((_NONE << _SHIFT) + _BOUND))
        single = F.transform(F.split(word, ""), lambda c: F.ascii(c))
        turns = F.when(F.char_length(word) > 1, F.sequence(F.lit(2), F.char_length(word))).otherwise(F.array().cast("array<int>"))
        start = _let(single, lambda p: F.transform(p, lambda x, i: F.coalesce(F.get(self.first, F.shiftleft(x, 8) + F.get(p, i + 1)), F.get(self.last, x))))
        folded = F.aggregate(turns, _joined(bound, start, bound), step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: own(x).cast("int")))
        return F.coalesce(_lookup(self.whole, word), folded)

    def encode(self, text: Column) -> Column:
        """Ids of a text; null for a null text."""

        def code(w: Column) -> Column:
            folded = self.fold(as_latin(w.cast("binary")))
            return F.coalesce(*(_lookup(table, w) for table in self.cached), folded)

        return F.flatten(F.transform(words(text), code))

    def decode(self, ids: Column) -> Column:
        """The bytes that ``ids`` stand for; null if an id is null or not of the vocabulary."""
        other = "\uffff"  # no byte
        joined = F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "", other)
        return _let(joined, lambda j: F.when(~F.contains(j, F.lit(other)), F.encode(j, "ISO-8859-1")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def codec(spark: SparkSession, docs: DataFrame, path: str | None = None, cache: int = CACHE) -> Codec:
    """A codec whose cache holds the most frequent words of all of ``docs``, at most ``cache`` and all that are as frequent as any of them."""
    made = Codec(spark, read_ranks(path or default_vocabulary()))
    if cache:
        found = store(docs.select(F.explode(words(F.col("text"))).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n")))
        # The frequency from which on there are few enough words: no sort of all of them, and no limit in one task.
        sizes = Window.orderBy(F.col("_n").desc())
        often = found.groupBy("_n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.sum("_m").over(sizes))
        done, below = 0, F.lit(True)
        for most in (min(HOT, cache), cache):
            least = often.where(F.col("_upto") <= most).orderBy("_n").first()
            if least is not None and least._upto > done:
                top = found.where((F.col("_n") >= least._n) & below).repartition(8)
                made.cached.append(_table(spark, top.select("_w", made.fold(as_latin(F.col("_w").cast("binary"))).alias("_c")), least._upto - done))
                done, below = least._upto, F.col("_n") < least._n
        _release(spark)  # What made the tables goes before the plan that has them is shipped.
    return made


def _table(spark: SparkSession, coded: DataFrame, size: int) -> tuple[Column, int]:
    """A literal of ``coded`` (_w, _c), of about one word for each of its places, or ``CROWD`` in a large one."""
    n = _places(max(min(size, HOT), -(-size // CROWD)))
    maps = coded.groupBy(_slot(F.col("_w"), n).alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_c"))).alias("_m"))
    slots = spark.range(n).select(F.col("id").cast("int").alias("_b")).join(maps, "_b", "left")
    one = slots.agg(F.array_sort(F.collect_list(F.struct("_b", "_m")), lambda x, y: x["_b"] - y["_b"]).alias("_s"))
    return _constant(one.select(F.transform("_s", lambda x: x["_m"]).alias("x"))), n


def _lookup(table: tuple[Column, int], word: Column) -> Column:
    maps, n = table
    return F.try_element_at(F.get(maps, _slot(word, n)), word)


def encode_documents(docs: DataFrame, *, path: str | None = None, cache: int = CACHE, check: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): the ids of every text.

    ``round_trip`` tells whether decoding gives back the text's bytes.

    Defined cases: a null text has null tokens and a null round trip, an empty text no tokens; each row
    is encoded on its own, so ids may be null or repeat; further columns are not read; an empty
    table gives an empty one. A word without a break is folded in time quadratic in its bytes.
    """
    made = codec(docs.sparkSession, docs, path, cache)
    name = unused("_text", ["doc_id", "tokens"])
    out = docs.select("doc_id", F.col("text").alias(name), made.encode(F.col("text")).alias("tokens"))
    out = out.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")))
    if check:
        out = out.withColumn("round_trip", F.col(name).cast("binary") == made.decode(F.col("tokens")))
    return out.drop(name)
