"""Mixing sources to target weights: hierarchical budgeting over a domain - language - source tree.

Budgets run down the tree. At each node the budget is split among the children in proportion to
their weights; a child that holds fewer tokens (times ``max_epochs``) than its share gives the
rest back, and its siblings share it by weight. Only what a node's children cannot take
together reaches the node's own siblings: a node never receives more than its leaves hold, so
shortages are met among siblings before ancestors. This water filling has a closed form over
the children sorted by capacity / weight, so each level is one window over a table of nodes.

A leaf with ``t`` tokens and budget ``b`` gives ``b div t`` whole epochs, then of the next epoch
the prefix, in that epoch's seeded order, that reaches the remaining ``b mod t`` tokens.
The order is that of a hash, so the prefix is "hash up to a cut": hash ranges are summed first,
only the one range that holds the cut is sorted, and documents are then chosen where they
lie, without a shuffle of their texts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Nodes of the tree up to which the plan of budgets is broadcast; a larger plan is joined by a shuffle.
BROADCAST_LEAVES = 50_000

TREE = ("_domain", "_lang", "_source")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _weight(weights: Mapping[tuple[str, ...], int], path: list[str]) -> Column:
    mine = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not mine:
        return F.lit(1).cast("long")
    cases = reduce(
        lambda c, kv: c.when(reduce(lambda a, b: a & b, [F.col(n) == F.lit(x) for n, x in zip(path, kv[0])]), F.lit(kv[1])),
        mine.items(), F,
    )
    return cases.otherwise(F.lit(1)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``_budget`` of each parent among its rows by ``_w``, none above ``_cap``, in whole tokens."""
    order = [F.col("_cap") / F.col("_w"), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order)
    every = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_full", (F.col("_cap") * after <= (F.col("_budget") - before) * F.col("_w")).cast("int"))
    nodes = nodes.withColumn("_full", F.min("_full").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nodes = nodes.withColumn("_left", F.col("_budget") - F.sum(F.col("_cap") * F.col("_full")).over(every))
    nodes = nodes.withColumn("_wleft", F.sum(F.col("_w") * (1 - F.col("_full"))).over(every))
    share = F.when(F.col("_full") == 1, F.col("_cap")).otherwise(F.expr("(_left * _w) div _wleft"))
    return nodes.withColumn("_budget", share).drop("_full", "_left", "_wleft", "_w", "_cap")


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Token budgets of ``leaves`` (the tree's columns and ``_tokens``); the root's budget is
    ``share[0] / share[1]`` of all tokens, or all that ``max_epochs`` allow if that is less."""
    leaves = leaves.withColumn("_leafcap", F.col("_tokens") * max_epochs)
    total = leaves.agg(F.least(F.expr(f"(sum(_tokens) * {share[0]}L) div {share[1]}L"), F.sum("_leafcap")).alias("_budget"))
    up: list[str] = []
    held = total
    for name in TREE:
        path = [*up, name]
        nodes = leaves.groupBy(*path).agg(F.sum("_leafcap").alias("_cap")).withColumn("_w", _weight(weights, path))
        nodes = nodes.join(held, up) if up else nodes.crossJoin(held)
        held = _fill(nodes, up, name)
        up = path
    return held.join(leaves.drop("_leafcap"), list(TREE))


def mix_sources(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[tuple[str, ...], int],
    *,
    share: tuple[int, int] = (6, 10),
    max_epochs: int = 4,
    seed: int = 7,
    epoch_column: str | None = "epoch",
) -> DataFrame:
    """The documents of the mixture: all columns of ``docs``, one row per epoch that takes it.

    ``weights`` maps a path - (domain,), (domain, lang) or (domain, lang, source) - to a positive
    integer of at most 10 000; paths that it lacks weigh 1. A document's tokens are its runs of other
    characters than space, tab, line and page breaks.

    Defined cases: a null domain, language or source is the empty name; rows without tokens
    (null, empty or blank text) are never chosen; ``doc_id`` may be null or repeated, and rows
    that repeat with the same id and text are chosen together; the document that a cut falls on is
    taken whole; budgets are rounded down to whole tokens; an empty table gives an empty one.
    Other columns pass through whatever their names; a column of the name ``epoch_column`` (counted
    from 0) is replaced. With None, no epoch column is added.
    """
    names = docs.columns
    dom, lang, src, tok, key, epoch = (unused(x, names) for x in ("_domain", "_lang", "_source", "_tokens", "_key", "_epoch"))
    known = docs.withColumns({
        dom: F.coalesce(domain, F.lit("")), lang: F.coalesce(F.col("lang").cast("string"), F.lit("")), src: F.coalesce(F.col("source").cast("string"), F.lit("")),
        tok: tokens(F.col("text")),
        key: F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))),
    }).where(F.col(tok) > 0)
    base = cut(known.select(F.col(dom).alias("_domain"), F.col(lang).alias("_lang"), F.col(src).alias("_source"), F.col(tok).alias("_tokens"), F.col(key).alias("_key")))
    leaves = base.groupBy(*TREE).agg(F.sum("_tokens").alias("_tokens"))
    plan = cut(
        budgets(leaves, weights, share, max_epochs)
        .withColumn("_epochs", F.expr("_budget div _tokens")).withColumn("_rest", F.col("_budget") % F.col("_tokens"))
        .select(*TREE, "_epochs", "_rest")
    )
    small = plan.count() <= BROADCAST_LEAVES
    near = F.broadcast if small else (lambda x: x)
    ekey = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.col("_key")))
    part = base.join(near(plan.where("_rest > 0")), list(TREE)).withColumn("_ekey", ekey).withColumn("_range", F.substring("_ekey", 1, 3))
    ranges = part.groupBy(*TREE, "_range", "_rest").agg(F.sum("_tokens").alias("_sum"))
    w = Window.partitionBy(*TREE).orderBy("_range")
    ranges = ranges.withColumn("_to", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("_sum"))
    ranges = ranges.where((F.col("_from") < F.col("_rest")) & (F.col("_rest") <= F.col("_to"))).select(*TREE, "_range", "_from")
    last = part.join(near(ranges) if small else ranges, [*TREE, "_range"]).groupBy(*TREE, "_ekey", "_rest", "_from").agg(F.sum("_tokens").alias("_sum"))
    w = Window.partitionBy(*TREE).orderBy("_ekey")
    last = last.withColumn("_from", F.col("_from") + F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = last.where(F.col("_from") < F.col("_rest")).groupBy(*TREE).agg(F.max("_ekey").alias("_cut"))
    chosen = cut(plan.join(near(cuts), list(TREE), "left"))
    up = {"_domain": dom, "_lang": lang, "_source": src}
    on = [known[up[c]] == F.col(f"p.{c}") for c in TREE]
    out = known.join(near(chosen.alias("p")), on).withColumn(
        epoch,
        F.concat(
            F.when(F.col("p._epochs") > 0, F.sequence(F.lit(0), F.col("p._epochs").cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            F.when(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("p._epochs").cast("string"), known[key])) <= F.col("p._cut"), F.array(F.col("p._epochs").cast("int"))).otherwise(F.array().cast("array<int>")),
        ),
    ).withColumn(epoch, F.explode(epoch))
    keep = [known[f"`{c}`"] for c in names if epoch_column is None or c.lower() != epoch_column.lower()]
    return out.select(*keep, *([] if epoch_column is None else [F.col(epoch).alias(epoch_column)]))


#: The tree of the query: domains by source, weights by path.
DOMAINS = {"web": [f"src{i}" for i in range(0, 5)], "books": [f"src{i}" for i in range(5, 10)], "code": [f"src{i}" for i in range(10, 15)]}
WEIGHTS = {
    ("web",): 4, ("books",): 3, ("code",): 2, ("reference",): 1,
    ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 1,
    ("books", "en"): 2, ("code", "en"): 8, ("web", "en", "src0"): 2, ("books", "de", "src7"): 6, ("books", "en", "src5"): 12,
}


def domain_of(source: Column) -> Column:
    cases = F
    for name, members in DOMAINS.items():
        cases = cases.when(source.isin(members), F.lit(name))
    return cases.otherwise(F.lit("reference"))


def _sql_case(names: list[str]) -> str:
    mine = {k: v for k, v in WEIGHTS.items() if len(k) == len(names)}
    cases = " ".join("when " + " and ".join(f"{n} = '{x}'" for n, x in zip(names, k)) + f" then {v}" for k, v in mine.items())
    return f"(case {cases} else 1 end)::bigint"


def _sql_level(level: int) -> str:
    names = ["dom", "lng", "src"][: level + 1]
    up, name = names[:-1], names[-1]
    part = f"partition by {', '.join(up)}" if up else ""
    held = f"join b{level - 1} using ({', '.join(up)})" if up else "cross join b"
    cols = ", ".join(names)
    return f"""
 n{level} as (select *, {_sql_case(names)} w from (select {cols}, sum(cap)::bigint cap from leaves group by all) {held}),
 f{level} as (select *, (cap * sum(w) over ({part} order by cap / w, {name} rows between current row and unbounded following)
   <= (budget - coalesce(sum(cap) over ({part} order by cap / w, {name} rows between unbounded preceding and 1 preceding), 0)) * w)::int ok from n{level}),
 g{level} as (select *, min(ok) over ({part} order by cap / w, {name} rows unbounded preceding) sat from f{level}),
 h{level} as (select *, budget - sum(cap * sat) over ({part or ''}) lft, sum(w * (1 - sat)) over ({part or ''}) wl from g{level}),
 b{level} as (select {cols}, (case when sat = 1 then cap else (lft * w) // wl end)::bigint budget from h{level})"""


def oracle(share: tuple[int, int] = (6, 10), max_epochs: int = 4, seed: int = 7, documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars, epoch") -> str:
    """The mixture in DuckDB's SQL, with a plain running sum over each leaf."""
    domain = "case " + " ".join(f"when source in ({', '.join(repr(m) for m in ms)}) then '{d}'" for d, ms in DOMAINS.items()) + " else 'reference' end"
    return f"""
with base as (select *, {domain} dom, coalesce(lang, '') lng, coalesce(source, '') src, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::bigint tok,
   md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || text) k from {documents}),
 base1 as (select * from base where tok > 0),
 leaves as (select dom, lng, src, sum(tok)::bigint t, (sum(tok) * {max_epochs})::bigint cap from base1 group by all),
 b as (select least((sum(t) * {share[0]}) // {share[1]}, sum(cap))::bigint budget from leaves),{','.join(_sql_level(i) for i in range(3))},
 plan as (select dom, lng, src, budget // t eps, budget % t rest from b2 join leaves using (dom, lng, src)),
 keyed as (select *, md5('{seed}:' || eps::varchar || ':' || k) ek from base1 join plan using (dom, lng, src)),
 run as (select *, sum(tok) over (partition by dom, lng, src order by ek range unbounded preceding) - sum(tok) over (partition by dom, lng, src, ek) bef from keyed),
 eps as (select *, list_concat(range(0, eps), case when bef < rest then [eps] else [] end) es from run)
select {columns} from (select * exclude (es), unnest(es)::int epoch from eps)"""
