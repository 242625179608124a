"""URL filters by a tree of path templates per host.

The path of a URL is its segments and, as a last one, the names of its query's parameters. Runs of digits
become ``#`` and hexadecimal identifiers ``{hex}``. The tree is then built from the root: the
branches below a node that few URLs take are variable and become ``*``; of the others, those that
are statistically like all of their siblings together - in the share of good labels, by a test of two
proportions, and in the depth below - are merged into ``*`` too; the rest keep their names. A URL's
template is rejected if its purity, the share of good labels drawn towards its host's and that towards the
whole table's, is too low.

URLs are reduced to counts by generalised path first, so each level of the tree works on a table of
distinct paths: two aggregations, whatever the number of URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Fewest URLs with which a branch keeps a name of its own, whatever its siblings have.
SUPPORT = 5
#: Largest test statistic and difference of mean depth with which a branch is like its siblings.
ALIKE_Z, ALIKE_DEPTH = 2.58, 0.5
#: Labels' worth of its host's purity that a template has, and of the table's that a host has.
PRIOR = 10.0
LEAST_PURITY = 0.5


def host_of(url: Column) -> Column:
    """Lower-cased host without port and credentials; the empty string if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Generalised segments of a URL's path and its sorted parameter names."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(
        segments,
        lambda s: F.when(
            s.rlike(r"^(?=.*\d)(?:[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$") & ~s.rlike(r"^\d+$"), F.lit("{hex}")
        ).otherwise(F.regexp_replace(s, r"\d+", "#")),
    )
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))), lambda p: p != "")))
    return F.concat(segments, F.when(F.size(names) > 0, F.array(F.concat(F.lit("?"), F.array_join(names, "&")))).otherwise(F.array().cast("array<string>")))


def _level(paths: DataFrame, i: int) -> DataFrame:
    """``paths`` (_host, _segs, _prefix, _n, _lab, _good) of more than ``i`` segments, with the names of their branches at depth ``i``."""
    seg = F.get("_segs", F.lit(i))
    at = paths.withColumn("_seg", seg)
    below = (F.size("_segs") - i) * F.col("_n")
    branches = at.groupBy("_host", "_prefix", "_seg").agg(F.sum("_n").alias("_n"), F.sum("_lab").alias("_lab"), F.sum("_good").alias("_good"), F.sum(below).alias("_deep"))
    w = Window.partitionBy("_host", "_prefix")
    branches = branches.select("*", *[F.sum(c).over(w).alias(f"{c}_all") for c in ("_n", "_lab", "_good", "_deep")], F.count(F.lit(1)).over(w).alias("_sib"))
    rare = F.col("_n") < SUPPORT
    others, pool = F.col("_lab_all") - F.col("_lab"), F.try_divide(F.col("_good_all"), F.col("_lab_all"))
    gap = F.abs(F.try_divide(F.col("_good"), F.col("_lab")) - F.try_divide(F.col("_good_all") - F.col("_good"), others))
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("_lab")) + F.try_divide(F.lit(1.0), others)))
    alike = F.coalesce(gap <= ALIKE_Z * error, F.lit(True)) & (F.abs(F.col("_deep") / F.col("_n") - F.col("_deep_all") / F.col("_n_all")) <= ALIKE_DEPTH)
    branches = branches.withColumn("_join", ((F.col("_sib") > 1) & (rare | alike)).cast("int")).withColumn("_joined", F.sum("_join").over(w))
    name = F.when((F.col("_join") == 1) & (F.col("_joined") > 1), F.lit("*")).otherwise(F.col("_seg"))
    named = branches.select("_host", "_prefix", "_seg", name.alias("_name"))
    on = ["_host", "_prefix", "_seg"]
    moved = at.join(named, on).withColumn("_prefix", F.concat("_prefix", F.lit("/"), "_name"))
    return moved.select(*paths.columns)


def templates(urls: DataFrame) -> DataFrame:
    """(_host, _segs, _template, _purity) of ``urls`` (_host, _segs, _label: 1, 0 or null)."""
    paths = cut(urls.groupBy("_host", "_segs").agg(F.count(F.lit(1)).alias("_n"), F.count("_label").alias("_lab"), F.coalesce(F.sum("_label"), F.lit(0)).cast("long").alias("_good")).withColumn("_prefix", F.lit("")))
    depth = paths.agg(F.max(F.size("_segs"))).first()[0] or 0
    # Paths that have ended are set aside, so that a few very deep ones don't carry the others along.
    ended = []
    for i in range(depth):
        done, paths = paths.where(F.size("_segs") <= i), paths.where(F.size("_segs") > i)
        ended.append(done)
        paths = cut(_level(paths, i))
    paths = cut(reduce(DataFrame.unionByName, ended, paths))
    labels = ["_lab", "_good"]
    table = paths.agg(F.coalesce(F.sum("_good") / F.nullif(F.sum("_lab"), F.lit(0)), F.lit(1.0)).alias("_p0"))
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in labels]).crossJoin(table)
    hosts = hosts.select("_host", ((F.col("_good") + PRIOR * F.col("_p0")) / (F.col("_lab") + PRIOR)).alias("_ph"))
    pure = paths.groupBy("_host", "_prefix").agg(*[F.sum(c).alias(c) for c in labels]).join(hosts, "_host")
    pure = pure.select("_host", "_prefix", ((F.col("_good") + PRIOR * F.col("_ph")) / (F.col("_lab") + PRIOR)).alias("_purity"))
    return cut(paths.select("_host", "_segs", "_prefix").join(pure, ["_host", "_prefix"]).select("_host", "_segs", F.concat("_host", "_prefix").alias("_template"), "_purity"))


def filter_urls(urls: DataFrame, labels: Column, *, least_purity: float = LEAST_PURITY, url: str = "url") -> DataFrame:
    """``urls`` with ``template``, ``purity`` and ``rejected``, replacing columns of these names.

    ``labels`` is 1 for good rows, 0 for bad ones and null where nothing is known.

    Defined cases: a null URL has a null template and purity and is not rejected; a URL without a host
    has the empty host; without any label all purities are 1; repeated rows count as often as they
    occur; a node with a single branch keeps its name; branches tied at a bound count as alike; paths may have any number
    of segments, each of any length; all other columns pass through whatever their names; an empty table gives an empty one.
    """
    names = urls.columns
    host, segs, label = (unused(x, names) for x in ("_host", "_segs", "_label"))
    known = urls.withColumns({host: host_of(F.col(url)), segs: path_of(F.col(url)), label: labels.cast("int")})
    found = templates(known.where(F.col(url).isNotNull()).select(F.col(host).alias("_host"), F.col(segs).alias("_segs"), F.col(label).alias("_label"))).alias("t")
    out = known.join(found, (known[host] == F.col("t._host")) & (known[segs] == F.col("t._segs")), "left")
    keep = [known[f"`{c}`"] for c in names if c.lower() not in ("template", "purity", "rejected")]
    return out.select(*keep, F.col("t._template").alias("template"), F.col("t._purity").alias("purity"), F.coalesce(F.col("t._purity") < least_purity, F.lit(False)).alias("rejected"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages' ids and URLs with ``good``, by the document whose number is the last of the URL's path."""
    doc = F.try_to_number(F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"(\d+)\D*$", 1), F.lit("9" * 18)).cast("long")
    good = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return pages.select("page_id", "url", doc.alias("_doc")).join(good, F.col("_doc") == good["doc_id"], "left").select("page_id", "url", "good")
