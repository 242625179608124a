"""HTML extraction: what a page has to itself, after what its host repeats is cut away.

A page becomes a stream of tokens, tags without attributes and words, once scripts, styles and
comments are gone. Runs of at least ``length`` tokens that occur in two distinct pages of a host are
boilerplate - menus, banners, footers. They are found with the suffix arrays of ``suffix_array``,
within each host: a host's pages are never gathered in one place, only the surroundings of
token runs that repeat are, by run. What no repeated run covers is kept, without its tags.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, steps, unused
from .suffix_array import repeated_spans, without
from .url_filter import host_of

#: Tokens of a run that is boilerplate if it repeats, and of a fingerprint.
LENGTH, GRAM = 12, 4

_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)>", re.I)
#: Comments, scripts and the like, and declarations, whichever begins first.
_UNSEEN = r"(?is)<(?:!--(?:[^-]++|-(?!->))*+(?:-->|$)|(script|style|noscript|template)\b[^>]*+>(?:[^<]++|<(?!/\1\s*+>))*+(?:</\1\s*+>|$)|[!?][^>]*+>)"
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:_-]*>")


def stream_of(page: Column) -> Column:
    """The page's tokens, apart by spaces."""
    page = F.regexp_replace(page, _UNSEEN, " ")
    page = F.regexp_replace(page, r"""<(/?[A-Za-z][A-Za-z0-9:_-]*+)(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""", " <$1> ")
    return page


def plain_text(stream: str) -> str:
    """Text of a stream: block tags end lines, other tags go, entities are resolved."""
    lines = _TAG.sub("", _BLOCK.sub("\n", stream)).split("\n")
    return "\n".join(x for x in (" ".join((html.unescape(line) if "&" in line else line).split()) for line in lines) if x)


def _extract(stream: pa.Array, spans: pa.Array) -> pa.Array:
    out: list[str | None] = []
    valid = pc.is_valid(stream).to_pylist()
    for i, j, data, offsets in steps(stream):
        kept, at = without(Words(data, offsets), spans[i:j])
        raw = np.ascontiguousarray(kept).tobytes()
        out += [plain_text(raw[a:b].decode("utf-8", "replace")) if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid[i:j])]
    return pa.array(out, pa.string())


def extract_unique(pages: DataFrame, *, length: int = LENGTH, gram: int = GRAM, output: str = "text") -> DataFrame:
    """``pages`` (url, html, ...) with ``output``, the page's own text, in place of ``html``.

    A run of ``length`` tokens is boilerplate if it occurs in two pages of its host that are not equal
    token for token; such equal pages count as one, so that copies of a page keep their text.

    Defined cases: null ``html`` gives null text, empty or without words an empty one; a null ``url`` and one
    without a host are of the host with the empty name; an unclosed script, style or comment reaches to the
    page's end; a host's only page keeps all its text; repeated rows are extracted alike; all
    other columns pass through whatever their names, one named ``output`` is replaced; an empty table
    gives an empty one.
    """
    names = pages.columns
    host, stream, key, spans = (unused(x, names) for x in ("_host", "_stream", "_key", "_spans"))
    known = pages.withColumns({host: F.coalesce(host_of(F.col("url")), F.lit("")), stream: stream_of(F.col("html"))})
    known = known.withColumn(key, F.unhex(F.md5(F.concat_ws(" ", F.lit(""), F.col(host), F.col(stream)))))
    # A stream is null where its page is; a filter on the stream itself would compute it once more.
    texts = known.where(F.col("html").isNotNull()).select(
        F.xxhash64(F.col(host)).alias("_scope"), F.lit(None).cast("long").alias("_ord"), F.col(key).alias("_key"), F.col(stream).alias("_text")
    )
    found = repeated_spans(texts, length, gram, first_stays=False).select(F.col("_key").alias(key), F.col("_spans").alias(spans))
    out = known.join(found, key, "left").withColumn(spans, F.arrow_udf(_extract, "string")(F.col(stream), F.coalesce(F.col(spans), F.array().cast("array<int>"))))
    keep = [F.col(f"`{c}`") for c in names if c.lower() not in ("html", output.lower())]
    return out.select(*keep, F.col(spans).alias(output))
