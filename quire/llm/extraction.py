"""Main text of web pages by wrapper inference.

Pages of one host are made by the same programs. Their token streams are
aligned into one wrapper per host, a union-free regular expression
(:mod:`quire.llm.wrappers`), whose text slots are judged once for the host. A
page's main text is what aligns with the slots that hold the article.

Plan: a scan reads every page's folded stream and sends one row per host and
shape with the statistics of its texts, merged in the task; statistics merge
further by position with map-side combine, so a host with a third of all pages
sends no more than a small one. What is left, the different shapes of a host,
is aligned in groups of about ``GROUP`` by hash until one wrapper remains;
order is by shape, so the result does not depend on partitions. The second
scan joins the wrappers (one row per host) to the pages; Spark broadcasts them
only where their written size is small, and else sorts and splits hot hosts.

Defined results for odd input: null html is empty and has the text '';
without a url the host is ''; a null ``page_id`` stays null; repeated rows are
read one by one; a page without tags is all text; tags nested deeper than
``MAX_DEPTH`` count as text of the level above; an open quote ends at the next
bracket; an empty table gives an empty result; extra columns are ignored.
Whole pages are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import wrappers as wr
from quire.session import ship_package, stable

#: Shapes aligned in one group, shapes a task holds before it sends them on,
#: and parsed wrappers a task keeps.
GROUP, HELD, PARSED = 200, 5_000, 256
_STAT = "struct<lo:bigint,hi:bigint,chars:bigint,link_chars:bigint,pages:bigint>"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], list] = {}

    def send() -> pa.RecordBatch:
        rows = [{"host": h, "shape": s, "n_pages": n, "stats": [dict(zip(("lo", "hi", "chars", "link_chars", "pages"), x)) for x in stats]} for (h, s), (n, stats) in held.items()]
        kind = pa.struct([(k, pa.int64()) for k in ("lo", "hi", "chars", "link_chars", "pages")])
        schema = pa.schema([("host", pa.string()), ("shape", pa.string()), ("n_pages", pa.int64()), ("stats", pa.list_(kind))])
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1)):
            shape, stats = wr.write(wr.read_page(html.as_py() or "")[0])
            known = held.get((host, shape))
            if known is None:
                held[host, shape] = [1, stats]
            else:
                known[0] += 1
                known[1] = [[min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4] + y[4]] for x, y in zip(known[1], stats)]
            if len(held) >= HELD:
                yield send()
    yield send()


def _aligned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    # long shapes first: they show what repeats together
    rows = rows.assign(size=-rows["shape"].str.len()).sort_values(["size", "sid"])
    for r in rows.itertuples():
        parts = wr.read(r.shape, [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in r.stats])
        whole = parts if whole is None else wr.align(whole, parts)
    shape, stats = wr.write(whole)
    return pd.DataFrame({"host": [key[0]], "shape": [shape], "n_pages": [int(rows["n_pages"].sum())], "stats": [[tuple(s) for s in stats]]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, n_pages, shape (marked) and expression."""
    ship_package(pages.sparkSession)
    found = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).mapInArrow(_shapes, f"host string, shape string, n_pages long, stats array<{_STAT}>")
    found = stable(found.withColumn("sid", F.md5("shape")))
    by_place = found.select("host", "sid", F.posexplode("stats").alias("pos", "s")).groupBy("host", "sid", "pos")
    stat = by_place.agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"), *[F.sum(f"s.{c}").alias(c) for c in ("chars", "link_chars", "pages")])
    # as many as the shape has texts
    stat = stat.groupBy("host", "sid").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi", "chars", "link_chars", "pages"))).alias("all"))
    stat = stat.select("host", "sid", F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in ("lo", "hi", "chars", "link_chars", "pages")])).alias("stats"))
    level = found.groupBy("host", "sid").agg(F.any_value("shape").alias("shape"), F.sum("n_pages").alias("n_pages")).join(stat, ["host", "sid"], "left")
    level = stable(level.withColumn("stats", F.coalesce("stats", F.array().cast(f"array<{_STAT}>"))))
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("c"))
        if (sizes.agg(F.max("c")).first()[0] or 0) <= 1:  # one number
            break
        spread = level.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("sid"), F.ceil(F.col("c") / GROUP)))
        spread = spread.groupBy("host", "bucket").applyInPandas(_aligned, f"host string, shape string, n_pages long, stats array<{_STAT}>")
        level = stable(spread.withColumn("sid", F.md5("shape")))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for r in rows.itertuples():
                parts = wr.read(r.shape, [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in r.stats])
                wr.decide(parts, r.n_pages)
                out.append((r.host, r.n_pages, wr.write(parts)[0], wr.regex(parts)))
            yield pd.DataFrame(out, columns=["host", "n_pages", "shape", "expression"])

    return stable(level.mapInPandas(judge, "host string, n_pages long, shape string, expression string"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, list] = {}
    for b in batches:
        texts = []
        for html, shape in zip(b.column(2), b.column(3).to_pylist()):
            page, runs = wr.read_page(html.as_py() or "")
            if shape is None:  # a host that the wrappers given do not know
                wr.judge_page([], page)
            else:
                if shape not in parsed:
                    if len(parsed) >= PARSED:
                        parsed.clear()
                    parsed[shape] = wr.read(shape)
                wr.judge_page(parsed[shape], page)
            texts.append(wr.article(runs))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points)."""
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(wrappers.select("host", "shape"), "host", "left").select("page_id", "url", "html", "shape")
    out = rows.mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
