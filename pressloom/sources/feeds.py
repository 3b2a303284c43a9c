"""Reading feeds: bodies (gzip, deflate or plain) with RSS or Atom items, in feed order.

Bodies are a binary column; parsing runs in Arrow batches. Everything after the split into raw
elements (markup, dates, canonical addresses) is done with column expressions.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as T

# fixed values
ATOM, DC, CONTENT = "{http://www.w3.org/2005/Atom}", "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/rss/1.0/modules/content/}"
FIELDS = {
    "title": ("title", ATOM + "title"),
    "link": ("link", ATOM + "link"),
    "summary": ("description", ATOM + "summary", ATOM + "content", CONTENT + "encoded"),
    "published": ("pubDate", ATOM + "published", ATOM + "updated", DC + "date"),
    "guid": ("guid", ATOM + "id"),
}
RAW = "poll_id string, item int, title string, link string, summary string, published string, guid string, source_url string, source_name string, error string"


def decompress(body: bytes, encoding: str | None = None) -> bytes:
    """By magic bytes first, then by the declared encoding; a body that cannot be unpacked is kept."""
    tries = []
    if body[:2] == b"\x1f\x8b" or encoding == "gzip":
        tries.append(gzip.decompress)
    if encoding == "deflate":
        tries += [zlib.decompress, lambda b: zlib.decompress(b, -zlib.MAX_WBITS)]
    for unpack in tries:
        try:
            return unpack(body)
        except (OSError, EOFError, zlib.error):
            continue
    return body


def raw_items(body: bytes) -> Iterator[dict]:
    """Elements of each item as text, in feed order; the first non-blank of several names, else its href."""
    root = ElementTree.fromstring(body)
    for node in root.findall(".//item") or root.findall(f".//{ATOM}entry"):
        out: dict = {}
        for field, names in FIELDS.items():
            found = (el for el in map(node.find, names) if el is not None)
            values = ((el.text if el.text and el.text.strip() else el.get("href")) for el in found)
            out[field] = next((v for v in values if v), None)
        source = node.find("source")
        out["source_url"] = source.get("url") if source is not None else None
        out["source_name"] = (source.text or "").strip() or None if source is not None else None
        yield out


def parse(bodies: DataFrame, poll: str = "poll_id", body: str = "body", encoding: str | None = None) -> DataFrame:
    """``poll_id, position, title, url, url_canon, standfirst, published_at, guid, source_url, source_name``.

    Items without a title or link are skipped. Syndicated items lose the source's name at the end of the
    title; navigation cards among them (short titles, fewer than four words, a bar) are dropped. A
    standfirst that only repeats the title is null. A body that is no feed has no items.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, b, e in zip(pdf["p"], pdf["b"], pdf["e"], strict=True):
                try:
                    rows += [{"poll_id": i, "item": k, **r} for k, r in enumerate(raw_items(decompress(bytes(b), e)))]
                except ElementTree.ParseError as err:
                    rows.append({"poll_id": i, "item": None, "error": str(err)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")]).astype(object)

    src = bodies.filter(F.col(body).isNotNull()).select(F.col(poll).cast("string").alias("p"), F.col(body).alias("b"), (F.col(encoding) if encoding else F.lit(None).cast("string")).alias("e"))
    raw = src.mapInPandas(run, RAW).filter("error is null")
    title, name = T.strip_html(F.col("title")), F.col("source_name")
    tidy = title
    for sep in (" - ", " | ", " – "):
        tidy = F.when(name.isNotNull() & title.endswith(F.concat(F.lit(sep), name)) & (tidy == title), F.trim(title.substr(F.lit(1), F.length(title) - F.length(name) - len(sep)))).otherwise(tidy)
    out = raw.select("poll_id", "item", tidy.alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("url"), T.trim_standfirst(T.strip_html(F.col("summary"))).alias("s"),
                     T.parse_date(F.col("published")).alias("published_at"), F.when(F.trim("guid") != "", F.trim("guid")).alias("guid"), "source_url", "source_name")
    out = out.filter((F.coalesce("title", F.lit("")) != "") & (F.col("url") != ""))
    card = name.isNotNull() & ((F.length("title") < 25) | (F.size(F.split("title", r"\s+")) < 4) | F.col("title").contains(" | "))
    repeats = F.col("s").startswith(F.substring("title", 1, 40))
    out = out.filter(~card).withColumn("standfirst", F.when((F.col("s") != "") & ~repeats, F.col("s")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("poll_id").orderBy("item")) - 1
    return out.select("poll_id", place.alias("position"), "title", "url", T.canonical_url(F.col("url")).alias("url_canon"), "standfirst", "published_at", "guid", "source_url", "source_name")


def feed_check(polls: DataFrame, items: DataFrame) -> DataFrame:
    """Per poll: items and dated items (0 where the body held none)."""
    g = items.groupBy("poll_id").agg(F.count("*").alias("items"), F.count("published_at").alias("dated"))
    return polls.select(F.col("poll_id").cast("string").alias("poll_id")).distinct().join(g, "poll_id", "left").fillna(0, ["items", "dated"])
