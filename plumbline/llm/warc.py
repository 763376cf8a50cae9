"""WARC derivatives: metadata and plain-text conversion records of response records.

A response becomes two records that point back to it: `metadata` (title, language, links, digest of the source) and
`conversion` (its text). Both keep the identifier, URI, date and payload digest of their source. All steps are column
expressions, so records are made where their page is read, without a shuffle.

Defined cases: null html or url is empty; an empty page gives both records, the conversion with an empty block; pages
that are equal in id, url and html are separate records with equal identifiers, since these are made from the content (a
page fetched twice is told apart by its page_id); line ends in a URL, a language or a link are percent-encoded, so that
none ends its header or field; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"      # for pages that come without the date of their fetch
_HEADERS = ("type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_digest", "source_headers")
# Entities that are resolved, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"),
            ("&mdash;", "—"), ("&hellip;", "…"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"),
            ("&gt;", ">"), ("&amp;", "&"))
# What goes before tags are taken off, and the tags that end a line.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|title)\b[^>]*>"
TAG = r"(?s)<[a-zA-Z/!?][^>]*>"


def uuid_of(c: Column) -> Column:
    h = F.md5(c.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def one_line(c: Column) -> Column:
    """Line ends percent-encoded, as a URI has to have them."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target_uri, date, headers, payload: response records of a table page_id, url, html."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", uuid_of(F.concat_ws("\n", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html)).alias("record_id"),
        one_line(url).alias("target_uri"), F.lit(DATE).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.octet_length(html).cast("string"), F.lit("\r\n")).alias("headers"), html.alias("payload"))


def resolved(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain_text(html: Column) -> Column:
    """Visible text: hidden parts and tags removed, block tags as line ends, white space collapsed."""
    t = F.regexp_replace(html, HIDDEN, " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), BREAKS, "\n"), TAG, "")
    return F.trim(F.regexp_replace(resolved(t), r" *(\n *)+", "\n"), F.lit(" \n"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records per response: page_id, type, record_id, refers_to, target_uri, date, content_type, block_digest,
    source_digest, source_headers, content_length, block."""
    src = source.withColumns({
        "source_digest": digest(F.col("payload")),
        "title": F.trim(resolved(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))),
        "target_uri": one_line(F.col("target_uri")), "date": one_line(F.col("date")),
        "lang": one_line(F.regexp_extract("payload", r"(?i)<html\b[^>]*\blang=\"([^\"]*)\"", 1)),
        "links": F.regexp_extract_all("payload", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1),
        "body": plain_text(F.col("payload")),
    })
    facts = F.concat(F.lit("title: "), F.col("title"), F.lit("\r\nlanguage: "), F.col("lang"), F.lit("\r\nsource-digest: "), F.col("source_digest"),
                     F.array_join(F.transform("links", lambda x: F.concat(F.lit("\r\noutlink: "), one_line(resolved(x)))), ""), F.lit("\r\n"))
    made = F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block")),
                   F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("body").alias("block")))
    rows = src.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest",
                      F.col("headers").alias("source_headers"), F.inline(made))
    rows = rows.withColumn("record_id", uuid_of(F.concat_ws("\n", "type", "refers_to")))
    return rows.select("page_id", *_HEADERS[:6], digest(F.col("block")).alias("block_digest"), "source_digest", "source_headers",
                       F.octet_length("block").cast("long").alias("content_length"), "block")


def as_records(rows: DataFrame) -> DataFrame:
    """One column `record`: the derivatives in WARC form, headers of the source as one escaped line."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    kept = F.replace(F.replace(F.replace("source_headers", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("Content-Type", F.col("content_type")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")), line("WARC-Source-Headers", kept),
        line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block")).alias("record"))


def write(rows: DataFrame, path: str) -> None:
    """WARC files, one per partition; every record ends with two line ends."""
    as_records(rows).write.option("lineSep", "\r\n\r\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of files that `write` made: the header columns, content_length and block (null if its length is wrong)."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\nWARC-Type: ").text(path).filter("value != ''")
    cut = raw.select(F.concat(F.lit("WARC-Type: "), F.substring_index("value", "\r\n\r\n", 1)).alias("head"),
                     F.expr("substr(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)").alias("tail"))
    names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
             "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest",
             "source_digest": "WARC-Source-Payload-Digest", "source_headers": "WARC-Source-Headers", "content_length": "Content-Length"}
    out = cut.select("tail", *[F.regexp_extract("head", rf"(?m)^{h}: ([^\r\n]*)", 1).alias(c) for c, h in names.items()])
    back = F.replace(F.replace(F.replace("source_headers", F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    out = out.withColumns({"content_length": F.col("content_length").cast("long"), "source_headers": back})
    block = F.when(F.octet_length("tail") == F.col("content_length") + 4, F.expr("substr(tail, 1, length(tail) - 4)"))
    return out.select(*_HEADERS, "content_length", block.alias("block"))
