"""Not-modified captures (WARC revisits, HTTP 304) resolved to the response that they repeat.

Each revisit takes the latest earlier full response of its canonical url (by
time, then record id; never one at or behind its own place). Responses of a status
outside ``FULL``, such as parts (206) and errors, are none. Validators decide:
the entity tags if both have one (weak comparison), else the Last-Modified
dates, else the payload digests; equal gives ``resolved``, unequal ``mismatch``,
nothing to compare ``unverified``; without an earlier response ``no_base``. A
resolved revisit has the headers of its response, updated by those that a 304
may send (``PERMITTED``), and its payload digest.

The as-of join goes in two steps, so that one url with a large part of all
captures isn't one group: time is cut at quantiles into slices (one for every
``SLICE_ROWS`` records, from ``SLICES`` to ``MOST_SLICES``), the last response of
each url and slice is carried into the url's later slices, and within a slice a
running window finds nearer ones. Payloads aren't moved, only record ids. Captures
of one url at one time are one group.

Urls without "//" are their own canonical urls, but for the fragment. Null urls
have the canonical url '' and never resolve. Null times come first. Names of
headers may come in any case and go out in lower case; null headers stay null.
Repeated rows are captures of their own. Other columns are dropped. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, SLICE_ROWS, MOST_SLICES = 64, 1_000_000, 4096
#: Statuses of responses that hold the whole resource.
FULL = (200,)
#: Header fields that a 304 response may update (fixed values of the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical(url: Column) -> Column:
    """Scheme, port 80 or 443, "www.", fragment, tracking parameters and end slashes dropped; host in lower case; parameters in order. A url without "//" loses its fragment alone."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    made = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), made).otherwise(F.regexp_extract(u, r"(?s)^([^#]*)", 1))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _slice_of(ts: Column, edges: list[int]) -> Column:
    """The number of edges below ts, by a step over every 64th and one between two of these."""
    at = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>")
    below = lambda part: F.size(F.filter(part, lambda e: e < ts))
    coarse = below(F.array(*[F.lit(e) for e in edges[63::64]]).cast("array<bigint>")) * 64
    return F.when(ts.isNull(), 0).otherwise(coarse + below(F.slice(at, coarse + 1, F.lit(64))))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id long, url string, ts long, kind ('response' or 'revisit'), status int, etag,
    last_modified, digest strings, headers array of (name, value).

    (record_id, canonical_url, ts, kind, base_id, verdict, digest, headers); a response is its own base.
    """
    n, edges = records.agg(F.count("*"), F.percentile_approx("ts", [i / MOST_SLICES for i in range(1, MOST_SLICES)], 10_000)).first()
    step = max(1, MOST_SLICES // max(SLICES, n // SLICE_ROWS))
    time_slice = _slice_of(F.col("ts"), sorted(set((edges or [])[step - 1 :: step])))
    lower = F.transform("headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    own = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", "status", "etag", "last_modified", "digest", lower.alias("headers"),
        time_slice.alias("slice"), F.col("url").isNotNull().alias("named"),
    ).withColumn("key", F.when(F.col("named"), F.col("canonical_url")).otherwise(F.concat(F.lit("\n"), F.coalesce(F.col("record_id").cast("string"), F.lit(""))))).withColumn("full", F.when((F.col("kind") == "response") & F.col("status").isin(*FULL) & F.col("named"), own))
    carried = (
        rows.filter("named")
        .groupBy("key", "slice")
        .agg(F.max("full").alias("last"))
        .select("key", "slice", F.max("last").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    within = Window.partitionBy("key", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("full").over(within))
    both = near.join(carried, ["key", "slice"], "left").withColumn("base", F.when(F.col("named"), F.coalesce("near", "carried")))
    same = (
        F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("base.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("base.digest").isNotNull(), F.col("digest") == F.col("base.digest"))
    )
    verdict = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("base").isNull(), "no_base")
        .when(same, "resolved")
        .when(~same, "mismatch")
        .otherwise("unverified")
    )
    updates = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter("base.headers", lambda h: ~F.array_contains(F.transform(updates, lambda u: u["name"]), h["name"]))
    resolved = F.col("verdict") == "resolved"
    return both.withColumn("verdict", verdict).select(
        "record_id",
        "canonical_url",
        "ts",
        "kind",
        F.when(F.col("kind") == "response", F.col("record_id")).when(resolved | (F.col("verdict") == "unverified"), F.col("base.record_id")).alias("base_id"),
        "verdict",
        F.when(resolved, F.col("base.digest")).otherwise(F.col("digest")).alias("digest"),
        F.array_sort(F.when(resolved, F.concat(kept, updates)).otherwise(F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records made from a table of pages (page_id, url, html), for want of a crawl: every page is
    captured once in full and asked for again three times, with validators that fit, that fit by date
    alone, that don't fit, or none, and once before its full capture."""
    at = F.pmod(F.col("page_id") * 7919, F.lit(1_000_003))
    made = F.md5("html")
    date = F.concat(F.lit("day "), (at.cast("long") % 365).cast("string"))

    def record(n, kind, shift, etag, modified, digest):
        text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
        headers = F.array(
            F.struct(F.lit("content-length").alias("name"), (F.length("html") if kind == "response" else F.lit(0)).cast("string").alias("value")),
            F.struct(F.lit("date").alias("name"), (at + shift).cast("string").alias("value")),
        )
        if kind == "response":
            headers = F.concat(headers, F.array(F.struct(F.lit("content-type").alias("name"), F.lit("text/html").alias("value"))))
        return F.struct(
            (F.col("page_id") * 4 + n).cast("long").alias("record_id"),
            (at + shift).cast("long").alias("ts"),
            F.lit(kind).alias("kind"),
            F.lit(200 if kind == "response" else 304).alias("status"),
            text(etag).alias("etag"),
            text(modified).alias("last_modified"),
            text(digest).alias("digest"),
            headers.alias("headers"),
        )

    turn = F.col("page_id") % 4
    each = F.array(
        record(0, "response", 0, made, date, made),
        record(1, "revisit", 3600, F.concat(F.lit("W/"), made), date, None),
        record(2, "revisit", 7200, F.when(turn == 0, made).when(turn == 1, "other"), F.when(turn == 2, date), None),
        record(3, "revisit", -60, made, date, made),
    )
    return pages.select("url", F.explode(each).alias("r")).select("url", "r.*")
