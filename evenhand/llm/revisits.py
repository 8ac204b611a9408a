"""Resolution of not-modified web captures: each revisit gets the full response it stands for.

An as-of join by canonical URL finds the latest full response before a revisit. If the validators agree, the revisit
takes that response's payload, and its permitted headers replace the stored ones. Captures of one URL are
cut into stretches of time with about equally many rows, so that a URL with a third of all captures spreads over
tasks; what a stretch passes on to later ones is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import stored
from evenhand.llm.fingerprints import RANGES, _chunks

# Headers of a 304 that never replace stored ones (they describe the message or the connection).
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
# Query parameters that do not change what a URL shows.
TRACKING = ["fbclid", "gclid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slash, sorted query without tracking."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    names = F.array(*[F.lit(t) for t in TRACKING])
    query = F.array_sort(F.filter(query, lambda q: (q != "") & ~F.array_contains(names, F.lower(F.substring_index(q, "=", 1)))))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _entries(headers: Column) -> Column:
    """Headers as sorted (name, value) with lower-case names; of names that are then equal the greatest value."""
    pairs = F.coalesce(F.map_entries(headers), F.map_entries(F.create_map().cast("map<string,string>")))
    named = F.transform(pairs, lambda p: F.struct(F.lower(p["key"]).alias("name"), F.trim(p["value"]).alias("value")))
    sorted_ = F.array_sort(F.filter(named, lambda p: p["value"].isNotNull()))
    return F.filter(sorted_, lambda p, i: ~F.exists(sorted_, lambda q: (q["name"] == p["name"]) & (q["value"] > p["value"])))


def header(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda p: p["name"] == name), F.lit(1))["value"]


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, at, refers_to, verdict, headers, payload_digest.

    ``records`` has record_id (long), url, at (timestamp), kind (response or revisit), status, headers
    (map), payload_digest; other columns are left out. It is read more than once and must be a table or
    stored rows. Full responses are those with status 200. Only strictly earlier ones count, the latest, and of equal
    times the greatest record_id. verdict is

    * ``resolved``: entity tags agree (weakly); without them, modification dates; without those, payload digests;
    * ``unchecked``: nothing to compare; the response is taken;
    * ``mismatch``: they differ; headers are the revisit's own and there is no payload;
    * ``missing``: no earlier full response, or no URL or time; the same.

    Headers are (name, value) in name order, once per name. Repeated rows each get their result. An empty table
    gives no rows.
    """
    base = records.select(
        "record_id",
        canonical(F.col("url")).alias("url_key"),
        "at",
        F.unix_micros(F.col("at").cast("timestamp")).alias("_at"),
        F.col("kind"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("_full"),
        _entries(F.col("headers")).alias("_own"),
        F.col("payload_digest").alias("_digest"),
    )
    base = stored(base.filter((F.col("kind") == "revisit") | F.col("_full")), "revisit-records")
    lost = base.filter((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("_at").isNull()))
    known = base.filter(F.col("url_key").isNotNull() & F.col("_at").isNotNull())
    parts = RANGES * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.withColumn("_hash", F.lit(0).cast("long")).withColumn("_stretch", _chunks(known, "_at", parts)).drop("_hash")
    full = F.when(F.col("_full"), F.struct("_at", "record_id", "_own", "_digest"))
    each = Window.partitionBy("url_key", "_stretch")
    within = F.max(full).over(each.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    ends = known.filter("_full").groupBy("url_key", "_stretch").agg(F.max(F.struct("_at", "record_id", "_own", "_digest")).alias("_last"))
    asked = known.filter(F.col("kind") == "revisit").select("url_key", "_stretch").distinct()
    steps = ends.join(asked, ["url_key", "_stretch"], "full")  # at most one row per URL and stretch
    earlier = Window.partitionBy("url_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("url_key", "_stretch", F.max("_last").over(earlier).alias("_before"))
    found = (
        known.withColumn("_within", within)
        .filter(F.col("kind") == "revisit")
        .join(steps, ["url_key", "_stretch"], "left")
        .withColumn("_r", F.coalesce("_within", "_before"))
    )
    own, theirs = F.col("_own"), F.col("_r._own")
    tag, their_tag = (F.regexp_replace(header(e, "etag"), r"^[Ww]/", "") for e in (own, theirs))
    changed, their_changed = header(own, "last-modified"), header(theirs, "last-modified")
    agree = (
        F.when(tag.isNotNull() & their_tag.isNotNull(), tag == their_tag)
        .when(changed.isNotNull() & their_changed.isNotNull(), changed == their_changed)
        .when(F.col("_digest").isNotNull() & F.col("_r._digest").isNotNull(), F.col("_digest") == F.col("_r._digest"))
    )
    verdict = F.when(F.col("_r").isNull(), "missing").when(agree, "resolved").when(~agree, "mismatch").otherwise("unchecked")
    kept = F.array(*[F.lit(h) for h in KEPT_HEADERS])
    update = F.filter(own, lambda p: ~F.array_contains(kept, p["name"]))
    merged = F.array_sort(F.concat(F.filter(theirs, lambda p: ~F.exists(update, lambda q: q["name"] == p["name"])), update))
    good = F.col("verdict").isin("resolved", "unchecked")
    done = found.withColumn("verdict", verdict).select(
        "record_id",
        "url_key",
        "at",
        F.when(F.col("_r").isNotNull(), F.col("_r.record_id")).alias("refers_to"),
        "verdict",
        F.when(good, merged).otherwise(own).alias("headers"),
        F.when(good, F.col("_r._digest")).alias("payload_digest"),
    )
    nothing = lost.select(
        "record_id", "url_key", "at", F.lit(None).cast("long").alias("refers_to"), F.lit("missing").alias("verdict"),
        F.col("_own").alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return done.unionByName(nothing)


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page, as a crawler would have made them, from the page alone.

    The page itself is a full response at second page_id. A day's worth of seconds later, plus an offset by page, the
    same address, written slightly differently, answers "not modified". Every eleventh answer has another
    entity tag; every seventh has none and relies on its date. Content-Length of the answer describes the answer.
    """
    page = F.col("page_id")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(page, F.lit(300)).cast("int")), "yyyy-MM-dd")
    first = F.create_map(
        F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    other = F.when(page % 11 == 0, F.lit('"changed"')).when(page % 7 != 0, F.concat(F.lit("W/"), tag))
    again = F.create_map(
        F.lit("etag"), other, F.lit("last-modified"), day, F.lit("content-length"), F.lit("0"),
        F.lit("cache-control"), F.lit("max-age=600"), F.lit("age"), F.pmod(page, F.lit(60)).cast("string"),
    )
    full = pages.select(
        (page * 2).alias("record_id"), "url", F.timestamp_seconds(F.unix_timestamp(start) + page).alias("at"),
        F.lit("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"), digest.alias("payload_digest"),
    )
    later = F.unix_timestamp(start) + page + 86_400 + F.pmod(page * 7919, F.lit(100_000))
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^http:", "HTTPS:"), F.lit("#again")).alias("url"),
        F.timestamp_seconds(later).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        again.alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(revisit)
