import datetime
import random

import pytest
from pyspark.sql import functions as F

from evenhand.llm import revisits

SCHEMA = "record_id long, url string, at timestamp, kind string, status int, headers map<string,string>, payload_digest string, more string"
T = datetime.datetime(2024, 1, 1)


def brute(rows, key):
    out = []
    for rid, url, at, kind, _, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        own = {}
        for k, v in (headers or {}).items():
            if v is not None:
                own[k.lower()] = max(own.get(k.lower(), ""), v.strip())
        earlier = [
            r for r in rows
            if r[3] == "response" and r[4] == 200 and url is not None and at is not None and r[1] is not None and r[2] is not None
            and key[r[1]] == key[url] and r[2] < at
        ]
        if not earlier:
            out.append((rid, None, "missing", own, None))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        theirs = {k.lower(): v for k, v in (best[5] or {}).items() if v is not None}
        plain = lambda t: t[2:] if t[:2] in ("W/", "w/") else t
        verdict = "unchecked"
        if "etag" in own and "etag" in theirs:
            verdict = "resolved" if plain(own["etag"]) == plain(theirs["etag"]) else "mismatch"
        elif "last-modified" in own and "last-modified" in theirs:
            verdict = "resolved" if own["last-modified"] == theirs["last-modified"] else "mismatch"
        elif digest is not None and best[6] is not None:
            verdict = "resolved" if digest == best[6] else "mismatch"
        if verdict == "mismatch":
            out.append((rid, best[0], verdict, own, None))
        else:
            merged = theirs | {k: v for k, v in own.items() if k not in revisits.KEPT_HEADERS}
            out.append((rid, best[0], verdict, merged, best[6]))
    return sorted(out, key=repr)


def test_resolution_equals_brute_force(spark):
    rng = random.Random(7)
    urls = [f"https://www.h{i}.org/a/" for i in range(6)] + [f"HTTP://h{i}.org:80/a#x" for i in range(6)] + [None]
    rows = []
    for i in range(700):
        url = urls[0] if rng.random() < 0.4 else rng.choice(urls)
        at = None if rng.random() < 0.03 else T + datetime.timedelta(seconds=rng.randrange(300))
        headers = {}
        for name in ("ETag", "Last-Modified", "Content-Length", "Cache-Control", "X-Own"):
            if rng.random() < 0.6:
                tag = f'"{rng.randrange(2)}"'
                headers[name if rng.random() < 0.5 else name.lower()] = ("W/" + tag if name == "ETag" and rng.random() < 0.5 else tag)
        headers = None if rng.random() < 0.05 else headers
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((i, url, at, kind, rng.choice([200, 200, 404]), headers, rng.choice([None, "d1", "d2"]), "x"))
    rows += [rows[5], rows[5], rows[6]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    distinct = spark.createDataFrame([(u,) for u in urls if u], "u string").select("u", revisits.canonical(F.col("u"))).collect()
    key = dict(map(tuple, distinct))
    got = [
        (r["record_id"], r["refers_to"], r["verdict"], {h["name"]: h["value"] for h in r["headers"]}, r["payload_digest"])
        for r in revisits.resolve(frame).collect()
    ]
    assert sorted(map(repr, got)) and [r[:3] + (sorted(r[3].items()), r[4]) for r in sorted(got, key=lambda r: repr(r[:3]))] == [
        r[:3] + (sorted(r[3].items()), r[4]) for r in sorted(brute(rows, key), key=lambda r: repr(r[:3]))
    ]
    assert revisits.resolve(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://User@WWW.Example.com:80/A/b/#frag", "example.com/A/b"),
        ("https://example.com/?utm_source=x&b=2&a=1&ref=q", "example.com?a=1&b=2"),
        ("example.com", "example.com"),
        ("https://example.com:8443/x?", "example.com:8443/x"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, expected):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(revisits.canonical(F.col("u"))).first()[0] == expected


def test_repeated_header_names_do_not_crash(spark):
    rows = [(1, "a.b/c", T, "response", 200, {"ETag": "1", "etag": "2"}, "d", "x"), (2, "a.b/c", T + datetime.timedelta(1), "revisit", 304, {"ETAG": "2"}, None, "x")]
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["refers_to"], got["verdict"], got["payload_digest"]) == (1, "resolved", "d")


def test_captures_of_pages_get_their_page_back(spark, base):
    pages = spark.read.parquet(f"{base}/pages.parquet")
    found = revisits.resolve(revisits.captures(pages)).filter("verdict = 'resolved'")
    back = found.join(pages.withColumn("record_id", F.col("page_id") * 2), F.col("refers_to") == F.col("page_id") * 2)
    assert back.count() == found.count() > 0
    assert back.filter(F.col("payload_digest") != F.md5("html")).count() == 0
