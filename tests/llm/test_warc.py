"""WARC archives: exact round trip, revisits by brute force, and the merged index against a plain sort."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F, types as T

from __spark_entry__ import queries
from intentlane.llm.warc import (LoserTree, captures, header_value, merge_index, merge_runs, read_archives, read_records, url_key,
                                 write_archives)
from intentlane.session import scratch_path, ship_package

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("_first", T.StringType()), T.StructField("archive", T.StringType())])


def test_merge_runs_is_a_sort():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(rnd.choice("abcdé") * rnd.randrange(3) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(k)]
        order = merge_runs(runs)
        assert [runs[r][i] for r, i in order] == sorted(x for run in runs for x in run)
        assert sorted(order) == [(r, i) for r, run in enumerate(runs) for i in range(len(run))]
        for r in range(k):
            assert [i for q, i in order if q == r] == list(range(len(runs[r])))


def test_loser_tree_comparisons():
    """One comparison a level for every key that follows the first heads."""
    tree = LoserTree([(i,) for i in range(64)])
    calls = []
    before = tree._before
    tree._before = lambda a, b: calls.append(1) or before(a, b)
    tree.replace((100,))
    assert len(calls) == 6


def test_url_key():
    assert url_key("HTTPS://www.Example.COM:443/a/B?z=1&a=2#top") == "com,example)/a/B?a=2&z=1"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key("") == ")/"
    assert url_key("http://[bad") == ")http://[bad"
    assert header_value("a b\r\nX: y") == "a%20b%0D%0AX:%20y"


def test_broken_archives():
    with pytest.raises(ValueError):
        list(read_records(b"nothing"))
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(body) for *_, body in read_records(good + good)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(read_records(good.replace(b"3", b"2")))
    with pytest.raises(ValueError):
        captures("x", good)


def rows():
    rnd = random.Random(8)
    hot = "<p>" + "hot page " * 40
    evil = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "é\U0001f600\x00" * 40
    bodies = [None, "", "short", "x" * 99, "y" * 100, "é" * 50, "é" * 49, hot, hot, hot, evil, "long " * 200_000]
    out = [(i, f"http://h{rnd.randrange(4)}.example.com/p?{rnd.randrange(9)}", rnd.choice(bodies) if i % 2 else f"own page {i} " * 20, "c", "c", "c")
           for i in range(300)]
    rnd.shuffle(out)
    out += [(400, None, hot, "c", "c", "c"), (401, "", hot, "c", "c", "c"), (402, "http://a\r\nb: c/", "z" * 300, None, None, None)]
    out += [(None, "http://n/", hot, "c", "c", "c"), (None, "http://n/", "only null ids " * 20, "c", "c", "c")]
    out += [out[0], out[0], (500, "http://q/", "twice " * 90, "c", "c", "c"), (500, "http://r/", "twice " * 90, "c", "c", "c"),
            (501, "http://r/", "twice " * 90, "c", "c", "c")]
    return out


def brute(data):
    first = {}
    for page, _, html, *_ in data:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html, *_ in data:
        body = (html or "").encode()
        f = first.get(body)
        revisit = f is not None and f != page
        out.append((page, len(body), sha256(body).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_and_order(spark):
    ship_package(spark)
    data = rows()
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame(data, SCHEMA).repartition(5), path, archive_bytes=200_000)
    files = spark.read.format("binaryFile").load(path).collect()
    records = [(r, bytes(f["content"])) for f in files for r in read_records(bytes(f["content"]))]
    assert len(files) > 5 and all(f["content"][:8] == b"WARC/1.1" for f in files)
    kept = sorted(bytes(r[3]) for r, _ in records if r[2]["WARC-Type"] == "response")
    want = [((html or "").encode(), kind) for (page, _, kind, html) in
            [(p, b, k, next(h for q, _, h, *_ in data if q == p and sha256((h or "").encode()).hexdigest() == d)) for p, b, d, k, _ in brute(data)]]
    assert kept == sorted(body for body, kind in want if kind == "response")
    runs = read_archives(spark, path)
    got = sorted(((int(r["id"]) if r["id"] is not None else None, r["payload_bytes"], r["payload_digest"], r["record_type"],
                   int(r["first"]) if r["first"] is not None else None) for r in runs.collect()), key=repr)
    assert got == brute(data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = sorted(merge_index(runs).collect(), key=lambda r: (r["part"], r["place"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [(r["urlkey"], r["date"], r["archive"], r["offset"]) for r in index]
    assert len(index) == len(data) and keys == sorted(keys) and len({r["part"] for r in index}) > 1
    by_name = {f["path"].rsplit("/", 1)[1]: bytes(f["content"]) for f in files}
    for r in index[::17]:       # offsets and lengths lead to the record itself
        one = by_name[r["archive"]][r["offset"]:r["offset"] + r["length"]]
        (_, _, fields, body), = read_records(one)
        assert fields["WARC-Payload-Digest"] == f"sha256:{r['payload_digest']}"
        assert r["record_type"] == "revisit" or sha256(body).hexdigest() == r["payload_digest"]


def test_query_and_empty(spark, tmp_dir):
    for n, data in enumerate((rows(), [])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_dir}/{n}/pages.parquet")
        got = queries()["op11_warc_index"](spark, f"{tmp_dir}/{n}")
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(data)


def test_text_ids(spark):
    ship_package(spark)
    body = "same body " * 30
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([("b/1 é", "u", body), ("a:2", "u", body), (None, "u", body)], "page_id string, url string, html string")
    write_archives(pages, path)
    got = {r["id"]: (r["record_type"], r["first"]) for r in read_archives(spark, path).collect()}
    assert got == {"a:2": ("response", None), "b/1 é": ("revisit", "a:2"), None: ("revisit", "a:2")}
    assert merge_index(read_archives(spark, path)).agg(F.count("*")).first()[0] == 3
