"""Vector and page operators against brute force, and their edge cases."""
import base64
import hashlib
import io
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import arc, cap_join, pivot_search
from quarry.llm.common import components

VEC = "vec_id long, embedding array<float>, label int, v string, d string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1, "v", "d")
                                  for i, x in rows], VEC)


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15),
       (9005, [None] + [1.0] * 15), (9006, [])]


def test_components_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (190, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cap_join_links_and_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x = np.vstack([x, x[:60] + 0.06 * rng.standard_normal((60, 16)), x[:10], 3 * x[10:15]]).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    out = cap_join.near_duplicates(vectors(spark, rows + ODD))
    got = {r.vec_id: r for r in out.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum() and want.sum() > 150
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label, len(x)).min(1))
    if (have == want).all():
        assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in ODD)
    assert cap_join.near_duplicates(vectors(spark, [])).count() == 0


def test_cap_filters_recall_at_the_bound():
    rng = np.random.default_rng(1)
    code = cap_join.ProductCode(64, max(8, math.ceil((64 * 20_000) ** 0.25)))
    y, z = rng.standard_normal((2, 400, 64))
    y /= np.linalg.norm(y, axis=1)[:, None]
    z -= (z * y).sum(1)[:, None] * y
    z /= np.linalg.norm(z, axis=1)[:, None]
    near = 0.95 * y + math.sqrt(1 - 0.95 ** 2) * z
    a, b = code.decode(y), code.decode(near)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.97
    # list decoding finds exactly the filters above the threshold
    left, right = code._halves(y[:20])
    for i in range(20):
        s = (left[i][:, None] + right[i]).ravel()
        above = set(np.flatnonzero(s >= code.threshold).tolist())
        assert above <= set(a[i].tolist()) and (len(a[i]) == len(above) or len(above) < cap_join.LEAST_FILTERS)


def test_cap_threshold_equals_that_of_all_scores():
    for width, words in ((64, 8), (5, 9), (2, 8)):
        code = cap_join.ProductCode(width, words)
        x = np.random.default_rng(5).standard_normal((40, width))
        left, right = code._halves(x)
        every = np.sort((left[:, :, None] + right[:, None, :]).ravel())
        for n in (1, 48 * 40, every.size):
            assert code._kept(x, n) == every[-n]


@pytest.mark.parametrize("vectors", [10 ** 6, 10 ** 7])
def test_cap_code_of_many_vectors(vectors):
    tracemalloc.start()
    code = cap_join.ProductCode(64, math.ceil((64 * vectors) ** 0.25))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    rng = np.random.default_rng(1)
    y, z = rng.standard_normal((2, 400, 64))
    y /= np.linalg.norm(y, axis=1)[:, None]
    z -= (z * y).sum(1)[:, None] * y
    z /= np.linalg.norm(z, axis=1)[:, None]
    near = 0.95 * y + math.sqrt(1 - 0.95 ** 2) * z
    a, b = code.decode(y), code.decode(near)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.97


@pytest.mark.parametrize("annulus", [16, 1])  # with one row each, the first look sees fewer than k
def test_pivot_search_brute_force(spark, monkeypatch, annulus):
    monkeypatch.setattr(pivot_search, "ANNULUS_ROWS", annulus)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((260, 16)), 1).astype(np.float32)
    x[100:140] = x[3]  # ties
    rows = list(enumerate(x.tolist()))
    q = pivot_search.quantized(vectors(spark, rows + ODD[:-1]), "vec_id", "embedding", 256)
    got = {}
    for r in pivot_search.top_k(q, q.where(F.col("id") % 10 == 0), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = {i: np.floor(256 * x[i].astype(float)).astype(np.int64) for i in range(len(x))}
    v[9002] = np.zeros(16, np.int64)  # zero vectors take part
    for i in [i for i in v if i % 10 == 0]:
        want = sorted(((-int(v[i] @ v[j]), j) for j in v if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in want]
    assert set(got) == {i for i in v if i % 10 == 0}


def test_pivot_search_small(spark):
    q = pivot_search.quantized(vectors(spark, [(0, [1.0, 2.0]), (1, [0.5])]), "vec_id", "embedding", 256)
    rows = pivot_search.top_k(q, q.where("id = 0"), 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 256 * 128)]
    assert pivot_search.top_k(q.limit(0), q.limit(0), 5).count() == 0


# ---- archives ------------------------------------------------------------

def test_arc_records_of_both_versions_and_faults():
    for version in (1, 2):
        data = (arc.version_block(version, "x.arc", "20010203040506") + arc.arc_record(version, "http://a/b c", "2001", b"HTTP/1.1 200 OK\r\n\r\nhi", "f")
                + arc.arc_record(version, None, "20011399000000", b"", "f") + b"\n\n")
        rows = list(arc.arc_records(io.BytesIO(data)))
        assert [len(r[1]) for r in rows] == [len(arc.ARC_FIELDS[version]) + (i == 0) for i in range(3)]
        assert rows[0][1]["version"] == str(version) and rows[1][2].endswith(b"hi") and rows[2][1]["URL"] == "about:blank"
        assert data[rows[1][0]:].startswith(b"http://a/b%20c ")
    spaced = arc.version_block(1, "x", "2001") + b"http://a/b c 1.2.3.4 20010203040506 text/html 2\nok\n"
    assert list(arc.arc_records(io.BytesIO(spaced)))[1][1]["URL"] == "http://a/b c"
    for bad in (b"http://a 20010203040506 5\nhello\n", b"http://a 1.1.1.1 20010203040506 text/html x\nhello\n",
                b"http://a 1.1.1.1 20010203040506 text/html 50\nhello\n"):
        with pytest.raises(ValueError):
            list(arc.arc_records(io.BytesIO(bad)))


def test_warc_dates_and_types():
    assert arc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and arc.warc_date("200102") == "2001-02-01T00:00:00Z"
    assert arc.warc_date("20011399000000") == arc.warc_date("") == arc.warc_date("abc") == arc.UNKNOWN_DATE
    h = dict(zip(arc.ARC_FIELDS[1], ["dns:a.b", "1.1.1.1", "2001", "text/dns", "3"]))
    kinds = [arc.to_warc("p", 1, h, b"abc", None), arc.to_warc("p", 1, h | {"URL": "http://a"}, b"HTTP/1.0 200 OK\n\nx", None),
             arc.to_warc("p", 1, h | {"URL": "http://a"}, b"HTTP/1.0 200 OK\n\nx", ("urn:x", "http://b", "2001-01-01T00:00:00Z"))]
    rows = [next(arc.warc_records(io.BytesIO(k))) for k in kinds]
    assert [r[0]["WARC-Type"] for r in rows] == ["resource", "response", "revisit"]
    assert rows[2][1] == b"HTTP/1.0 200 OK\n\n" and rows[2][0]["WARC-Refers-To"] == "<urn:x>"
    assert rows[1][0]["WARC-Payload-Digest"] == rows[2][0]["WARC-Payload-Digest"] == "sha1:" + arc.digest(b"x")


def test_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(arc, "ARCHIVE_BYTES", 2000)  # several archives a task
    bodies = [None, "", "<p>é漢🙂</p>", "\r\n\r\nWARC/1.0\r\n", "\n\nhttp://x 1 2 3 4\n", "a" * 300_000, "dup", "dup", "HTTP/1.1 200 OK\r\n\r\n"]
    rows = [(i, None if i == 3 else f"http://h/{i} x", bodies[i % len(bodies)] if i < 30 else f"page {i}", "p", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string, id int").repartition(5)
    got = {r.page_id: r for r in arc.pages_through_warc(df).collect()}
    first = {}
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        want_first = first.setdefault(body, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if want_first == i else ("revisit", want_first)) and r.intact
    assert len(got) == 60 and arc.pages_through_warc(df.limit(0)).count() == 0
    listing = arc.convert(arc.write_arc(df))
    payloads = arc.read_warc(listing, payloads=True).where("type = 'response'").collect()
    assert {bytes(r.payload) for r in payloads} == set(first)


def test_pages_whose_address_looks_like_a_version_block(spark):
    rows = [(1, "filedesc://x", "<p>one</p>"), (2, "filedesc://x 0.0.0.0 20240101 text/plain 3", "<p>one</p>"), (3, "http://a", None),
            (3, "http://a", None)]
    out = arc.pages_through_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out.collect())
    assert [g[:2] for g in got] == [(1, 10), (2, 10), (3, 0), (3, 0)]
    assert got[0][2:] == ("response", None) and got[1][2:] == ("revisit", 1)
