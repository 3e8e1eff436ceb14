"""WARC archives, exact top-k and benchmark passages against brute force."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import contamination, topk, warc
from tests.llm.conftest import prose


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/ 2", "<p>one</p>"), (3, None, "<p>two</p>"), (9, "http://a/9", "<p>one</p>"), (5, "http://a/5", None), (6, "http://a/6", ""), (7, "u", "ünï" * 90_000)]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip_with_revisits(spark, compress):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    a = warc.write_archives(df, compress=compress)
    got = {int(r.record_id.split(":")[-1]): r for r in warc.read_archives(a).collect()}
    text = {p: (h or "").encode() for p, _, h in PAGES}
    top = {}
    for p, t in text.items():
        top[t] = max(p, top.get(t, 0))
    assert set(got) == set(text)
    for p, t in text.items():
        r = got[p]
        assert (r.status, r.payload_digest, r.payload_bytes) == ("ok", sha(t), len(t))
        assert r.record_type == ("response" if top[t] == p else "revisit") and r.refers_to == (None if top[t] == p else f"urn:page:{top[t]}")
        assert r.payload is None if top[t] != p else bytes(r.payload) == t
    least = warc.write_archives(df, least_bytes=5, compress=compress)
    kinds = {int(r.record_id.split(":")[-1]): r.record_type for r in warc.read_archives(least).collect()}
    assert kinds[5] == kinds[6] == "response" and kinds[1] == "revisit"
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "u", "x"), (4, "u", "x"), (4, "u", "x")], "page_id bigint, url string, html string")
    got = sorted(((r.record_id, r.record_type) for r in warc.read_archives(warc.write_archives(df)).collect()))
    assert got == [("urn:page:4", "response"), ("urn:page:4", "response"), ("urn:page:none", "revisit")]


def records(n, compress):
    out = [warc.record_bytes(f"urn:page:{i}", f"http://x/{i}", b"payload %d " % i * (i + 1)) for i in range(n)]
    return [gzip.compress(r) for r in out] if compress else out


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "gap", "start", "join"])
def test_salvage(compress, damage):
    parts = records(6, compress)
    whole, lost = list(parts), set()
    if damage == "flip":
        x = bytearray(parts[2])
        x[len(x) // 2] ^= 0xFF
        parts[2], lost = bytes(x), {2}
    elif damage == "cut":
        parts[5], lost = parts[5][:-20], {5}
    elif damage == "gap":
        parts.insert(3, b"garbage \x1f\x8b\x08 WARC/1.1 in between")
    elif damage == "start":
        parts[0], lost = parts[0][10:], {0}
    elif damage == "join":
        parts[1], lost = parts[1][: len(parts[1]) // 2], {1}
    data = b"".join(parts)
    got = read(data)
    ok = [r for r in got if r["status"] == "ok"]
    assert {r["record_id"] for r in ok} == {f"urn:page:{i}" for i in range(6)} - {f"urn:page:{i}" for i in lost}
    bad = [r for r in got if r["status"] == "quarantined"]
    assert bool(bad) == (damage != "none") and all(r["reason"] for r in bad)
    spans = sorted({(r["offset"], r["length"]) for r in got})
    assert spans[0][0] == 0 and sum(n for _, n in spans) == len(data)  # every byte is in a record or a logged gap
    if damage == "gap":
        assert bad[0]["offset"] == sum(map(len, whole[:3])) and bad[0]["length"] == len(parts[3])


def plain_top(rows, queries, k):
    v = {i: np.floor(1024 * np.array(x, dtype=np.float64)).astype(np.int64) for i, x in rows}
    out = set()
    for q in queries:
        found = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 12)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    odd = [(2000, None), (2001, [0.1] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (None, [0.0] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=10)
    queries = [i for i, _ in rows if i % 50 == 0]
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == plain_top(rows, queries, 10)
    few = df.where("vec_id < 4")
    assert {tuple(r) for r in topk.exact_top_k(few, F.col("vec_id") == 0, k=10).select("query_id", "rank", "vec_id", "score").collect()} == plain_top(rows[:4], [0], 10)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_index_ends_early_only_with_proof():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (3000, 8))
    x[:5] *= 20  # a few large ones: the proof comes early
    index = topk.ImpactIndex(np.arange(3000), x)
    for q in (x[0], x[700], np.zeros(8, np.int64), -x[3]):
        for known in (-np.inf, float(np.sort(x @ q)[-10])):
            ids, scores = index.search(q, -1, 5, known)
            order = np.lexsort((np.arange(3000), -(x @ q)))[:5]
            assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()


def plain_contained(docs, items, width=5, threshold=0.8):
    out = set()
    for d, t in docs:
        words = contamination.words_of(t)
        for i, it in items:
            own = contamination.words_of(it)
            if not own:
                continue
            w = min(width, len(own))
            s = contamination.shingles(own, w)
            shared = len(s & contamination.shingles(words, w))
            if shared >= threshold * len(s) - 1e-9:
                out.add((d, i, shared, len(s)))
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    items = [(i, prose(rng, int(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 20, 40, 60, 80])] + [(20, ""), (21, None), (22, "Ünï Çødé wörds in an item!"), (3, prose(rng, 12))]
    docs = []
    for k in range(60):
        words = prose(rng, int(rng.integers(0, 300))).split()
        i, item = items[int(rng.integers(10))]
        part = (item or "").split()
        if k % 3 == 0 and part:
            for _ in range(k % 4):
                part[int(rng.integers(len(part)))] = "changed"
            at = int(rng.integers(len(words) + 1))
            words[at:at] = part
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "xx ünï çødé WÖRDS in an item yy"), (103, prose(rng, 20_000) + " " + items[7][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("_text", F.lit("z")).withColumn("item_id", F.lit(-1))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in contamination.contaminated(d, b).select("doc_id", "item_id", "shared", "size").collect()}
    want = plain_contained(docs, items)
    assert got == want and (103, 7, 36, 36) in want
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 300)  # several passes
    assert {tuple(r) for r in contamination.contaminated(d, b).select("doc_id", "item_id", "shared", "size").collect()} == want
    clean = contamination.without_items(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {k for k, _ in docs} - {w[0] for w in want}
    assert contamination.contaminated(d.limit(0), b).count() == 0 and contamination.contaminated(d, b.limit(0)).count() == 0
    assert contamination.without_items(d, b.limit(0)).count() == d.count()


@pytest.mark.parametrize("compress", [True, False])
def test_warc_headers_of_any_length(spark, compress):
    """Urls around and above the first window come back whole, also where a revisit refers to such a record."""
    urls = ["http://a/" + "x" * n for n in (65_000, 65_536, 70_000, 300_000)] + ["http://a/" + "é" * 50_000, "http://a/", "http://b/" + "y" * 2_000_000]
    rows = [(i, u, "same" if i in (2, 3) else f"<p>{i}</p>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = warc.read_archives(warc.write_archives(pages, compress=compress)).collect()
    assert {r.status for r in got} == {"ok"} and sorted(r.target_uri for r in got) == sorted(urls)
    assert [(r.record_id, r.refers_to) for r in got if r.record_type == "revisit"] == [("urn:page:2", "urn:page:3")]


def test_warc_header_cut_off_above_the_window():
    data = warc.record_bytes("urn:page:1", "http://a/" + "x" * 200_000, b"<p>1</p>")
    got = list(warc.salvage(io.BytesIO(data[:150_000]), 150_000))
    assert [(r["status"], r["reason"], r["length"]) for r in got] == [("quarantined", "header without end", 150_000)]


def test_salvage_within_a_member():
    parts = records(5, False)
    bad = bytearray(parts[1])
    bad[-30] ^= 0xFF
    name = lambda got: [r["record_id"] for r in got if r["status"] == "ok"]
    two = read(gzip.compress(bytes(bad) + parts[2]) + gzip.compress(parts[3]))
    assert name(two) == ["urn:page:2", "urn:page:3"]
    gap = [r for r in two if r["status"] == "quarantined"]
    assert [(g["offset"], g["place"], g["size"]) for g in gap] == [(0, 0, len(parts[1]))]
    # three records in one member that is cut off: those that inflate whole are kept
    rng = np.random.default_rng(3)
    big = [warc.record_bytes(f"urn:page:{i}", "u", rng.bytes(40_000)) for i in range(3)]
    cut = gzip.compress(b"".join(big))[:-12]
    got = read(cut + gzip.compress(parts[0]))
    assert name(got) == ["urn:page:0", "urn:page:1", "urn:page:0"]
    gap = [r for r in got if r["status"] == "quarantined"]
    assert [(g["offset"], g["length"], g["place"]) for g in gap] == [(0, len(cut), len(big[0]) + len(big[1]))]
    # a damaged place in the compressed bytes: the records before it
    broken = bytearray(gzip.compress(b"".join(big)))
    broken[100_000] ^= 0xFF
    assert name(read(bytes(broken)))[:2] == ["urn:page:0", "urn:page:1"]
    # garbage at the end of a whole member
    tail = read(gzip.compress(parts[0] + b"rubbish") + gzip.compress(parts[1]))
    assert name(tail) == ["urn:page:0", "urn:page:1"] and [(r["place"], r["size"]) for r in tail if r["status"] != "ok"] == [(len(parts[0]), 7)]


@pytest.mark.parametrize("block", ["sha256:{sha256}", "sha1:{sha1}", "md5:{md5}", "blake9:xyz", "SHA1:{b32}"])
def test_digests_of_other_algorithms(block):
    data = b"hello"
    said = block.format(sha256=hashlib.sha256(data).hexdigest(), sha1=hashlib.sha1(data).hexdigest(), md5=hashlib.md5(data).hexdigest(), b32=base64.b32encode(hashlib.sha1(data).digest()).decode().lower())
    record = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Block-Digest: {said}\r\nWARC-Payload-Digest: {said}\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n".encode()
    assert [r["status"] for r in read(record)] == ["ok"]
    if "blake9" not in block:
        assert [r["status"] for r in read(record.replace(b"hello\r\n", b"hullo\r\n"))] == ["quarantined"]


def test_top_k_is_exact_on_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) / 1024 for x in 2**26 - 1 - rng.integers(0, 300, 64)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, [0, 100, 200], 10)
