"""Periodic runs, importance resampling and WARC archives against brute-force versions, and their edge cases."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, periodic_runs, warc

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "x" * 5000), (7, "word " * 30000), (7, "word " * 30000), (None, "a b"), (9, "π " * 7)]


def frame(spark, rows):
    """Rows as documents with clashing extra columns."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "runs", "start", "n_words", "features", "bucket", "n", "row_key", "copy")})


# ---- operator 11 ----------------------------------------------------------------------------


def brute_runs(words, least=6, exponent=4):
    """Every period on its own, from the definition."""
    runs = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(least, exponent * q) and j > i and not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                runs.append((i, len(stretch), q))
            i = j + 1 if j > i else i + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = (None, None, None, None)
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(kept)))


def random_words(rng):
    words = []
    while len(words) < rng.randint(1, 120):
        base = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 9))]
        words += base * rng.randint(1, 7)
        if rng.random() < 0.5:
            del words[-rng.randint(1, len(base)) :]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = rng.randrange(4)
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 3), (9, 3), (4, 5)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        words = random_words(rng)
        assert periodic_runs.find_runs(np.array(words, np.int64), least, exponent) == brute_runs(words, least, exponent), words


def test_splitting_reaches_stability():
    rng = random.Random(5)
    for _ in range(200):
        words = np.array(random_words(rng) + [rng.randrange(200) for _ in range(rng.choice([0, 50, 3000]))])
        segments = list(periodic_runs.split(words))
        for lo, hi in segments:
            assert hi - lo >= 6 and np.unique(words[lo:hi], return_counts=True)[1].min() >= 4
        def plain(lo, hi):  # noqa: E306
            values, counts = np.unique(words[lo:hi], return_counts=True)
            cuts = [i for i in range(lo, hi) if words[i] in set(values[counts < 4])]
            if not cuts:
                return [(lo, hi)] if hi - lo >= 6 else []
            edges = [lo - 1, *cuts, hi]
            return [s for a, b in zip(edges, edges[1:]) for s in plain(a + 1, b)]
        assert sorted(segments) == sorted(plain(0, len(words)))


def test_long_sequences_in_near_linear_time():
    rng = np.random.default_rng(1)
    n = 1 << 19
    nested = np.concatenate([np.arange(n // 8)] * 3 + [np.arange(n // 8)[::-1]] * 2 + [np.zeros(n // 4, int)])  # peels from its ends
    for words in (np.zeros(n, int), rng.integers(0, 2, n), np.tile(np.arange(1000), n // 1000), nested):
        began = time.time()
        periodic_runs.find_runs(words)
        assert time.time() - began < 40


def test_runs_of_documents(spark):
    rows = [(i, t) for i, t in ODD if i != 7] + [(i, " ".join(f"w{w}" for w in random_words(random.Random(i)))) for i in range(10, 300)]
    df = frame(spark, rows).repartition(3)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df, edit=periodic_runs.with_made_run).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        edited = [w.decode() for w in periodic_runs.with_made_run(i, [w.encode() for w in words])]
        assert [tuple(r) for r in got[i].runs] == brute_runs(edited)
    assert got[1].collapsed == "" and got[4].collapsed == "a b" and got[None].collapsed == "a b"
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0
    long = periodic_runs.periodic_runs(frame(spark, [r for r in ODD if r[0] == 7])).collect()
    assert [(list(map(tuple, r.runs)), r.collapsed) for r in long] == [([(0, 30000, 1)], "word")] * 2


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11(spark, DATA).collect()}
    small = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 2000]
    assert len(small) > 150
    for r in small:
        assert got[r.doc_id] == brute_digest(r.doc_id, r.text)


# ---- operator 12 ----------------------------------------------------------------------------


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_grams(text, least, most):
    w = brute_words(text)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("grams", [(1, 1), (1, 3), (2, 2)])
def test_overlapped_scan_equals_brute_force(grams):
    rng = random.Random(3)
    texts = [None, "", "  ", "Ab", "a-b_c  d", "ÀÉ É\x00x\x7fy", "naïve…Straße 12,5", "a a a a"] + ["".join(rng.choice("aB 9-é\n。") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        want = [zlib.crc32(g.encode()) % 97 for g in brute_grams(t, *grams)]
        assert importance.gram_buckets(importance.normalised(t), importance.gram_patterns(grams), 97) == want, t


def brute_resample(docs, target, percent=10, least=20, grams=(1, 1), buckets=10000, seed=2024):
    hashes = lambda t: [zlib.crc32(g.encode()) % buckets for g in brute_grams(t, *grams)]
    s, t = np.zeros(buckets), np.zeros(buckets)
    np.add.at(s, [b for _, x in docs for b in hashes(x)], 1)
    np.add.at(t, [b for x in target for b in hashes(x)], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = hashes(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(brute_words(x)), len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], -r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 50, "least_words": 2, "grams": (1, 2), "buckets": 50, "seed": 7}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_resample_equals_brute_force(spark, options):
    rng = random.Random(2)
    rows = ODD + [(i, " ".join(rng.choice(["alpha", "beta", "Gamma", "δ", "12"]) for _ in range(rng.randint(0, 60)))) for i in range(20, 160)]
    target = ["alpha beta, alpha!", None, "", "δ δ"]
    renamed = {"least_words": "least"}
    got = importance.resample(frame(spark, rows).repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, **{renamed.get(k, k): v for k, v in options.items()})


def test_resample_of_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), target).count() == 0
    rows = [(i, "some words " * 15) for i in range(40)]
    got = importance.resample(frame(spark, rows), target).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, [])


def test_importance_sample_keeps_columns(spark):
    rows = [(i, "some words " * 15) for i in range(40)] + [(99, None)]
    df = frame(spark, rows)
    got = importance.importance_sample(df, df.limit(3))
    assert got.columns == df.columns and got.count() == 4


# ---- operator 13 ----------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/ö b", "<p>naïve</p>" * 900),
    (2, None, "<p>naïve</p>" * 900),
    (3, "http://c.example/", None),
    (4, "http://d.example/", ""),
    (5, "http://e.example/WARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 500),
    (6, "http://f.example/", "WARC/1."),
    (7, "http://f.example/\r\nEvil: yes", "\r\n\r\n0\r\n\r\n"),
    (8, "http://g.example/", "é" * 100_000),
    (8, "http://g.example/", "é" * 100_000),
    (9, "http://g.example/", "é" * 100_000),
    (None, "http://h.example/", "x"),
    (None, None, "x"),
    (10, "http://h.example/", "y"),
    (10, "http://h.example/2", "y"),
    (11, "u", "WARC/1.WARC/1.WARC/1."),
]


def pages_frame(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in ("record_id", "payload", "row_key", "sha1", "copy", "n", "bytes", "fault", "value")})


def read_back(spark, path):
    return warc.read_pages(spark, str(path)).collect()


@pytest.mark.parametrize("segment,chunk", [(8192, 4096), (50, 7), (101, 0), (10**6, 1)])
def test_archives_round_trip(spark, tmp_path, segment, chunk):
    rows = [r if r[0] not in (8, 9) or segment > 4096 else (r[0], r[1], "é" * 1500) for r in PAGES]
    warc.write_archives(pages_frame(spark, rows).repartition(3), str(tmp_path / "w"), segment_bytes=segment, chunk_bytes=chunk)
    got = read_back(spark, tmp_path / "w")
    assert len(got) == len(rows) and all(r.fault is None for r in got)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    whole = lambda r: responses[r.refers_to].payload if r.refers_to else r.payload
    plain = lambda i, h: (str(i) if i is not None else None, (h or "").encode())
    assert sorted(((r.page_id, bytes(whole(r))) for r in got), key=str) == sorted((plain(i, h) for i, _, h in rows), key=str)
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(whole(r)).digest()).decode() for r in got)
    first = {}
    for i, _, h in rows:
        if i is not None and (h or "") not in first:
            first[h or ""] = i
    first["x"] = None
    assert sorted(str(r.page_id) for r in responses.values()) == sorted(str(i) for i in first.values())
    assert all(responses[r.refers_to].page_id == str(first[whole(r).decode()]) or r.page_id is None for r in got if r.refers_to)


def test_payloads_below_the_least_size_are_all_responses(spark, tmp_path):
    warc.write_archives(pages_frame(spark), str(tmp_path / "w"), min_bytes=5)
    got = read_back(spark, tmp_path / "w")
    assert sorted(str(r.page_id) for r in got if r.record_type == "revisit") == ["2", "8", "9"] and len(got) == len(PAGES)
    again = [(1, "u", "x"), (1, "u", "x"), (1, "u", "x")]
    warc.write_archives(pages_frame(spark, again), str(tmp_path / "v"), min_bytes=5)
    got = read_back(spark, tmp_path / "v")
    assert [(r.page_id, r.record_type, bytes(r.payload), r.fault) for r in got] == [("1", "response", b"x", None)] * 3 and len({r.record_id for r in got}) == 3


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages_frame(spark, []), str(tmp_path / "w"))
    assert read_back(spark, tmp_path / "w") == []


def test_archives_hold_what_the_format_asks_for(spark, tmp_path):
    warc.write_archives(pages_frame(spark, PAGES[:1]), str(tmp_path / "w"), segment_bytes=4000)
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    heads = [warc.parse_head(h) for h in re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", raw, re.S)]
    kinds = [h["warc-type"] for h in heads if h["warc-type"] != "warcinfo"]
    assert kinds == ["response", "continuation", "continuation"]
    parts = [h for h in heads if "warc-segment-number" in h]
    assert [h["warc-segment-number"] for h in parts] == ["1", "2", "3"] and len({h["warc-record-id"] for h in heads}) == len(heads)
    assert all(h["warc-segment-origin-id"] == parts[0]["warc-record-id"] for h in parts[1:]) and "warc-segment-total-length" not in parts[1]
    assert int(parts[2]["warc-segment-total-length"]) == sum(int(h["content-length"]) for h in parts) and parts[0]["warc-target-uri"] == "http://a.example/ö%20b"


def http(body, framing=b"Transfer-Encoding: chunked"):
    return b"HTTP/1.1 200 OK\r\n" + framing + b"\r\n\r\n" + body


@pytest.mark.parametrize("block,want", [
    (http(b"3\r\nabc\r\n0\r\n\r\n"), (b"abc", None)),
    (http(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n"), (b"abc0123456789", None)),
    (http(b"3\r\nab\r\n0\r\n\r\n"), (None, "chunk length")),
    (http(b"zz\r\nab\r\n0\r\n\r\n"), (None, "chunk size")),
    (http(b"3\r\nabc\r\n"), (None, "chunk size")),
    (http(b"3\r\nabc\r\n0\r\n"), (None, "chunk end")),
    (http(b"abc", b"Content-Length: 3"), (b"abc", None)),
    (http(b"abc", b"Content-Length: 4"), (None, "HTTP length")),
    (b"junk", (None, "no HTTP header")),
    (b"", (None, "no HTTP header")),
])
def test_http_framing(block, want):
    assert warc.decode_http(block) == want


def segment(number, part, total=None, origin="<a>", type_="continuation", digest=None):
    head = [("WARC-Type", type_ if number > 1 else "response"), ("WARC-Record-ID", origin if number == 1 else f"<{origin}{number}>"), ("WARC-Segment-Number", number)]
    head += [("WARC-Segment-Origin-ID", origin if number > 1 else None), ("WARC-Segment-Total-Length", total), ("WARC-Block-Digest", digest)]
    return warc.warc_record(head, part) + b"\r\n\r\n"


def test_broken_archives_are_reported(spark, tmp_path):
    body = http(b"6\r\nabcdef\r\n0\r\n\r\n")
    a, b, c, n = body[:20], body[20:40], body[40:], len(body)
    whole = lambda o: segment(1, a, origin=o) + segment(3, c, n, origin=o) + segment(2, b, origin=o)
    files = {
        "good": whole("<good>"),
        "gap": segment(1, a, origin="<gap>") + segment(3, c, n, origin="<gap>"),
        "twice": whole("<twice>") + segment(2, b, origin="<twice>"),
        "twice2": segment(1, a, origin="<twice2>") + segment(3, c, len(a) + 2 * len(c), origin="<twice2>") + segment(3, c, origin="<twice2>"),
        "lost": segment(2, b, origin="<lost>") + segment(3, c, n, origin="<lost>"),
        "total": segment(1, a, origin="<total>") + segment(2, body[20:], n + 1, origin="<total>"),
        "untold": segment(1, a, origin="<untold>") + segment(2, body[20:], origin="<untold>"),
        "digest": segment(1, a, origin="<digest>", digest="sha1:AAAA") + segment(2, body[20:], n, origin="<digest>"),
        "cut": whole("<fine>") + warc.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<cut>")], body)[:-4],
        "payload": warc.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<payload>"), ("WARC-Payload-Digest", "sha1:AAAA")], body) + b"\r\n\r\n",
        "junk": b"no archive at all",
        "headless": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <headless>\r\n",
        "none": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <none>\r\n\r\nabc\r\n\r\n",
        "big": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <big>\r\nContent-Length: 99999999999999999999999\r\n\r\nabc\r\n\r\n",
        "huge": segment(2, b, origin="<huge>").replace(b"Number: 2", b"Number: 9000000000000000000"),
    }
    os.mkdir(tmp_path / "w")
    for name, raw in files.items():
        with gzip.open(tmp_path / "w" / f"{name}.warc.gz", "wb") as f:
            f.write(raw)
    got = {r.record_id: (r.payload and bytes(r.payload), r.fault) for r in read_back(spark, tmp_path / "w")}
    assert got == {
        "<good>": (b"abcdef", None), "<fine>": (b"abcdef", None), "<gap>": (None, "missing segment"), "<twice>": (None, "repeated segment"), "<twice2>": (None, "missing segment"),
        "<lost>": (None, "missing segment"), "<total>": (None, "total length"), "<untold>": (None, "no total length"), "<digest>": (None, "block digest"), "<cut>": (None, "truncated"),
        "<payload>": (None, "payload digest"), "<headless>": (None, "no header end"), "<none>": (None, "no length"), "<big>": (None, "truncated"), "<huge>": (None, "segment number"),
    }


def test_uncompressed_archives_of_several_members(spark, tmp_path):
    warc.write_archives(pages_frame(spark), str(tmp_path / "w"), segment_bytes=3000)
    os.mkdir(tmp_path / "plain")
    parts = [open(tmp_path / "w" / f, "rb").read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]
    with open(tmp_path / "plain" / "a.warc", "wb") as f:
        f.write(b"".join(map(gzip.decompress, parts)))
    os.mkdir(tmp_path / "joined")
    with open(tmp_path / "joined" / "a.warc.gz", "wb") as f:
        f.write(b"".join(parts))
    want = sorted((str(r.page_id), r.payload_digest, r.fault) for r in read_back(spark, tmp_path / "w"))
    assert want == sorted((str(r.page_id), r.payload_digest, r.fault) for r in read_back(spark, tmp_path / "plain"))
    assert want == sorted((str(r.page_id), r.payload_digest, r.fault) for r in read_back(spark, tmp_path / "joined"))


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_warc"])
def test_queries_agree_with_sql(spark, name):
    from tidemark.llm import queries

    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in df.select(*want.columns).collect()) == sorted(str(tuple(r)) for r in want.fetchall())
