"""Resampling, archives and periodic runs against brute force, SQL and round trips, and their edge cases."""

import base64
import collections
import hashlib
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quaystone.llm import op11_importance_resampling as op11
from quaystone.llm import op12_warc_zstd as op12
from quaystone.llm import op13_periodic_runs as op13

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
CLASH = ["score", "weight", "rank", "runs", "collapsed", "segment", "seq", "down", "n_words", "payload_digest", "record_type", "key", "owner", "n"]
EDGE = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "one two " * 30, "en"), (5, "one two " * 30, "en"), (5, "one two " * 30, "en"),
    (None, "Émigré naïve 中文 😀 " * 12, "en"), (6, " ".join(f"w{i % 997}" for i in range(60_000)), "x"), (7, "x" * 300 + " a\x00b", "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit("x") for c in CLASH})


def against_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, DATA).select(names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("op", [op11, op12, op13])
def test_query_equals_its_sql(spark, op):
    against_sql(spark, op.query, op.SQL)


# 11
def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_scores(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t, *_ in docs for f in features_of(t))
    t = collections.Counter(bucket(f) for x in target for f in features_of(x))
    big, small = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in range(10000)]
    for i, text, *_ in docs:
        f = features_of(text)
        weight = sum(gain[bucket(x)] for x in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        yield i, len(f), weight, score, len(words_of(text)) >= 20


def test_resampling_edges(spark, edge):
    target = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    want = list(brute_scores(EDGE, ["one two three", None]))
    got = op11.resampled(edge, target, percent=60).collect()
    assert sorted((r[:4] for r in map(tuple, got)), key=str) == sorted((r[:4] for r in want), key=str)
    able = sorted((-s, i) for i, _, _, s, ok in want if ok and i is not None)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [(s, i) for _, s, i in drawn] == able[: 60 * len(able) // 100] and [r for r, _, _ in drawn] == list(range(1, len(drawn) + 1))
    assert op11.resampled(edge.limit(0), target).count() == 0
    assert op11.resampled(edge, target.limit(0)).where("rank is not null").count() == 0  # 5 % of four rows


def test_ranks_of_many_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(s)) for i, s in enumerate(rng.integers(0, 4, 3000))] + [(7, 2)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    want = sorted((-s, i) for i, s in rows)
    for drawn in (0, 1, 1700, 5000):
        got = op11.ranked(df, drawn, n_segments=9)
        assert got.count() == 5000
        placed = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got.where("rank is not null").collect())
        assert [r for r, _, _ in placed] == list(range(1, drawn + 1)) and [(s, i) for _, s, i in placed] == want[:drawn]


def test_equal_rows_are_parted(spark):
    """Splitters part rows that are equal in score and id, so no segment holds them all."""
    runs = spark.range(4000).select((F.col("id") * 0).alias("doc_id"), (F.col("id") * 0).alias("down"), F.monotonically_increasing_id().alias("seq")).repartition(4)
    sizes = [r["count"] for r in op11.in_segments(runs, op11.splitters(runs, 8, 4)).groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 900


def test_crc_of_long_runs():
    h = op11.Hasher()
    texts = [b"a " + b"B" * 500 + b" c-d " + "é".encode() * 70, b"", b"x", b"y z " * 5]
    got = [(int(c), int(t)) for crc, text in h.runs(texts, 4) for c, t in zip(crc, text, strict=True)]
    want = []
    for k in range(1, 5):
        for j, t in enumerate(texts):
            w = words_of(t.decode())
            want += [(zlib.crc32(" ".join(w[i : i + k]).encode()), j) for i in range(len(w) - k + 1)]
    assert sorted(got) == sorted(want)


# 12
PAGES = [
    (1, "u/1", "<p>one</p>"), (2, "u 2\r\nX: y", "<p>one</p>"), (0, None, "<p>zero</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>one</p>"), (None, "u", "<p>lone é</p>"),
    (5, "u", "x" * 300_000), (6, "u", "x" * 300_000), (5, "u", "x" * 300_000), (5, "u", "other payload\r\n\r\n"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, least=0):
    owner = {}
    for i, _, x in pages:
        if i is not None and len((x or "").encode()) >= least:
            owner[digest(x)] = min(i, owner.get(digest(x), i))
    for i, _, x in pages:
        d = digest(x)
        refers = owner.get(d) if owner.get(d) != i else None
        yield i, len((x or "").encode()), d, "response" if refers is None else "revisit", refers


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_archives_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(op12, "ARCHIVE_BYTES", 400)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH}).coalesce(1)
    manifest, path = op12.archived(pages, least_bytes=least)
    got = op12.read_archives(manifest, path, with_payload=True).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == sorted(expected(PAGES, least), key=str)
    html = collections.Counter(((x or "").encode(), i) for i, _, x in PAGES)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert html[bytes(r.payload), r.page_id]
    assert {r.url for r in got if r.page_id == 2} == {"u%202%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 0} == {None}
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES)


def test_archives_of_no_page(spark):
    manifest, path = op12.archived(spark.createDataFrame([], "page_id long, url string, html string"))
    assert op12.read_archives(manifest, path).count() == 0


def test_hot_digests_and_dictionary(spark, monkeypatch):
    monkeypatch.setattr(op12, "HEAVY", 10)
    rows = [(i, f"u/{i}", f"<html><body class='article'>{'same' if i % 3 == 0 else i // 2 * 7919 % 10007} words of a page, again and again</body></html>") for i in range(600)]
    manifest, path = op12.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {tuple(r[c] for c in COLS) for r in op12.read_archives(manifest, path).collect()}
    assert got == set(expected(rows))
    for r in manifest.collect():
        raw = open(f"{path.removeprefix('file://')}/{r['name']}", "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and len(raw) == r["bytes"]
        known = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()  # a record can be read without those before it
        assert frame.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: ") and frame.eof
        plain = zstandard.ZstdCompressor(level=op12.LEVEL)
        assert r["bytes"] - 8 - size < 0.7 * sum(len(plain.compress(x)) for x in op12.frames(open(f"{path.removeprefix('file://')}/{r['name']}", "rb")))


def test_broken_archives_are_refused():
    good = op12.record(1, "u", b"<p>", 3, digest("<p>"), None)
    assert op12.parsed(good)[:6] == (1, "u", 3, digest("<p>"), "response", None)
    for bad in (good.replace(b"<p>", b"<q>"), good[:-1], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            op12.parsed(bad)


# 13
def brute_runs(w, least=12):
    best = {}
    for q in range(1, len(w)):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng, found = np.random.default_rng(0), 0
    for _ in range(400):
        docs = []
        for _ in range(3):
            parts = []
            for _ in range(int(rng.integers(0, 5))):
                parts += rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 12))).tolist() * int(rng.integers(1, 9))
                parts += [9] * int(rng.random() < 0.3)
            docs.append(parts)
        least = int(rng.integers(2, 15))
        got = op13.runs_of(np.array([len(d) for d in docs]), np.array(sum(docs, []), dtype=np.int64), least)
        assert got == [brute_runs(d, least) for d in docs]
        found += sum(map(len, got))
    assert found > 1000


def test_runs_of_long_repetition():
    for words, n in (([0] * 100_000, 1), ([0] * 3000 + [1] + [0] * 3000, 2), (([0] * 300 + [1]) * 40, 41)):
        assert len(op13.runs_of(np.array([len(words)]), np.array(words, dtype=np.int64))[0]) == n


def test_periodic_runs_edges(spark, edge):
    got = op13.periodic_runs(edge).collect()
    assert len(got) == len(EDGE) and got[0].score == "x"
    for r, (_, text, _) in zip(sorted(got, key=lambda r: str((r.doc_id, r.text))), sorted(EDGE, key=lambda r: str((r[0], r[1]))), strict=True):
        w = (text or "").split()
        runs = brute_runs(w) if len(w) < 1000 else [(0, 60_000, 997)]
        assert [tuple(x) for x in r.runs] == runs
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert op13.periodic_runs(edge.limit(0)).count() == 0
