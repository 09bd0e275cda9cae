"""The ten training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaystone.llm import op1_best_fit_packing as op1
from quaystone.llm import op2_tag_path_ratios as op2
from quaystone.llm import op3_suffix_repetition as op3
from quaystone.llm import op4_byte_bpe as op4
from quaystone.llm import op5_crf_toxicity as op5
from quaystone.llm import op6_kd_sharding as op6
from quaystone.llm import op7_hierarchical_langid as op7
from quaystone.llm import op8_bayes_jaccard_join as op8
from quaystone.llm import op9_metric_range_join as op9
from quaystone.llm import op10_line_dedup as op10
from quaystone.llm.common import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
EDGE = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "Plain words, here\nand a repeated line here\nend", "en", "s", 1),
    (5, "Plain words, here\nand a repeated line here\nend", "en", "s", 1), (5, "Plain words, here\nand a repeated line here\nend", "en", "s", 1),
    (6, LONG, "en", "hot", 1), (7, "émigré naïve 中文字符 😀 ﬁn", None, "hot", 1), (None, "no id but\nand a repeated line here", "en", "hot", 1),
]
CLASH = ["score", "predicted", "kept", "n_words", "n_lines", "n_dropped", "shard", "slot", "size", "sequence_id", "length", "node", "rep", "_gone", "label"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


# 1
def test_packing_is_exact_and_tight(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = op1.pack_documents(docs, path, with_ids=True).collect()
    ids = {i: e.ids + [0] for i, e in zip(texts, tokenizer().encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids) <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert got == ids
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_plan_random():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(0, 200)))
        plan = op1.plan_sequences(collections.Counter(lengths.tolist()), cap)
        fill, used = collections.Counter(), collections.Counter()
        for k, n in enumerate(plan["length"].tolist()):
            end = plan["rank"][k + 1] if k + 1 < len(plan["length"]) and plan["length"][k + 1] == n else (lengths == n).sum()
            for j in range(end - plan["rank"][k]):
                fill[plan["sequence"][k] + j] += n
                used[n] += 1
        assert used == collections.Counter(lengths.tolist()) and max(fill.values(), default=0) <= cap


def test_packing_edges(edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = op1.pack_documents(edge, path).collect()
    assert sum(r.doc_id == 6 for r in rows) > 1 and sum(r.doc_id == 5 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert op1.pack_documents(empty, path).count() == 0


# 2
PAGE = """<html><head><title>t</title><script>if (a<b) "x</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="side ad">Buy, now.</div>
<article><h1>Head &amp; tail</h1><p>First para,  with <b>bold</b>text.<p>Second&nbsp;one; fine.<ul><li>point one, yes<li>point two</ul></article>
<div id="comments"><p>Reader, comment.</p></div><form>Name</form><footer>&copy; foot</footer>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>open <b>para &lt;x&gt;"), (5, "u", "<nav>only menu</nav>"), (6, "u", "<div>" * 3000 + "deep, text.")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in op2.extract(df, keep=["page_id", "url"]).collect()}
    assert got[1].text == "Head & tail\n\nFirst para, with boldtext.\n\nSecond one; fine.\n\npoint one, yes\n\npoint two"
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[5].text == "" and got[4].text == "open para <x>" and got[6].text == "deep, text."
    assert op2.extract(df.where("page_id < 0")).count() == 0


def test_extraction_of_pages(spark):
    import html

    for r in op2.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(x for x in blocks if x)


# 3
def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs, texts):
    for r in op3.quality(docs).collect():
        n, chars, symbols, dup, rep = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)


def test_quality_repeat_lengths():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 3, int(rng.integers(0, 25))).tolist() for _ in range(100)]
    want = []
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    flat, doc = np.array(sum(texts, []), dtype=np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert op3.repeat_lengths(flat, doc).tolist() == want


def test_quality_edges(edge, empty):
    got = op3.quality(edge).collect()
    assert [r.kept for r in got if r.doc_id in (1, 2, 3)] == [False] * 3
    assert next(r for r in got if r.doc_id == 6).n_words == 60_000 and not next(r for r in got if r.doc_id == 6).kept
    assert op3.passing(edge).columns == edge.columns and op3.quality(empty).count() == 0


# 4
def test_bpe_round_trip(edge, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op4.read_ranks(path), special_tokens={})
    for r, text in zip(op4.encode_documents(edge, path, public_tokenizers.PATTERN, digests=True).collect(), (x[1] or "" for x in EDGE), strict=True):
        want = enc.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op4.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_texts():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = op4.ByteBpe(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "²", "é", "!", "'s", "'ll", "中", " ", "　", "\x1c", "\x85", "<|endoftext|>", "́", "😀", "x" * 50]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(3000)]
    ids = bpe.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [enc.encode_ordinary(t) for t in texts]
    assert [bpe.decode(i) for i in ids] == [t.encode() for t in texts]


def test_perfect_hash():
    keys = {f"k{i}".encode(): i for i in range(5000)}
    h = op4.PerfectHash(keys)
    assert h.find(list(keys)) == list(keys.values()) and h.find([b"missing", b""]) == [-1, -1]
    assert sorted(h.ids.tolist()) == list(range(5000))  # minimal: every slot is taken once


# 5
def toxic_corpus(n):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "the and our sun hill river stone".split() for b in ("", "s", "ing", "ed", "ly")]
    rows = []
    for i in range(n):
        own = list(rng.choice(words, 80))
        if i % 4 == 0:
            own[int(rng.integers(0, 80))] = str(rng.choice(["vile", "vileness", "nasty"]))
        rows.append((i, " ".join(own[:40]) + "\n" + " ".join(own[40:]), int(i % 4 == 0)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus(800)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = op5.train_model(df, labels)
    got = {r.doc_id: r for r in op5.score_documents(df, model, with_spans=True).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.97
    i, text, _ = next(x for x in held if x[2])
    assert {text[s.start : s.end] for s in got[i].spans} <= {"vile", "vileness", "nasty"} and got[i].spans


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = op5.train_model(edge, labels)
    got = op5.score_documents(edge, model, with_spans=True).collect()
    assert len(got) == len(EDGE) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    assert op5.score_documents(empty, model).count() == 0 and op5.clean(edge, edge, labels).columns == edge.columns


def test_chain_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = op5.chain_marginals(unary, np.array([0, 1, 5]), lengths, trans, pairs=True)
    want, total = [], np.zeros((2, 2))
    for a, n in zip([0, 1, 5], lengths, strict=True):
        z, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[a + k] for k in range(n) if y[k]) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            one += w * np.array(y)
            for k in range(n - 1):
                two[y[k], y[k + 1]] += w
        want += (one / z).tolist()
        total += two / z
    np.testing.assert_allclose(p, want)
    np.testing.assert_allclose(pairs, total)


# 6
def test_sharding(docs):
    rows = op6.shard(docs).toPandas()
    assert len(rows) == docs.count() and set(rows.law) == {"bytes"} and rows.shard.between(0, 39).all()
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    by = rows.groupby("shard")["size"].sum()
    assert by.max() <= by.mean() + rows["size"].max()


def test_sharding_is_even_with_a_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copied " * 20).otherwise(F.concat(F.lit("own text "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    by = op6.shard(df).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(by) == 40 and by.max() / by.mean() < 1.06 and by.min() / by.mean() > 0.94


def test_sharding_edges(edge, empty, spark):
    rows = op6.shard(edge).collect()
    assert len(rows) == len(EDGE) and sorted(r["size"] for r in rows)[:2] == [16, 16]
    assert op6.shard(empty).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(20)], "doc_id long, text string")
    assert op6.shard(same).count() == 20


# 7
def test_language_held_out(docs, texts):
    model = op7.train_model(docs)
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r.lang_pred for r in op7.identify(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1 and len(texts[i]) > 200]
    assert np.mean([got[i] == want[i] for i in held]) > 0.9


def test_language_edges(edge, empty, docs):
    model = op7.train_model(docs)
    got = {r.doc_id: r for r in op7.identify(edge, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert op7.identify(empty, model).count() == 0
    assert {r.lang_pred for r in op7.identify(edge, op7.train_model(empty)).collect()} == {"und"}


# 8
def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_corpus():
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"t{x}" for x in rng.integers(0, 500, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 30))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"t{rng.integers(0, 500)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    rows = near_corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    cls = {}
    for i in sets:
        if i not in cls:
            stack = [i]
            while stack:
                if (x := stack.pop()) not in cls:
                    cls[x] = i
                    stack += links[x]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (op8.BLOCK, 40):  # the second makes several blocks of the larger groups
        monkeypatch.setattr(op8, "BLOCK", block)
        got = {r.doc_id: r for r in op8.jaccard_classes(df).collect()}
        assert {i: r.class_id for i, r in got.items()} == cls
        assert {i: r.n_links for i, r in got.items()} == {i: len(v) for i, v in links.items()}


def test_jaccard_edges(edge, empty):
    got = op8.jaccard_classes(edge).collect()
    assert len(got) == len(EDGE)
    assert all(r.n_links == 2 and r.class_id == 4 for r in got if r.doc_id in (4, 5)) and all(r.n_links == 0 and r.kept for r in got if r.doc_id not in (4, 5))
    assert op8.jaccard_classes(empty).count() == 0 and op8.one_of_each(edge).columns == edge.columns


def test_posterior_limits():
    least = op8.least_matches(0.8, 1e-9)
    assert len(least) == op8.HASHES // op8.STEP and list(least) == sorted(least) and least[-1] < 0.8 * op8.HASHES


# 9
def test_range_join_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        v = rng.normal(size=8) + 4 * rng.normal(size=(5, 8))[i % 5] * 0 + np.eye(8)[i % 4] * 6
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [float("nan")] + [1.0] * 7, 0), (404, [None] + [1.0] * 7, 0), (405, rows[0][1], None), (406, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    good = [(i, np.array(v), l) for i, v, l in rows if i < 400]
    links = {i: {j for j, y, m in good if j != i and m == l and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93} for i, x, l in good}
    got = {r.vec_id: r for r in op9.range_join(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.n_links == len(links.get(i, ()))
        seen, stack = set(), [i]
        while stack:
            if (x := stack.pop()) not in seen:
                seen.add(x)
                stack += links.get(x, ())
        assert r.component_id == min(seen) and r.kept == (i == min(seen))


def test_range_join_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op9.range_join(df).count() == 0


# 10
def brute_lines(rows):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                owner[key(x)] = min(owner.get(key(x), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < 10 or owner[key(x)] >= i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(10)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["short", "", "  LINE number 3 of the POOL ", "ÄÖÜ äöü ß 12"]
    rows = [(int(i), "\n".join(rng.choice(pool, int(rng.integers(0, 9))))) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 2), (4, 3), (5, 2)):
        got = op10.drop_repeated_lines(df, n_batches=batches, fanout=fanout).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(brute_lines(rows))


def test_line_dedup_edges(edge, empty):
    got = op10.drop_repeated_lines(edge).collect()
    want = brute_lines([(r[0], r[1]) for r in EDGE])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=key) == sorted(want, key=key)
    assert op10.drop_repeated_lines(empty).count() == 0


# shared
def test_components(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0.5 * n <= docs.count() <= n, name
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == ids
