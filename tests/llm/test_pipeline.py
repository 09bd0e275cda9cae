"""Each stage of the corpus pipeline against brute force on what the stage before it kept, over hard rows as well."""

import collections
import re
import string

import corpus_pipeline
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from quaystone.llm import op3_suffix_repetition as op3
from quaystone.llm import op5_crf_toxicity as op5

DATA = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
COPY = " ".join(f"word{k}" for k in range(80))
HARD = [
    (1_000_001, None, "en", "hard", None), (1_000_002, "", None, "hard", 0), (1_000_003, " \n\t", "en", None, 3), (1_000_004, COPY, "en", "hard", 1), (1_000_005, COPY + " more", "en", "hard", 1), (1_000_006, COPY, "en", "hard", 1),
    (1_000_007, "same row " + " ".join(f"r{k}" for k in range(60)), "en", "hard", 1), (1_000_007, "same row " + " ".join(f"r{k}" for k in range(60)), "en", "hard", 1), (None, "no id at all " + " ".join(f"n{k}" for k in range(60)), "en", "hard", 1),
    (1_000_008, "A line that is said twice over\n" + " ".join(f"x{k}" for k in range(60)), "en", "hard", 1), (1_000_009, " a LINE that is said twice over \n" + " ".join(f"y{k}" for k in range(60)), "en", "hard", 1),
    (1_000_010, " ".join(f"z{k}" for k in range(30_000)), "en", "hard", 1),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    hard = spark.createDataFrame(HARD, docs.schema)
    docs.union(hard).withColumns({c: F.lit("x") for c in ("score", "kept", "n_words", "text_", "node", "_gone", "length", "offset")}).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def key(line):
    return line.strip(SPACES).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def without_repeats(rows):
    owner, held = {}, collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    owner = {k: min(ids) for k, ids in held.items() if len(ids) > 1}
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or owner.get(key(x), i) >= i]
        yield i, t if len(left) == len(lines) else "\n".join(left)


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}_\p{M}]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def one_of_each(rows):
    rows = list(dict.fromkeys(rows))  # repeated rows are one
    named = [(i, t, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _, _ in named}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, t, s) in enumerate(named):
        for j, u, r in named[:a]:
            same = (t or "") == (u or "") if s is None or r is None else 10 * len(s & r) >= 8 * len(s | r)
            if same:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, t or "") for i, t in rows if i is None or find(i) == i), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept[name] = text(docs), text(out)
        path = f"{folder}/{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.dtypes == out.dtypes
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = op5.score_documents(whole, op5.train_model(whole, labels), keep=["doc_id", "text"])
    assert kept["toxicity"][1] == text(scored.where("predicted = 0"))

    before, after = kept["quality_rules"]
    verdict = {(r.doc_id, r.text): r.kept for r in op3.quality(spark.read.parquet(f"{folder}/toxicity.parquet"), keep=["doc_id", "text"]).collect()}
    assert after == [row for row in before if verdict[row]] and not any(len(re.split(f"[{SPACES}]+", (t or "").strip(SPACES))) < 50 for _, t in after)

    before, after = kept["line_dedup"]
    assert after == sorted(without_repeats(before), key=str)
    before, after = kept["ngram_jaccard_join"]
    assert [(i, t or "") for i, t in after] == one_of_each([(i, t) for i, t in before])
    ids = {i for i, _ in after}
    assert 1_000_004 in ids and not ids & {1_000_005, 1_000_006} and None in ids and [i for i, _ in after].count(1_000_007) == 1 and 1_000_010 in ids

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in after)
    got = collections.defaultdict(int)
    for r in packed:
        got[r.doc_id] += r.length
    assert sorted(got.items(), key=str) == sorted(want, key=str)
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_no_documents(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
