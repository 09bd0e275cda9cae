"""Packing: the index of sums against brute force, and encoding by distinct words against the tokenizer."""

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa

from quaystone.llm import op1_best_fit_packing as op1


def usable(avail, lengths):
    return all(avail[n] >= lengths.count(n) for n in lengths)


def test_sums_of_what_is_left():
    rng = np.random.default_rng(1)
    for _ in range(30):
        avail = rng.integers(0, 3, 25) * (rng.random(25) < 0.5)
        avail[0] = 0
        index = op1.SumIndex(avail)
        while avail.any():
            for gap in range(1, 25):
                for k, find in ((2, index.pair), (3, index.triple)):
                    could = any(sum(c) == gap and usable(avail, list(c)) for c in itertools.combinations_with_replacement(np.flatnonzero(avail).tolist(), k))
                    got = find(gap)
                    assert (got is not None) == could
                    assert got is None or (sum(got) == gap and len(got) == k and usable(avail, got))
            avail[rng.choice(np.flatnonzero(avail))] -= 1


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), op1.Encoder(path)
    rng = np.random.default_rng(2)
    alphabet = list("aAbZéÉßÿŸĭİıªµ·'’s!.,;%#$|<>-_09 \n\t\x1c  ̸́中😀") + ["don't", "<|endoftext|>", "Straße", "'s", "the ", "ﬁ", "x" * 90]
    monkeypatch.setattr(op1, "MEMO_BYTES", 20_000)
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(25)] + [None, "", " \n"]
        ids, bounds = enc.encode(pa.array(texts, pa.string()), 0)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0], t
