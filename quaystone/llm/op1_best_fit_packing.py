"""Best-fit packing of token pieces into sequences of at most ``capacity`` tokens.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever the
corpus: exact-complement hashing first (longest length first, its gap is looked up in an index of single
lengths, pair sums and triple sums under what is still available, and the combination is consumed in bulk),
then best fit of what is left, longest first, into the open sequence with the smallest gap that holds it.
Pieces get their place by rank within their length; ranks come from per-block counts, and a length has as
many blocks as its count asks for, so a length that holds a third of all pieces is still dealt over many tasks.

Defined cases: null text counts as empty (one piece of the end id alone); rows that repeat a doc_id are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, tidy

CAPACITY = 2048
#: Bytes of text numbered together.
SLICE = 4 << 20
#: Bytes of words and ids, with their overhead, that a task remembers between slices.
MEMO_BYTES = 48 << 20
#: Longer words are encoded again in each slice.
MEMO_WORD = 64
#: Pieces of one length that one task ranks.
BLOCK_ROWS = 1_000
#: Words whose ids are gathered at once.
GATHER = 1 << 20
MARKS = ".,;:!?%#$*&|<>()-"
#: Letters that the tokenizer's normaliser changes in case only.
LETTERS = "".join(chr(c) for c in range(0x130) if chr(c).isalpha())


def gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``ids[start : start + length]`` of every row, one after another."""
    to = np.cumsum(length)
    return ids[np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - length), length)]


class Encoder:
    """Ids of whole texts, by way of their distinct words.

    The tokenizer drops white space and never joins across it, so ids of a text are those of its words.  A
    slice's words are numbered, distinct ones are parted into letters and the marks behind them where the
    tokenizer parts them too, each distinct part is encoded once, and the ids of the texts are gathered by
    number.  ``known`` keeps parts between slices, within MEMO_BYTES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
        if kind["model"].get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("needs a tokenizer of lower-cased words that end in </w>")
        self.tok, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower-case letters alone need no normaliser, and white space parts them
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.held = {"": 0}, 0
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, parts: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        n = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids.astype(np.uint32)])
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.held += 150 * len(parts) + 4 * len(ids) + sum(map(len, parts))

    def add_any(self, parts: list[str]) -> None:
        for a in range(0, len(parts), 4096):
            made = [e.ids for e in self.tok.encode_batch_fast(parts[a : a + 4096], add_special_tokens=False)]
            self.add(parts[a : a + 4096], np.array([i for m in made for i in m], np.int64), np.array([len(m) for m in made], np.int64))

    def add_letters(self, parts: list[str]) -> None:
        """Lower-case letters alone: 64 to a text, an id that ends a word parts them."""
        for a in range(0, len(parts), 1 << 14):
            own = parts[a : a + (1 << 14)]
            made = self.letters.encode_batch_fast([" ".join(own[k : k + 64]) for k in range(0, len(own), 64)], add_special_tokens=False)
            ids = np.array([i for e in made for i in e.ids], np.int64)
            to = np.flatnonzero(self.last[ids]) + 1
            if len(to) == len(own) and to[-1] == len(ids):
                self.add(own, ids, np.diff(to, prepend=0))
            else:  # some part has ids that end no word, or none at all
                self.add_any(own)

    def numbers(self, parts: pa.Array, add) -> np.ndarray:
        """The number of each of the distinct ``parts``; those not known yet are encoded by ``add``."""
        parts = parts.to_numpy(zero_copy_only=False)
        at = np.fromiter((self.known.get(x, -1) for x in parts), np.int64, len(parts))
        if (new := np.flatnonzero(at < 0)).size:
            n = len(self.start)
            add(parts[new].tolist())
            at[new] = np.arange(n, n + new.size)
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and where each text begins (one more at the end)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words, n = coded.dictionary, len(coded.dictionary)
        stem = pc.utf8_rtrim(words, MARKS)
        plain = np.asarray(pc.and_(pc.equal(pc.utf8_trim(stem, LETTERS), ""), pc.less_equal(pc.binary_length(stem), MEMO_WORD)))
        is_plain, rest = pa.array(plain), np.flatnonzero(~plain)
        lower = pc.utf8_lower(stem.filter(is_plain)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(is_plain), LETTERS).dictionary_encode()
        own = np.zeros((n, 2), np.int64)
        own[plain, 0] = self.numbers(lower.dictionary, self.add_letters)[np.asarray(lower.indices)]
        own[plain, 1] = self.numbers(marks.dictionary, self.add_any)[np.asarray(marks.indices)]
        own[rest, 0] = self.numbers(words.take(pa.array(rest)), self.add_any)
        # ids of the distinct words, the end last
        ids = np.append(gather(self.ids, self.start[own.ravel()], self.length[own.ravel()]), np.uint32(end_id))
        length = np.append(self.length[own].sum(axis=1), 1)
        start = np.cumsum(length) - length
        upto = np.cumsum(np.asarray(pc.list_value_length(split), dtype=np.int64))
        seq = np.insert(np.asarray(coded.indices), upto, n)
        took = length[seq]
        bounds = np.concatenate([[0], np.cumsum(took)[upto + np.arange(len(upto))]])
        out, at = np.empty(bounds[-1], "<u4"), 0
        for a in range(0, len(seq), GATHER):
            part = gather(ids, start[seq[a : a + GATHER]], took[a : a + GATHER])
            out[at : at + len(part)] = part
            at += len(part)
        if self.held > MEMO_BYTES:
            self.forget()
        return out, bounds


@functools.lru_cache(1)
def encoder(tokenizer_path: str) -> Encoder:
    return Encoder(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        import os

        from quaystone.llm.op1_best_fit_packing import encoder  # the worker's own, kept between its tasks

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer_path)
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                ids, bounds = enc.encode(part.column("text"), end_id)
                count = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                a = bounds[doc] + piece * capacity
                b = np.minimum(a + capacity, bounds[doc + 1])
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(b - a), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, bounds[-1]), pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


class SumIndex:
    """Sums of one, two and three available lengths, each with a combination that gives it.

    A sum holds the place its search has come to.  What is available only falls, so combinations passed by
    never come back and every sum is searched once over the whole plan.
    """

    def __init__(self, avail: np.ndarray):
        self.avail, self.pair_at, self.triple_at = avail, {}, {}

    def single(self, gap: int) -> list[int] | None:
        return [gap] if gap > 0 and self.avail[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        avail, x = self.avail, self.pair_at.get(gap, gap - 1)
        while 2 * x >= gap and not (avail[x] > (2 * x == gap) and avail[gap - x] > 0):
            x -= 1
        self.pair_at[gap] = x
        return [x, gap - x] if 2 * x >= gap > 1 else None

    def triple(self, gap: int) -> list[int] | None:
        x = self.triple_at.get(gap, gap - 2)
        while 3 * x >= gap:
            if self.avail[x] > 0 and (two := self.within(gap - x, x)):
                break
            x -= 1
        self.triple_at[gap] = x
        return [x, *two] if 3 * x >= gap > 2 else None

    def within(self, gap: int, taken: int) -> list[int] | None:
        """A pair that leaves one piece of ``taken``; the search for pairs stays where it was."""
        avail = self.avail
        if (two := self.pair(gap)) and taken in two and avail[taken] <= two.count(taken):
            x = two[0] - 1
            while 2 * x >= gap and not all(avail[y] > (y == taken) + (2 * x == gap) for y in (x, gap - x)):
                x -= 1
            two = [x, gap - x] if 2 * x >= gap else None
        return two


def exact_complements(avail: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Consume combinations of up to four lengths that fill ``capacity`` exactly: [(lengths, times)].

    ``avail[n]`` is how many pieces of length n are left; it is reduced in place.
    """
    found, index = [], SumIndex(avail)
    for longest in range(capacity, 0, -1):
        gap = capacity - longest
        while avail[longest] > 0:
            avail[longest] -= 1  # the sums are of what is left beside it
            rest = [] if gap == 0 else index.single(gap) or index.pair(gap) or index.triple(gap)
            avail[longest] += 1
            if rest is None:
                break
            lengths = [longest, *rest]
            n = min(int(avail[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                avail[x] -= n
            found.append((lengths, n))
    return found


def best_fit(avail: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, in bulk: groups of equal sequences are kept by their gap."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, lengths: list[int], n: int) -> None:
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((lengths, n))

    for length in range(capacity, 0, -1):
        left = int(avail[length])
        avail[length] = 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                fits = capacity // length
                if left >= fits:
                    put(capacity - fits * length, [length] * fits, left // fits)
                if left % fits:
                    put(capacity - left % fits * length, [length] * (left % fits), 1)
                break
            gap = gaps[at]
            lengths, n = open_[gap].pop()
            k = min(n, left)
            if n > k:
                open_[gap].append((lengths, n - k))
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            put(gap - length, [*lengths, length], k)
            left -= k
    return [x for g in open_.values() for x in g]


def plan_sequences(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Rank ranges by length: ranks from ``rank`` on (up to the next row's) of ``length`` go to sequences from ``sequence`` on at ``offset``."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        avail[n] = c
    groups = exact_complements(avail, capacity) + best_fit(avail, capacity)
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) plus sequence_id and offset (long)."""
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(plan_sequences(by_length, capacity))  # bounded by capacity, not by the corpus
    # at most capacity rows: in how many blocks the pieces of a length are ranked
    parts = spark.createDataFrame([(n, -(-c // block_rows)) for n, c in by_length.items()], "length long, _parts long")
    named = pieces.join(F.broadcast(parts), "length").withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), "_parts"))
    counts = named.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_block")
    starts = counts.select("length", "_block", (F.sum("_n").over(ahead) - F.col("_n")).alias("_from"))

    own = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = named.withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["length", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_from")).select(*pieces.columns, "_rank")
    kept = pieces.columns

    def place(batches):
        p = plan.value
        keys = p["length"] << 44 | p["rank"]
        for b in batches:
            n, r = np.asarray(b.column("length")), np.asarray(b.column("_rank"))
            at = np.searchsorted(keys, n << 44 | r, side="right") - 1
            cols = [*(b.column(c) for c in kept), pa.array(p["sequence"][at] + r - p["rank"][at]), pa.array(p["offset"][at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    pieces = stored(token_pieces(docs, tokenizer_path, capacity=capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity=capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
