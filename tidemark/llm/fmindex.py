"""Benchmark decontamination: an FM-index of each training shard, searched backwards.

A shard is a batch of documents, up to ``SHARD_WORDS`` words or one document, as a sequence of word
numbers. Only words of the benchmark have a number, so the sequence falls into runs; runs shorter
than the shortest phrase can hold no occurrence and are left out of the index, which is the
Burrows-Wheeler transform of the rest in a wavelet matrix, for ranks and symbols, with every eighth
suffix position of a run kept as a sample. Each shard has one index, in which the phrases of all
blocks are searched, one word from their ends at a time; rows of a phrase's range are walked back to
a sample for their positions, and hit words merge into removal spans.

The benchmark is split into words, and its phrases are numbered and packed into blocks of bounded
size, by tasks; the driver passes one block at a time on as a broadcast, of which a task holds one at a
time, beside the vocabulary (the distinct words of the benchmark). Documents are never shuffled.

Defined results: null and empty texts, and texts without words, have no words and no hits; texts are
read whole; repeated rows are judged alike; items without words have no window, items of less than
ten words are one; repeated items count once, items of null id hit but aren't counted; an empty
benchmark leaves every document clean; bytes that are no UTF-8 count as U+FFFD; an empty table gives an
empty result. Of the documents only ``doc_id`` and ``text`` are read, of the benchmark ``item_id`` and
``text``; ``cleaned`` keeps all columns of the documents.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import map_batches, same_columns, strings, texts

WINDOW = 10
#: Words of the items of one block of phrases.
BLOCK_WORDS = 500_000
SAMPLE_EVERY = 8
#: Tasks at most that pack phrases, from each of which the driver fetches apart.
PACKING_TASKS = 256
#: Words of the documents of one index, beyond which another begins.
SHARD_WORDS = 1_000_000

# Lower case for A-Z, a space for every ASCII character that is no letter or digit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Vocabulary:
    """Numbers from 1 of the words of a benchmark, and the least length of its phrases."""

    numbers: dict[bytes, int]
    shortest: int


class Phrases:
    """Windows of a block of items: distinct windows by length, and items of each window. Words are
    numbered by ``numbers``, or else as they come."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, numbers: dict[bytes, int] | None = None):
        self.numbers: dict[bytes, int] = {} if numbers is None else numbers
        known: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if words else 0):
                k = known.setdefault(tuple(words[i : i + width]), len(known))
                if k == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[k].add(str(item))
        self.items = sorted(set().union(*owners)) if owners else []
        place = {s: i for i, s in enumerate(self.items)}
        self.owner_ends = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([place[s] for o in owners for s in sorted(o)], np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(w) for w in known}:
            same = [(k, w) for w, k in known.items() if len(w) == width]
            self.by_length[width] = np.array([k for k, _ in same]), np.array([w for _, w in same], np.int64).reshape(len(same), width)
        self.shortest = min(self.by_length, default=1)

    def renumbered(self, numbers: dict[bytes, int]) -> "Phrases":
        """The same phrases in the numbers of another vocabulary, which has all of their words."""
        new = np.array([0, *(numbers[w] for w in self.numbers)], np.int64)
        out = object.__new__(Phrases)
        out.__dict__ |= self.__dict__ | {"numbers": numbers, "by_length": {n: (ids, new[table]) for n, (ids, table) in self.by_length.items()}}
        return out


class WaveletMatrix:
    """Ranks of symbols in a sequence, one level for each bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(sigma).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(self.levels[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.starts = self._walk(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            r = ones[at]
            at = np.where((symbols >> (self.bits - 1 - level)) & 1, zeros + r, at - r)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbols, at) - self.starts[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            at = np.where(bit, zeros + before, at - before)
            symbols = symbols * 2 + bit
        return symbols, at - self.starts[symbols]


class FMIndex:
    """Index of a sequence of positive symbols in runs, each closed by a 0; runs are kept apart."""

    def __init__(self, sequence: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        n = len(sequence)
        closing = sequence == 0
        # Closing zeros differ from each other, the earlier being the less: no suffix outruns its run.
        rank = np.where(closing, np.cumsum(closing) - 1, sequence + int(closing.sum()))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            key = rank * np.int64(n + sigma + 2) + ahead
            order = np.argsort(key)
            fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step > n:
                break
        self.size = n
        self.wavelet = WaveletMatrix(np.where(order > 0, sequence[order - 1], 0), sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma + 1))])
        first = np.concatenate([[True], closing[:-1]])
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        sampled = (np.arange(n) - starts) % every == 0  # the first of a run is one: no walk leaves its run
        self.sampled = sampled[order]
        self.sample_rank = np.cumsum(self.sampled, dtype=np.int32) - 1
        self.samples = order[self.sampled].astype(np.int32 if n < 1 << 31 else np.int64)  # of the suffix positions only these stay

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of equal length, by backward search; empty where one doesn't occur."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            lo[live], hi[live] = self.less[c] + self.wavelet.rank(c, lo[live]), self.less[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        empty = lo >= hi
        lo[empty] = hi[empty] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, each walked back to a sampled suffix."""
        rows, found, walked = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = self.sampled[rows[live]]
            done = live[at]
            found[done] = self.samples[self.sample_rank[rows[done]]] + walked[done]
            live = live[~at]
            c, rank = self.wavelet.access(rows[live])
            rows[live] = self.less[c] + rank
            walked[live] += 1
        return found


class ShardIndex:
    """Index of a sequence of word numbers, where 0 is no word of the benchmark."""

    def __init__(self, numbers: np.ndarray, shortest: int):
        known = np.concatenate([[0], (numbers > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = ends - begins >= shortest
        begins, ends = begins[keep], ends[keep]
        self.empty = not len(begins)
        if self.empty:
            return
        sizes = ends - begins + 1  # with the closing 0
        offsets = np.cumsum(sizes) - sizes
        self.places = np.arange(int(sizes.sum())) - np.repeat(offsets - begins, sizes)
        closing = np.zeros(len(self.places), bool)
        closing[offsets + sizes - 1] = True
        sequence = np.where(closing, 0, numbers[np.minimum(self.places, len(numbers) - 1)])
        self.words, own = np.unique(sequence, return_inverse=True)  # the first is 0
        self.index = FMIndex(own.astype(np.int64), len(self.words) - 1)

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places, windows, length) of every occurrence, by length."""
        for length, (ids, table) in () if self.empty else phrases.by_length.items():
            own = np.minimum(np.searchsorted(self.words, table), len(self.words) - 1)
            here = (self.words[own] == table).all(1)  # a window with a word that the shard lacks occurs nowhere
            ids, own = ids[here], own[here]
            lo, hi = self.index.search(own)
            counts = hi - lo
            which = np.repeat(np.arange(len(ids)), counts)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]
            yield self.places[self.index.locate(rows)], ids[which], length


def scan(shard: list[list[bytes]], blocks, vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Documents as lists of words → begins of the documents in the shard, hit flags of its words, items of each document.

    ``blocks`` yields ``Phrases`` in the numbers of ``vocabulary``, of which one is held at a time; without
    a vocabulary the blocks have numbers of their own, and one is made of them."""
    if vocabulary is None:
        blocks, numbers = list(blocks), {}
        for phrases in blocks:
            for w in phrases.numbers:
                numbers.setdefault(w, len(numbers) + 1)
        vocabulary = Vocabulary(numbers, min((p.shortest for p in blocks), default=1))
        blocks = [p.renumbered(numbers) for p in blocks]
    lengths = np.array([len(w) for w in shard], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # one place between documents
    total = int((lengths + 1).sum())
    get, numbers = vocabulary.numbers.get, np.zeros(total, np.int64)
    for words, at in zip(shard, begins, strict=True):
        if words:
            numbers[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    index = ShardIndex(numbers, vocabulary.shortest)
    cover = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in shard]
    for phrases in () if index.empty else blocks:
        for place, window, length in index.occurrences(phrases):
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            doc = np.searchsorted(begins, place, side="right") - 1
            for d, w in np.unique(np.stack([doc, window], 1), axis=0) if len(place) else ():
                items[d].update(phrases.items[i] for i in phrases.owners[phrases.owner_ends[w] : phrases.owner_ends[w + 1]])
    return begins, np.cumsum(cover)[:total] > 0, [sorted(s) for s in items]


def scan_all(documents: list[list[bytes]], benchmark: "Benchmark", shard_words: int = SHARD_WORDS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Hit flags of the words and the items of each document, one index for every ``shard_words`` words."""
    at = 0
    while at < len(documents):
        end, n = at, 0
        while end < len(documents) and (end == at or n + len(documents[end]) <= shard_words):
            n += len(documents[end])
            end += 1
        shard = documents[at:end]
        begins, hit, items = scan(shard, benchmark.blocks(), benchmark.vocabulary.value)
        for a, words, found in zip(begins, shard, items, strict=True):
            yield hit[a : a + len(words)], found
        at = end


def removal_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges from the first to the last word of each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [
        (len(raw[: words[a][0]].decode("utf-8", "surrogatepass")), len(raw[: words[b - 1][1]].decode("utf-8", "surrogatepass")))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
    ]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [b" ".join(words_of(t)).decode("utf-8", "replace") for t in texts(b)]
        yield pa.RecordBatch.from_pydict({"item": b.column("item"), "line": lines, "n": [x.count(" ") + 1 if x else 0 for x in lines]})


def _packed(sent):
    """Items sorted by block → pickled phrases of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        closed = lambda: pa.RecordBatch.from_pydict({"phrases": [pickle.dumps(vars(Phrases(held, numbers=sent.value.numbers)) | {"numbers": {}})]})
        for b in batches:
            for k, item, line in zip(*(b.column(c).to_pylist() for c in ("block", "item", "line")), strict=True):
                if held and k != block:
                    yield closed()
                    held.clear()
                block = k
                held.append((item, line))
        if held:
            yield closed()

    return run


class Benchmark:
    """Broadcasts of the vocabulary of a benchmark and of its phrases, in blocks of about ``block_words``
    words (or one item). Executors keep broadcasts on disk where memory is short."""

    def __init__(self, benchmark: DataFrame, block_words: int = BLOCK_WORDS):
        context = benchmark.sparkSession.sparkContext
        items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
        lines = items.mapInArrow(_worded, "item string, line string, n bigint").filter("n > 0").distinct()
        total, least = lines.agg(F.sum("n"), F.min("n")).first()
        words = lines.select(F.explode(F.split("line", " ")).alias("word")).distinct().collect()
        numbers = {w: i for i, w in enumerate(sorted(r.word.encode() for r in words), 1)}
        self.vocabulary = context.broadcast(Vocabulary(numbers, min(WINDOW, least or 1)))
        self.sent = []
        if total:
            blocks = math.ceil(total / block_words)
            block = F.pmod(F.xxhash64("line"), F.lit(blocks)).alias("block")
            dealt = lines.select(block, "item", "line").repartition("block").coalesce(min(blocks, PACKING_TASKS)).sortWithinPartitions("block")
            for row in dealt.mapInArrow(_packed(self.vocabulary), "phrases binary").toLocalIterator():
                phrases = object.__new__(Phrases)
                phrases.__dict__ |= pickle.loads(bytes(row.phrases))
                self.sent.append(context.broadcast(phrases))

    def blocks(self) -> Iterator[Phrases]:
        """The blocks, of which, if there are several, a task lets go of one before the next."""
        for b in self.sent:
            yield b.value
            if len(self.sent) > 1:
                b.__dict__.pop("_value", None)


_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) against ``benchmark`` (item_id, text) → counts, items and removal spans."""
    phrases = Benchmark(benchmark)

    def make():
        def work(batch):
            found = texts(batch)
            shard = [words_of(t) for t in found]
            hits, items = zip(*scan_all(shard, phrases), strict=True)
            n_hit = [int(h.sum()) for h in hits]
            return {
                "doc_id": batch.column("doc_id"),
                "n_words": [len(w) for w in shard],
                "n_hit": n_hit,
                "n_items": [len(i) for i in items],
                "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
                "contaminated": [n > 0 for n in n_hit],
                "spans": [",".join(f"{a}:{b}" for a, b in removal_spans(t, h)) if n else "" for t, h, n in zip(found, hits, n_hit, strict=True)],
            }

        return work

    return map_batches(documents.select("doc_id", "text"), make, f"doc_id bigint, {_RESULT}")


def cleaned(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with the removal spans cut out of their texts; a document of which no word is
    left goes. Clean documents stay as they are."""
    phrases, names = Benchmark(benchmark), documents.columns

    def make():
        def work(batch):
            found = strings(batch.column("text"))
            shard = [words_of(t or "") for t in found]
            kept, keep = [], []
            for t, w, (h, _) in zip(found, shard, scan_all(shard, phrases), strict=True):
                keep.append(not len(w) or not h.all())
                kept.append(cut(t, removal_spans(t, h)) if h.any() else t)
            mask = pa.array(keep, pa.bool_())
            return {n: (pa.array(kept, pa.string()) if n == "text" else batch.column(n)).filter(mask) for n in names}

        return work

    return map_batches(documents, make, same_columns(documents))


def query(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    return decontaminate(documents, benchmark).drop("spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), x AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
), h AS (
  SELECT r, i, k, item_id FROM x JOIN p USING (k, s)
), n AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
