"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and the digits and signs that stand for letters, drops
invisible characters, and takes ``l`` and ``i`` as one letter (``1`` stands for either). The
lexicon is learned from labelled rows: word starts and whole words whose document frequencies
differ between toxic and clean rows, each weighted by its log odds; word pairs in which a lexicon
word is seen in clean rows only become exception phrases, whose matches don't count.

Defined results: null and empty texts score 0; a text of any length is scanned whole; repeated
rows are scored alike; of the texts of a repeated doc_id the least is learned from, with the larger of
its labels; without toxic training rows the lexicon is empty and every score 0; bytes that are no
UTF-8 count as U+FFFD; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read
from the documents; ``kept`` keeps all columns of its input. Texts are learned from whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import held_out, map_batches, same_columns, texts

#: Labelled rows of each class that the lexicon is learned from, at most; the rows of least hash are taken.
SAMPLE_ROWS = 6000
#: Min-hash marks of a toxic training row, and how many of them make it a near copy of an earlier one:
#: rows that merely share a passage agree in fewer.
MARKS, COPY_MARKS = 16, 10
THRESHOLD = 0.3

# Characters that look like, or stand for, Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, "l": "i", **dict.fromkeys(INVISIBLE)})
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|(?<![^\s])[@$](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """One spelling for the many of a word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_TABLE)


@dataclass
class Lexicon:
    """terms: folded word start → weight; a term ending in ``$`` is a whole word. exceptions: folded word pairs."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)


def min_marks(words: list[str]) -> list[int]:
    """Min-hashes of a text's word triples: two texts agree in the share that their triples have in common."""
    grams = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
    rng = np.random.default_rng(11)
    factors, shifts = rng.integers(1, 1 << 31, MARKS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 31, MARKS, np.uint64)
    return [int(((grams * f + s) & np.uint64(0xFFFFFFFF)).min()) for f, s in zip(factors, shifts, strict=True)]


def term_counts(clean: Counter, toxic: Counter, least: int = 4) -> tuple[tuple[Counter, Counter], int]:
    """Counts, over clean and over toxic rows, of the word starts of three letters or more and the whole words
    (marked ``$``) that ``least`` toxic rows have, from counts of words; and how many starts and words toxic
    rows have at all. A start that few rows have isn't made any longer, so that only what can become a term
    is held."""
    candidates, before = len(toxic), ""
    for word in sorted(toxic):
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        candidates += max(0, len(word) - max(2, same))
        before = word
    starts: tuple[Counter, Counter] = (Counter(), Counter({w + "$": n for w, n in toxic.items() if n >= least}))
    alive, end = [(w, n) for w, n in toxic.items() if len(w) > 2], 3
    while alive:
        counts = Counter()
        for word, n in alive:
            counts[word[:end]] += n
        kept = {t: n for t, n in counts.items() if n >= least}
        starts[1].update(kept)
        alive = [(w, n) for w, n in alive if len(w) > end and w[:end] in kept]
        end += 1
    for word, n in clean.items():
        if word + "$" in starts[1]:
            starts[0][word + "$"] += n
        for end in range(3, len(word) + 1):
            if word[:end] not in starts[1]:
                break
            starts[0][word[:end]] += n
    return starts, candidates


def learn(rows, min_odds: float = 20.0) -> Lexicon:
    """``rows``: (text, toxic). Terms are word starts of three letters or more, and whole words, that
    toxic rows have far oftener than chance among so many candidates gives; of those that occur in
    the same toxic rows the longest stands for all."""
    seen = (Counter(), Counter())
    total = [0, 0]
    known: dict[tuple[int, int], list[int]] = {}
    for row, (text, toxic) in enumerate(rows):
        words = _WORD.findall(fold(text))
        if toxic and words:  # near copies of one toxic text would make lexicon words of all it says
            marks = list(enumerate(min_marks(words)))
            agree = Counter(r for m in marks for r in known.get(m, ()))
            if max(agree.values(), default=0) >= COPY_MARKS:
                continue
            for m in marks:
                known.setdefault(m, []).append(row)
        total[toxic] += 1
        seen[toxic].update(set(words))
    if not total[1]:
        return Lexicon()
    starts, candidates = term_counts(*seen)

    def odds(term: str) -> float:
        return ((starts[1][term] + 0.5) / (total[1] + 1)) / ((starts[0][term] + 0.5) / (total[0] + 1))

    def surprise(term: str) -> float:
        """Log likelihood ratio of the term's counts against one rate for both classes."""
        both = starts[0][term] + starts[1][term]
        rate = min(1.0, both / sum(total))
        return sum(n * math.log(n / (rate * size)) for n, size in zip((starts[0][term], starts[1][term]), total, strict=True) if n)

    least = math.log(1000.0 * max(1, candidates))
    good = {t for t in starts[1] if odds(t) >= min_odds and surprise(t) >= least}
    terms: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        shorter = next((term[:n] for n in range(len(term) - 1, 2, -1) if term[:n] in terms), None)
        if shorter is None:
            terms[term] = math.log(odds(term))
        elif starts[1][term] >= 0.9 * starts[1][shorter]:  # the same rows: the longer one says more
            del terms[shorter]
            terms[term] = math.log(odds(term))
    return Lexicon(terms)


def with_exceptions(lexicon: Lexicon, rows, min_docs: int = 3) -> Lexicon:
    """Adds word pairs that hold a term and occur in clean rows only."""
    matcher = Matcher(lexicon)
    counts = (Counter(), Counter())
    for text, toxic in rows:
        found = set()
        folded = fold(text)
        for start, end, _ in matcher.matches(folded):
            before, word, after = matcher.context(folded, start, end)
            found |= {(before, word), (word, after)}
        counts[toxic].update(found)
    exceptions = {p for p, n in counts[0].items() if n >= min_docs and not counts[1][p] and all(p)}
    return Lexicon(lexicon.terms, lexicon.exceptions | exceptions)


class Matcher:
    """An Aho-Corasick automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term.rstrip("$"), (len(term.rstrip("$")), term.endswith("$"), weight))
        if lexicon.terms:
            self.automaton.make_automaton()

    def matches(self, folded: str):
        """(start, end, weight) of terms at a word's start."""
        if not self.lexicon.terms:
            return
        for last, (size, whole, weight) in self.automaton.iter(folded):
            start = last + 1 - size
            if (start == 0 or not folded[start - 1].isalnum()) and not (whole and last + 1 < len(folded) and folded[last + 1].isalnum()):
                yield start, last + 1, weight

    @staticmethod
    def context(folded: str, start: int, end: int) -> tuple[str, str, str]:
        """The word of a match with the words before and after it."""
        while end < len(folded) and folded[end].isalnum():
            end += 1
        before = _WORD.findall(folded[max(0, start - 60) : start])
        after = _WORD.search(folded, end, end + 60)
        return before[-1] if before else "", folded[start:end], after[0] if after else ""

    def score(self, text: str) -> tuple[float, int]:
        """Score from 0 to 1 and the number of matches; length enters by its logarithm, as one
        insult among many words is still an insult."""
        folded = fold(text)
        total, n = 0.0, 0
        for start, end, weight in self.matches(folded):
            if self.lexicon.exceptions:
                before, word, after = self.context(folded, start, end)
                if (before, word) in self.lexicon.exceptions or (word, after) in self.lexicon.exceptions:
                    continue
            total, n = total + weight, n + 1
        strength = total / (2.0 + math.log10(1.0 + len(folded) / 1000.0))
        return strength / (1.0 + strength), n


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``sample_rows`` labelled rows of each class outside the held-out fold, with their whole texts."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    picked = None
    for toxic in (0, 1):
        part = marks.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    # Two integers for each of at most 2 * sample_rows rows: small at any size of the corpus. One text of
    # each leaves the executors, however often a doc_id is repeated.
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    eighths = found.select("doc_id", F.make_valid_utf8("text"), "toxic").coalesce(8).toLocalIterator()  # one at a time
    return [(text, toxic) for _, text, toxic in sorted((doc_id, text or "", int(toxic)) for doc_id, text, toxic in eighths)]


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    rows = training_rows(documents, labels, sample_rows)
    return with_exceptions(learn(rows), rows)


def toxicity(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` (doc_id, text) → doc_id, held_out, score, predicted, n_matches."""

    def make():
        matcher = Matcher(lexicon)

        def work(batch):
            scored = [matcher.score(t) for t in texts(batch)]
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": [s for s, _ in scored],
                "predicted": [int(s >= threshold) for s, _ in scored],
                "n_matches": [n for _, n in scored],
            }

        return work

    return map_batches(
        documents.select("doc_id", "text", held_out().alias("held_out")),
        make,
        "doc_id bigint, held_out boolean, score double, predicted int, n_matches bigint",
    )


def kept(documents: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all of their columns, that score below the threshold."""
    names = documents.columns

    def make():
        matcher = Matcher(lexicon)

        def work(batch):
            mask = pa.array([matcher.score(t)[0] < threshold for t in texts(batch)], pa.bool_())
            return {n: batch.column(n).filter(mask) for n in names}

        return work

    return map_batches(documents, make, same_columns(documents))


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
