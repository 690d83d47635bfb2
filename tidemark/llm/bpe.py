"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged across: the text
is surely cut there. So a pre-token falls into fragments that are encoded independently, each
fragment once per cache, and the ids are concatenated. The rest follows the tokenizer file: special
tokens are split off the raw text first, then come NFC, the replacement of white space, lower case,
the split pattern and the byte alphabet; decoding joins the tokens with a space as the file names
no decoder.

Defined results: null is the empty text, which has no tokens and decodes to the empty text; texts
are encoded whole, whatever their length; repeated rows encode alike; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from tidemark.llm.batches import map_batches, texts

TOKENIZER = "word_bpe_49k.json"
#: Pre-tokens that a task keeps, in two halves of which the older goes when the newer is full.
CACHE_WORDS = 200_000
NEVER = 1 << 60

# White space of Unicode.
_SPACES = "\t-\r\x20\x85\xa0  -     　"
# Texts of these characters only need no Unicode classes: their letters are all Latin, their digits ASCII.
_PLAIN = re.compile(r"[\x00-\x7f\xa0-\xb1\xb4-\xb8\xbb\xbf-ɀ‐-‧‰-›€]*")
_PLAIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɀ"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable ones for themselves, the rest
    in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file of this kind."""

    def __init__(self, spec: dict, cache_words: int = CACHE_WORDS):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.names = {t: str(i) for t, i in self.vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in special.items()}
        self.special = special
        self.special_at = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        self.byte_chars = byte_alphabet()
        self.joined = set()
        for token in self.vocab:
            bare = token.removesuffix(self.suffix) if self.suffix else token
            self.joined.update(zip(bare, bare[1:], strict=False))
        short = "|".join(map(re.escape, ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")))
        self.plain_words = re.compile(rf"{short}|[{_PLAIN_LETTERS}]+|[0-9]|[^{_SPACES}{_PLAIN_LETTERS}0-9]+")
        self.library = None
        self.spec = spec
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.cache_words = cache_words // 2

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without special tokens, normalised."""
        if not text.isascii():
            lower = unicodedata.normalize("NFC", text).lower()
            return self.plain_words.findall(lower) if _PLAIN.fullmatch(lower) else self.unusual_words(text)
        return self.plain_words.findall(text.lower())

    def unusual_words(self, text: str) -> list[str]:
        """As ``words``, by the library's Unicode tables."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            split = next(p for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            normalizer = Tokenizer.from_str(json.dumps(self.spec)).normalizer
            self.library = normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        return [w for w, _ in self.library[1].pre_tokenize_str(self.library[0].normalize_str(text))]

    def fragments(self, word: str) -> list[list[str]]:
        """Symbols of a pre-token, cut at pairs that no token holds; the last symbol ends the word."""
        chars = list(word) if word.isascii() and word.isprintable() else [self.byte_chars[b] for b in word.encode()]
        joined = self.joined
        cuts = [i for i, p in enumerate(zip(chars, chars[1:], strict=False), 1) if p not in joined]
        chars[-1] += self.suffix
        if not cuts:
            return [chars]
        return [chars[a:b] for a, b in zip([0, *cuts], [*cuts, len(chars)], strict=True)]

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merges of least rank first, the leftmost of equals."""
        if len(symbols) > 100:
            return self.merge_long(symbols)
        rank = self.ranks.get
        found = [rank(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
        while found and (least := min(found)) != NEVER:
            i = found.index(least)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), NEVER)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), NEVER)
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same through a heap of pairs: n log n for fragments of any length."""
        n, rank = len(symbols), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j], after[i] = a + b, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank((symbols[k], symbols[after[k]]))) is not None:
                    heappush(heap, (r, k, symbols[k], symbols[after[k]]))
        return [s for s in symbols if s]

    def encode_word(self, word: str) -> tuple[str, str]:
        """Ids and tokens of a pre-token, joined by spaces."""
        names = self.names
        tokens = [t for f in self.fragments(word) for t in self.merge(f) if t in names]
        return " ".join([names[t] for t in tokens]), " ".join(tokens)

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Ids and tokens of a text, joined by spaces."""
        ids, tokens = [], []
        parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else (text,)
        for part in parts:
            if part in self.special:
                ids.append(str(self.special[part]))
                tokens.append(part)
                continue
            for word in self.words(part):
                got = self.cache.get(word)
                if got is None:
                    got = self.older.get(word) or self.encode_word(word)
                    if len(word) <= 64:
                        if len(self.cache) >= self.cache_words:
                            self.cache, self.older = {}, self.cache
                        self.cache[word] = got
                if got[0]:
                    ids.append(got[0])
                    tokens.append(got[1])
        return " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def load(name: str = TOKENIZER) -> dict:
    """The tokenizer file as read on the driver; it is sent along with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return json.load(f)


def bpe(documents: DataFrame, spec: dict) -> DataFrame:
    """``documents`` (doc_id, text) → doc_id, n_tokens and digests of the ids and of the decoded text."""
    sent = documents.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: 2 MB whatever the corpus

    def make():
        codec = Codec(sent.value)

        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts(batch):
                ids, tokens = codec.encode_joined(text)
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(tokens.encode()).hexdigest())
            return out

        return work

    return map_batches(documents.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, spec: dict) -> DataFrame:
    """As ``bpe``, with the ids themselves and the document's language and source."""
    sent = documents.sparkSession.sparkContext.broadcast(spec)
    carried = [n for n in ("lang", "source") if n in documents.columns]

    def make():
        codec = Codec(sent.value)

        def work(batch):
            joined = [codec.encode_joined(t) for t in texts(batch)]
            ids = [[int(i) for i in a.split()] for a, _ in joined]
            return {
                "doc_id": batch.column("doc_id"),
                **{n: batch.column(n) for n in carried},
                "n_tokens": [len(i) for i in ids],
                "ids": ids,
                "ids_sha256": [hashlib.sha256(a.encode()).hexdigest() for a, _ in joined],
                "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for _, b in joined],
            }

        return work

    schema = "doc_id bigint, " + "".join(f"{n} string, " for n in carried) + "n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_batches(documents.select("doc_id", "text", *carried), make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
