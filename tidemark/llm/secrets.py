"""Secret scans: three fixed patterns, and a token-efficiency test that finds random strings.

A vocabulary of byte pairs learned from ordinary text spells words with few tokens and random
strings with many. A run of key characters whose characters per token fall below a limit is a
secret of kind ``random``, unless it is a digest of a known length, a UUID or a number. Runs of
letters, with a short number at most, may be names and have a limit of their own, below the ratio
of words in any language seen; a random string of letters falls below it too. Where a span of the
fixed patterns covers part of a run, what is left on either side is tested alone.

Defined results: null and empty texts have no spans; texts are scanned whole, and in one pass over
runs and spans; the tokens of a long run are counted by stretches of ``STRETCH`` characters; repeated
rows are scanned alike; spans of equal start are ordered by kind as listed; bytes that are no UTF-8
count as U+FFFD; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from tidemark.llm.batches import map_batches, same_columns, strings, texts

KINDS = ("assign", "access", "hex", "random")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: A run of at least so many characters is tested, and is random below so many characters per token;
#: the second limit is that of runs shaped like names.
MIN_RUN = 16
MIN_CHARS_PER_TOKEN = 2.2
MIN_CHARS_PER_NAME_TOKEN = 1.85
STRETCH = 256
MIN_VALUE = 8

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ACCESS = 16
# Hexadecimal lengths of CRC-64, MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {16, 32, 40, 56, 64, 96, 128}

RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
IDENTIFIER = re.compile(
    r"[0-9+/_=-]+"  # numbers, dates, rulers
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
)
NAME = re.compile(r"[A-Za-z]+([-_/=+]+[A-Za-z]+)*[-_/=+]*[0-9]{0,4}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()
    if any(n in lower for n in ASSIGN_NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """True for digests of a known length and for identifiers."""
    return bool(IDENTIFIER.fullmatch(run) or len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run))


SEPARATORS = "+/_=-"


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint ranges that sorted spans cover."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def left_over(start: int, end: int, covered: list[tuple[int, int]], first: int) -> list[tuple[int, int]]:
    """What of a range lies outside the covered ones, of which ``first`` is the first that ends after its start."""
    out = []
    while first < len(covered) and covered[first][0] < end:
        if start < covered[first][0]:
            out.append((start, covered[first][0]))
        start = max(start, covered[first][1])
        first += 1
    return [*out, (start, end)] if start < end else out


class Scanner:
    """Scans texts with one vocabulary: a map from byte strings to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, least: float = MIN_CHARS_PER_TOKEN, least_name: float = MIN_CHARS_PER_NAME_TOKEN):
        import tiktoken

        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.least, self.least_name = least, least_name

    def chars_per_token(self, run: str) -> float:
        count = sum(len(self.encoding.encode_ordinary(run[i : i + STRETCH])) for i in range(0, len(run), STRETCH))
        return len(run) / max(1, count)

    def random(self, run: str) -> bool:
        if len(run) < MIN_RUN or known(run):
            return False
        return self.chars_per_token(run) < (self.least_name if NAME.fullmatch(run) else self.least)

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans."""
        base = base_spans(text)
        covered = merged(base)
        more, first = [], 0
        for m in RUN.finditer(text):
            while first < len(covered) and covered[first][1] <= m.start():
                first += 1
            for start, end in left_over(m.start(), m.end(), covered, first):
                end = start + len(text[start:end].rstrip(SEPARATORS)) if end < m.end() else end
                start = end - len(text[start:end].lstrip(SEPARATORS)) if start > m.start() else start
                if self.random(text[start:end]):
                    more.append((start, 3, end))
        return base, sorted(base + more)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans) -> str:
    """The text with each span, or union of overlapping ones, replaced by a mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], "[secret]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def load(name: str = TOKENIZER) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of a vocabulary file, read on the driver."""
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def scanner_of(sent):
    """A task's scanner of a broadcast vocabulary."""
    return Scanner(*sent.value)


def secret_scan(documents: DataFrame, vocabulary) -> DataFrame:
    """``documents`` (doc_id, text) → counts, digest of the base spans and all spans."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: 2 MB whatever the corpus

    def make():
        scanner = scanner_of(sent)

        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
            for text in texts(batch):
                base, every = scanner.spans(text)
                for kind, name in enumerate(("n_assign", "n_access", "n_hex", "n_random")):
                    out[name].append(sum(k == kind for _, k, _ in every))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
            return {"doc_id": batch.column("doc_id"), **out}

        return work

    return map_batches(
        documents.select("doc_id", "text"),
        make,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string",
    )


def redacted(documents: DataFrame, vocabulary) -> DataFrame:
    """``documents`` with the secrets of each text replaced; texts without any stay as they are."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)
    names = documents.columns

    def make():
        scanner = scanner_of(sent)

        def work(batch):
            columns = {n: batch.column(n) for n in names}
            columns["text"] = [t and redact(t, scanner.spans(t)[1]) for t in strings(batch.column("text"))]
            return columns

        return work

    return map_batches(documents, make, same_columns(documents))


def query(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
