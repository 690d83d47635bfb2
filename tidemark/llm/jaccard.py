"""N-gram Jaccard join: a blocked sparse product of documents by n-grams with size bounds.

The incidence matrix (documents by distinct word 5-grams) is dealt out in column blocks: a task
holds whole columns, so it sees how many documents each n-gram has, and drops the columns of one
document, which add to no overlap. What is left goes back by rows. A document whose shared n-grams
are fewer than 0.8 of its size can reach no partner and is done; on real text few documents remain.

Equal sets become one class. Of each class's n-grams, ordered from rare to frequent, only the first
``size - ceil(0.8 * size) + 1`` can hold the first common one of a linked pair; pairs that meet
there, whose sizes and positions leave the bound in reach, have their overlaps accumulated block by
block and are discarded as soon as the bound is out of reach. Meeting pairs are first tried as
stars around the most typical document of each n-gram, which links a group of near copies in as
many tests as it has members; after that only pairs between different components are tried, all of
them, so no link between components is lost.

Columns, documents and pairs are carried as Arrow batches of packed numbers. N-grams are 64-bit
hashes cut to 32 bits and the bits of the block number, so that hashes meeting by chance can only
raise an overlap. Pairs so near the bound that such chance could decide are compared word by word
(``verified``); links of the others are right but for a chance below 1e-20 a pair.

A column with many postings is dealt out in salted parts, in each of which a part of its postings
meets all others of the column.

Defined results: null and empty texts, and texts without words, have no n-gram and are linked with
nothing (their component is their own id); a text of fewer than five words is one n-gram; texts are
read whole; repeated rows are links of equal sets; a null doc_id keeps its row, with the component
of its set; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read;
``representatives`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch_rows, release_memory, texts
from tidemark.llm.graph import components
from tidemark.session import discard, input_bytes, pow2_at_least, stage, tasks_for

WORDS = 5
PERCENT = 80
#: N-grams that a task packs into one set of column blocks (and eight for each block, where there are
#: many), and words whose hashes it keeps.
PACK = 1_000_000
PACK_PER_BLOCK = 8
#: Bytes of text of a column block and of a bucket of documents, and most of either: up to 100 TB a
#: block stays below 100 MB of text; beyond, blocks grow with the input.
BLOCK_BYTES, BUCKET_BYTES, MOST_BLOCKS = 125_000, 500_000, 1 << 20
#: Bits of an n-gram's hash besides those of its block.
CELL_BITS = 32
#: Postings of a column that one task pairs with all others of the column.
SALT_ROWS = 512
CACHE_WORDS = 200_000
#: Star rounds at most before all pairs between components are tried, and how many such pairs per
#: posting make another star round worth while.
STAR_ROUNDS = 2
PAIRS_PER_POSTING = 16
#: Column blocks over which overlaps are accumulated.
STEPS = 4
#: Row numbers that are broadcast at most where repeats are dropped.
BROADCAST_ROWS = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """Word → 64-bit hash, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def ngrams(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    mix, out = np.uint64(0x9E3779B97F4A7C15), np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * mix + values[i : len(words) - width + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def word_ngrams(text: str | None, n: int = WORDS) -> set[bytes]:
    """Distinct n-grams of a text as words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    width = min(n, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


_BLOCK = "block int, keys binary, counts binary, cells binary, meta_keys binary, meta_docs binary, meta_sizes binary, meta_sigs binary"
_BUCKET = "bucket int, keys binary, counts binary, cells binary, often binary, meta_keys binary, meta_docs binary, meta_sizes binary, meta_sigs binary"
_META = ("meta_keys", "meta_docs", "meta_sizes", "meta_sigs")
NO_DOC = np.iinfo(np.int64).min


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _table(columns: dict, ints: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == ints else pa.binary()) for k, v in columns.items()})


def _pack_columns(bits: int, cell_bits: int = CELL_BITS):
    """Documents (key, doc_id, text) → rows of column blocks."""
    blocks = 1 << bits
    pack = max(PACK, PACK_PER_BLOCK * blocks)

    def packed(keys, docs, sizes, sigs, grams) -> pa.RecordBatch:
        keys, docs, sizes = np.array(keys, np.int64), np.array(docs, np.int64), np.array(sizes, np.int32)
        sigs = np.frombuffer(b"".join(sigs), "V16")
        cells = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(keys), dtype=np.int64), sizes)
        block = (cells >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(block, kind="stable")
        block, of = block[order], of[order]
        cells = ((cells[order] << np.uint64(bits)) >> np.uint64(64 - cell_bits)).astype(np.uint32)
        ends = np.searchsorted(block, np.arange(blocks + 1))
        home = (keys % blocks).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        home_ends = np.searchsorted(home[by_home], np.arange(blocks + 1))
        out = {k: [] for k in ("block", "keys", "counts", "cells", *_META)}
        for b in range(blocks):
            lo, hi, m = ends[b], ends[b + 1], by_home[home_ends[b] : home_ends[b + 1]]
            if lo == hi and not len(m):
                continue
            starts, counts = _runs(of[lo:hi])
            out["block"].append(b)
            out["keys"].append(keys[of[lo:hi][starts]].tobytes())
            out["counts"].append(counts.astype(np.uint32).tobytes())
            out["cells"].append(cells[lo:hi].tobytes())
            for name, values in zip(_META, (keys, docs, sizes, sigs), strict=True):
                out[name].append(values[m].tobytes())
        return _table(out, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), ([], [], [], [], []), 0
        for batch in batches:
            for key, doc, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                found = ngrams(text, hashes)
                for part, value in zip(held, (key, NO_DOC if doc is None else doc, len(found), signature(found), found), strict=True):
                    part.append(value)
                n += len(found) + 1
                if n >= pack:
                    yield packed(*held)
                    held, n = ([], [], [], [], []), 0
        if n:
            yield packed(*held)
        if len(hashes) > 10_000:
            del hashes, held
            release_memory()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str):
    """Rows of a partition sorted by ``key``, as one dict of lists for each value."""
    value, held = None, {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, k in enumerate(columns[key]):
            if held and k != value:
                yield value, held
                held = {}
            value = k
            for n, c in columns.items():
                if n != key:
                    held.setdefault(n, []).append(c[i])
    if held:
        yield value, held


def _shared_cells(buckets: int):
    """Column blocks → per bucket of documents, the cells of columns that two documents or more have."""
    pack = max(PACK // 2, PACK_PER_BLOCK * buckets)

    def packed(held) -> pa.RecordBatch:
        keys, cells, often = (np.concatenate(held[k]) for k in ("keys", "cells", "often"))
        metas = {k: np.concatenate(held[k]) for k in _META}
        bucket = _bucket(keys, buckets)
        order = np.lexsort((keys, bucket))
        keys, cells, often, bucket = keys[order], cells[order], often[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        home = _bucket(metas["meta_keys"], buckets)
        by_home = np.argsort(home, kind="stable")
        home_ends = np.searchsorted(home[by_home], np.arange(buckets + 1))
        out = {k: [] for k in ("bucket", "keys", "counts", "cells", "often", *_META)}
        for b in range(buckets):
            lo, hi, m = ends[b], ends[b + 1], by_home[home_ends[b] : home_ends[b + 1]]
            if lo == hi and not len(m):
                continue
            starts, counts = _runs(keys[lo:hi])
            out["bucket"].append(b)
            out["keys"].append(keys[lo:hi][starts].tobytes())
            out["counts"].append(counts.astype(np.uint32).tobytes())
            out["cells"].append(cells[lo:hi].tobytes())
            out["often"].append(often[lo:hi].tobytes())
            for name in _META:
                out[name].append(metas[name][m].tobytes())
        return _table(out, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for block, rows in _groups(batches, "block"):
            keys = np.frombuffer(b"".join(rows["keys"]), np.int64)
            counts = np.frombuffer(b"".join(rows["counts"]), np.uint32)
            cells = np.frombuffer(b"".join(rows["cells"]), np.uint32)
            both = np.sort((cells.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(keys), dtype=np.uint64), counts))
            cells = both >> np.uint64(32)
            starts, sizes = _runs(cells)
            shared = np.repeat(sizes, sizes) > 1
            found = {
                "keys": keys[(both[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64)],
                "cells": (cells[shared] | (np.uint64(block) << np.uint64(32))).astype(np.int64),
                "often": np.minimum(np.repeat(sizes, sizes)[shared], 0xFFFFFFFF).astype(np.uint32),
            } | {k: np.frombuffer(b"".join(rows[k]), d) for k, d in zip(_META, (np.int64, np.int64, np.int32, "V16"), strict=True)}
            for k, v in found.items():
                held.setdefault(k, []).append(v)
            n += len(found["keys"]) + len(found["meta_keys"])
            if n >= pack:
                yield packed(held)
                held, n = {}, 0
        if n:
            yield packed(held)
        if n > 100_000:
            del held
            release_memory()

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


_DOCS = "key bigint, doc_id bigint, n_shingles bigint, sig binary, typical double, cells binary, often binary"


def _rows_back(percent: int):
    """Buckets → one row per document; ``cells`` (from rare to frequent) only where a partner is in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            part = lambda k, d: np.frombuffer(b"".join(rows[k]), d)
            meta, docs, sizes, sigs = (part(k, d) for k, d in zip(_META, (np.int64, np.int64, np.int32, "V16"), strict=True))
            order = np.argsort(meta)
            meta, docs, sizes, sigs = meta[order], docs[order], sizes[order].astype(np.int64), sigs[order]
            at = np.searchsorted(meta, np.repeat(part("keys", np.int64), part("counts", np.uint32)))
            cells, often = part("cells", np.int64), part("often", np.uint32)
            shared = np.bincount(at, minlength=len(meta))
            live = (100 * shared >= percent * sizes) & (sizes > 0)
            keep = live[at]
            at, cells, often = at[keep], cells[keep], often[keep]
            order = np.lexsort((cells, often, at))
            at, cells, often = at[order], cells[order], often[order]
            weight = np.bincount(at, np.log(often), minlength=len(meta)) / np.maximum(1, sizes)
            ends = np.searchsorted(at, np.arange(len(meta) + 1))
            often = np.minimum(often, 0xFFFF).astype(np.uint16)
            blobs = lambda v: pa.array([v[ends[i] : ends[i + 1]].tobytes() if live[i] else None for i in range(len(meta))], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "key": meta,
                    "doc_id": pa.array(docs, mask=docs == NO_DOC),
                    "n_shingles": sizes,
                    "sig": pa.array([s.tobytes() for s in sigs], pa.binary()),
                    "typical": weight,
                    "cells": blobs(cells),
                    "often": blobs(often),
                }
            )

    return run


def _postings(percent: int):
    """Classes → (cell, key, n, pos, typical) of the cells in which a linked pair can first meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [np.empty(0, np.int64)] for k in ("cell", "key", "n", "pos")} | {"typical": [np.empty(0)]}
            names = ("key", "n_shingles", "typical", "cells", "often", "n_copies")
            for key, n, typical, cells, often, copies in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                cells, often = np.frombuffer(cells, np.int64), np.frombuffer(often, np.uint16)
                if copies < 0xFFFF:  # what only the copies of a class share meets no other class
                    cells = cells[often != copies]
                if 100 * len(cells) < percent * n:
                    continue
                alone = n - len(cells)
                first = cells[: max(0, n - -(-percent * n // 100) + 1 - alone)]
                out["cell"].append(first)
                out["pos"].append(alone + np.arange(len(first)))
                for k, v in (("key", key), ("n", n), ("typical", typical)):
                    out[k].append(np.full(len(first), v))
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return run


def excess(cells_a: list[np.ndarray], cells_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int, steps: int = STEPS) -> np.ndarray:
    """By how much the overlap of each pair exceeds the bound, negative where it doesn't reach it: a
    product of two sparse blocks, taken over blocks of columns; a pair leaves when even all its cells
    to come wouldn't do."""
    n = len(cells_a)
    need = -(-percent * (sizes_a + sizes_b) // (100 + percent))  # overlap of a linked pair at least
    lens_a, lens_b = (np.array([len(c) for c in cells], np.int64) for cells in (cells_a, cells_b))
    row_a, row_b = np.repeat(np.arange(n), lens_a), np.repeat(np.arange(n), lens_b)
    a, b = (np.concatenate(c) if n else np.empty(0, np.int64) for c in (cells_a, cells_b))
    total, left_a, left_b, live = np.zeros(n, np.int64), lens_a.copy(), lens_b.copy(), np.ones(n, bool)
    column_a, column_b = (a & 0xFFFF) % steps, (b & 0xFFFF) % steps
    for step in range(steps):
        live &= total + np.minimum(left_a, left_b) >= need
        in_a, in_b = (column_a == step) & live[row_a], (column_b == step) & live[row_b]
        # A cell that both documents of a pair have comes twice in the sorted list of (pair, cell).
        rows = np.concatenate([row_a[in_a], row_b[in_b]])
        cells = np.concatenate([a[in_a], b[in_b]])
        order = np.lexsort((cells, rows))
        rows, cells = rows[order], cells[order]
        twice = (rows[1:] == rows[:-1]) & (cells[1:] == cells[:-1])
        total += np.bincount(rows[1:][twice], minlength=n)
        left_a -= np.bincount(row_a[in_a], minlength=n)
        left_b -= np.bincount(row_b[in_b], minlength=n)
    return np.where(live, total - need, -1)


def overlaps(cells_a, cells_b, sizes_a, sizes_b, percent: int, steps: int = STEPS) -> np.ndarray:
    """True for the pairs whose overlap reaches the bound."""
    return excess(cells_a, cells_b, sizes_a, sizes_b, percent, steps) >= 0


def by_chance(sizes_a: np.ndarray, sizes_b: np.ndarray, bits: int) -> np.ndarray:
    """Cells of ``bits`` bits that two documents share by chance, at most but for a chance below 1e-20."""
    return 4 + np.ceil(8 * (sizes_a + sizes_b).astype(float) ** 2 / 2 / 2.0**bits).astype(np.int64)


def _tested(percent: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(c, np.int64) for c in batch.column(k).to_pylist()] for k in ("cells_a", "cells_b"))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            over = excess(a, b, n_a, n_b, percent)
            keep = pa.array(over >= 0)
            close = pa.array(over < by_chance(n_a, n_b, bits))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "close": close.filter(keep)})

    return run


def _matching_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, sig, text), those whose text has the class's set."""
    hashes = WordHashes()
    for batch in batches:
        keep = [signature(ngrams(t, hashes)) == s for s, t in zip(batch.column("sig").to_pylist(), texts(batch), strict=True)]
        yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("key", "text")})


def _compared(percent: int):
    """Pairs with both texts → those that reach the bound, counted over the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                a, b = word_ngrams(x), word_ngrams(y)
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")})

    return run


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """The ``pairs`` (a, b) of ``classes`` (key, doc_id, sig) that reach the bound word by word. A class's
    text is that of a document with its doc_id and its set."""
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
    wanted = stage(classes.select("key", "doc_id", "sig").join(keys, "key"), "unsure", tasks)
    found = documents.select(F.col("doc_id").alias("of"), "text").join(wanted, F.col("of").eqNullSafe(F.col("doc_id")))
    found = found.select("key", "sig", "text").mapInArrow(_matching_texts, "key bigint, text string")
    found = stage(found.groupBy("key").agg(F.min("text").alias("text")), "unsure-texts", tasks)
    side = lambda x: found.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"))
    good = stage(pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInArrow(_compared(percent), "a bigint, b bigint"), "verified", tasks)
    discard(wanted, found)
    return good


def _linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame, percent: int, bits: int, tasks: int) -> DataFrame:
    """The pairs (a, b) of class keys that reach the bound."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
    with batch_rows(pairs.sparkSession, 200):
        tested = pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_tested(percent, bits), "a bigint, b bigint, close boolean")
        links = stage(tested, "links", tasks)
        unsure = links.filter("close")
        if unsure.isEmpty():
            return links.select("a", "b")
        return links.filter("NOT close").select("a", "b").unionAll(verified(unsure, classes, documents, percent, tasks))


def _in_reach(percent: int):
    """SQL condition on two postings of a cell: sizes and positions leave the bound in reach."""
    return (
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND "
        f"{100 + percent} * least(n_a - pos_a, n_b - pos_b) >= {percent} * (n_a + n_b)"
    )


def _dealt(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` by ``key``, sorted by it within partitions: the session's number of partitions, which AQE fits to the
    data, or one for every 512 MB of input where that is more."""
    parts = size >> 29
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, key).sortWithinPartitions(key)
    return df.repartition(key).sortWithinPartitions(key)


def near_links(classes: DataFrame, documents: DataFrame, percent: int, bits: int, tasks: int) -> DataFrame:
    """Classes (key, doc_id, sig, n_shingles, typical, cells, often, n_copies) of ``documents`` → (node, label)
    of those linked with another."""
    spark = classes.sparkSession
    every = classes.mapInArrow(_postings(percent), "cell bigint, key bigint, n bigint, pos bigint, typical double")
    # Counts are stored before they are joined, here and below: a join of two plain tables is one whose hot keys AQE splits.
    often = stage(every.groupBy("cell").agg(F.count("*").alias("k")).filter("k > 1").select("cell"), "shared", tasks)
    postings = stage(every.join(often, "cell"), "postings", tasks)  # a cell of one class meets nothing
    discard(often)
    found, marked, past = None, postings.withColumn("label", F.col("key")), [postings]
    for turn in range(STAR_ROUNDS + 1):
        by_label = marked.groupBy("cell", "label").agg(F.count("*").alias("k"))
        open_cells = stage(
            by_label.groupBy("cell").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("k")).filter("pairs > 0"),
            "open",
            tasks,
        )
        past.append(open_cells)
        pairs, rows = open_cells.agg(F.sum("pairs"), F.sum("k")).first()
        if not pairs:
            break
        last = turn > 0 and pairs <= PAIRS_PER_POSTING * max(rows, 100_000) or turn == STAR_ROUNDS
        side = lambda x, df: df.select(*(c for c in ("cell", "salt") if c in df.columns), *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "pos", "label")))
        if last:
            salts = open_cells.select("cell", F.expr(f"int(ceil(k / {SALT_ROWS}))").alias("salts"))
            left = stage(marked.join(salts, "cell"), "open-postings", tasks)
            past.append(left)
            one, all_ = left.withColumn("salt", F.expr("int(pmod(xxhash64(key), salts))")), left.withColumn("salt", F.expr("explode(sequence(0, salts - 1))"))
            meeting = side("a", one).join(side("b", all_), ["cell", "salt"]).filter("label_a < label_b")
        else:
            best = F.max(F.struct(F.col("typical") if turn == 0 else F.xxhash64("key", F.lit(turn)), "key", "n", "pos", "label")).alias("m")
            hubs = marked.groupBy("cell").agg(best).join(open_cells.select("cell"), "cell", "left_semi")
            hubs = stage(hubs.select("cell", *(F.col(f"m.{c}").alias(f"{c}_a") for c in ("key", "n", "pos", "label"))), "hubs", tasks)
            past.append(hubs)
            meeting = side("b", marked).join(hubs, "cell").filter("label_a <> label_b")
        tried = meeting.filter(_in_reach(percent)).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
        links = _linked(tried, classes, documents, percent, bits, tasks)
        edges = links if found is None else links.unionAll(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
        found = components(edges, tasks)
        if last:
            break
        marked = stage(
            postings.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "marked", tasks
        )
        past.append(marked)
    discard(*past)
    if found is None:
        return spark.createDataFrame([], "node bigint, label bigint")
    return found


def text_bytes(documents: DataFrame) -> int:
    """Bytes of the texts: Catalyst's estimate, which follows the files, or the sum where it knows none."""
    estimate = input_bytes(documents)
    return estimate if estimate < 1 << 60 else documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _named(keyed: DataFrame, size: int, percent: int, cell_bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """``keyed`` (key, doc_id, text) of about ``size`` bytes → rows (key, doc_id, n_shingles) that nothing
    links, and those of classes with their component_id and its first key."""
    spark = keyed.sparkSession
    blocks, buckets = pow2_at_least(size / BLOCK_BYTES, 4096, MOST_BLOCKS), pow2_at_least(size / BUCKET_BYTES, 1024, MOST_BLOCKS)
    bits, tasks = blocks.bit_length() - 1, tasks_for(size)
    with batch_rows(spark, 500):
        columns = keyed.select("key", "doc_id", "text").mapInArrow(_pack_columns(bits, cell_bits), _BLOCK)
        cells = _dealt(columns, "block", size).mapInArrow(_shared_cells(buckets), _BUCKET)
        rows = stage(_dealt(cells, "bucket", size).mapInArrow(_rows_back(percent), _DOCS), "incidence", tasks_for(size, 8 << 20))
        live = rows.filter("cells IS NOT NULL")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
        classes = stage(live.groupBy("sig").agg(F.min("key").alias("key"), first, F.count("*").alias("n_copies")), "classes", tasks)
        about = classes.select("key", "n_copies", F.col("first.doc_id").alias("doc_id"))
        heads = stage(live.select("key", "sig", "n_shingles", "typical", "cells", "often").join(about, "key"), "heads", tasks_for(size, 8 << 20))
        linked = near_links(heads, keyed, percent, bits + cell_bits, tasks)
    named = classes.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = stage(named.select("sig", "first", "label"), "named", tasks)
    discard(heads, classes)
    firsts = stage(named.groupBy("label").agg(F.min("first").alias("least")), "firsts", tasks)
    named = named.join(firsts, "label").select("sig", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first_key"))
    alone = rows.filter("cells IS NULL").select("key", "doc_id", "n_shingles")
    return alone, live.select("key", "doc_id", "n_shingles", "sig").join(named, "sig").drop("sig")


def near_duplicates(documents: DataFrame, percent: int = PERCENT, cell_bits: int = CELL_BITS) -> DataFrame:
    """``documents`` (doc_id, text) → doc_id, n_shingles, component_id, one row per input row."""
    alone, grouped = _named(documents.select("doc_id", "text", F.monotonically_increasing_id().alias("key")), text_bytes(documents), percent, cell_bits)
    columns = ("doc_id", "n_shingles", "component_id")
    return alone.withColumn("component_id", F.col("doc_id")).select(*columns).unionAll(grouped.select(*columns))


def representatives(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, all of their columns, without those that repeat another: of each
    component the row of least doc_id stays. Rows that nothing links all stay. Row numbers depend on how
    a scan is split, so the rows are stored with theirs, and both uses read the stored ones."""
    row, taken = "__row", {n.lower() for n in documents.columns}
    while row in taken:
        row += "_"
    held, size = stage(documents.withColumn(row, F.monotonically_increasing_id()), "numbered"), text_bytes(documents)
    _, grouped = _named(held.select(F.col(row).alias("key"), "doc_id", "text"), size, percent)
    gone = stage(grouped.filter("key <> first_key").select(F.col("key").alias(row)), "repeats", tasks_for(size))
    if gone.count() <= BROADCAST_ROWS:  # 8 MB of row numbers; beyond, both sides are shuffled
        gone = F.broadcast(gone)
    return held.join(gone, row, "left_anti").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SET = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SET} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least({WORDS}, len(w)) AS k, unnest(range(1, len(w) - least({WORDS}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""
