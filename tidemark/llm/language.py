"""Language ID: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes, white space and digits as one symbol each, in windows of
fixed length; both directions start anew at a window's ends. Each position gets probabilities of
the languages from the two hidden states, and a document the mean over all of its positions. It is
trained on the driver in numpy by backpropagation through time, on a bounded sample of documents
whose language may be learned from.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts are read
whole, every window of them, in training too; repeated rows are judged alike; of the texts of a
repeated doc_id the least of each language is learned from; every language of the training fold can
be predicted, ties go to the one that sorts first; without training rows every text is ``und``; bytes
that are no UTF-8 count as U+FFFD; an empty table gives an empty result. Only
``doc_id``, ``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import held_out, map_batches, texts
from tidemark.session import discard, stage

#: Bytes of a window, hidden units of a direction and entries of a byte's vector.
WINDOW, HIDDEN, WIDTH = 64, 12, 8
#: Training documents of each language, at most (those of least hash), and of all; with more languages
#: than the second number allows for, each has its share, one document at least.
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 40_000
STEPS, BATCH, RATE, SEED = 500, 256, 0.02, 7
#: Windows that are judged in one step.
CHUNK = 2048

# One symbol for white space, one for digits, the others for themselves.
_SYMBOLS = bytes(32 if b in b" \t\n\r\x0b\x0c" else 48 if 48 <= b <= 57 else b for b in range(256))


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]


def initial(languages: list[str], seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    mat = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
    weights = {"E": rng.standard_normal((256, WIDTH)) * 0.3, "V": mat(2 * HIDDEN, len(languages)), "c": np.zeros(len(languages))}
    for d in "fb":
        weights |= {f"W{d}": mat(WIDTH, 3 * HIDDEN), f"U{d}": mat(HIDDEN, 2 * HIDDEN), f"R{d}": mat(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN)}
    return Network(languages, weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def loss_and_gradients(weights: dict[str, np.ndarray], windows: np.ndarray, real: np.ndarray, labels: np.ndarray):
    """Mean cross entropy over the real positions of (n, time) windows, and its gradients.

    ``h' = z h + (1 - z) tanh(x W_n + (r h) R)`` with gates z and r; padding keeps the state."""
    n, time = windows.shape
    k = HIDDEN
    x = weights["E"][windows]
    saved, states = {}, {}
    for d, order in (("f", range(time)), ("b", range(time - 1, -1, -1))):
        pre = x @ weights[f"W{d}"] + weights[f"b{d}"]
        h, kept, out = np.zeros((n, k)), [None] * time, np.zeros((n, time, k))
        for t in order:
            gates = _sigmoid(pre[:, t, : 2 * k] + h @ weights[f"U{d}"])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(pre[:, t, 2 * k :] + (r * h) @ weights[f"R{d}"])
            m = real[:, t, None]
            kept[t] = (h, z, r, new)
            h = np.where(m, z * h + (1 - z) * new, h)
            out[:, t] = h
        saved[d], states[d] = kept, out
    both = np.concatenate([states["f"], states["b"]], 2)
    logits = both @ weights["V"] + weights["c"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    total = real.sum()
    at = np.arange(n)[:, None], np.arange(time)[None], labels[:, None]
    loss = -(np.log(p[at] + 1e-12) * real).sum() / total
    delta = p
    delta[at] -= 1
    delta *= real[:, :, None] / total
    grads = {"V": np.einsum("ntk,ntl->kl", both, delta), "c": delta.sum((0, 1))}
    dboth, dx = delta @ weights["V"].T, np.zeros_like(x)
    for d, order, part in (("f", range(time - 1, -1, -1), dboth[:, :, :k]), ("b", range(time), dboth[:, :, k:])):
        dpre, carry = np.zeros((n, time, 3 * k)), np.zeros((n, k))
        du, dr_mat = np.zeros((k, 2 * k)), np.zeros((k, k))
        for t in order:
            h, z, r, new = saved[d][t]
            m = real[:, t, None]
            g = carry + part[:, t]
            gm = g * m
            dn = gm * (1 - z) * (1 - new * new)
            back = dn @ weights[f"R{d}"].T
            dz, dr = gm * (h - new) * z * (1 - z), back * h * r * (1 - r)
            gate = np.concatenate([dz, dr], 1)
            dpre[:, t] = np.concatenate([gate, dn], 1)
            du += h.T @ gate
            dr_mat += (r * h).T @ dn
            carry = np.where(m, gm * z + back * r + gate @ weights[f"U{d}"].T, g)
        grads |= {f"W{d}": np.einsum("ntw,ntk->wk", x, dpre), f"b{d}": dpre.sum((0, 1)), f"U{d}": du, f"R{d}": dr_mat}
        dx += dpre @ weights[f"W{d}"].T
    grads["E"] = np.zeros_like(weights["E"])
    np.add.at(grads["E"], windows.ravel(), dx.reshape(-1, dx.shape[2]))
    return loss, grads


def windowed(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text's symbols, and which of their positions are real."""
    symbols = np.frombuffer(raw.translate(_SYMBOLS), np.uint8)
    n = -(-len(symbols) // window)
    padded = np.zeros(n * window, np.uint8)
    padded[: len(symbols)] = symbols
    return padded.reshape(n, window), (np.arange(n * window) < len(symbols)).reshape(n, window)


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> Network:
    """``rows``: (text, language). Adam over random windows, each language equally often; half of the
    windows end early, as those of short texts do."""
    languages = sorted({lang for _, lang in rows})
    net, rng = initial(languages, seed), np.random.default_rng(seed)
    parts: dict[str, list] = {lang: [] for lang in languages}
    for text, lang in rows:
        if text:
            parts[lang].append(windowed(text.encode("utf-8", "replace")))
    pools = [tuple(np.concatenate(c) for c in zip(*p, strict=True)) if p else None for p in parts.values()]
    kinds = [i for i, p in enumerate(pools) if p is not None]
    if len(kinds) < 2:
        return net
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.choice(kinds, BATCH)
        picks = [rng.integers(len(pools[k][0])) for k in labels]
        windows = np.stack([pools[k][0][i] for k, i in zip(labels, picks, strict=True)])
        real = np.stack([pools[k][1][i] for k, i in zip(labels, picks, strict=True)])
        ends = np.where(rng.random(BATCH) < 0.5, rng.integers(8, WINDOW + 1, BATCH), WINDOW)
        real &= np.arange(WINDOW) < ends[:, None]
        _, grads = loss_and_gradients(net.weights, windows, real, labels)
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """The trained network for judging: gate inputs are a table by byte, gates are halved tanh."""

    def __init__(self, net: Network):
        self.languages, w = net.languages, net.weights
        k = HIDDEN
        scale = np.r_[np.full(2 * k, 0.5), np.ones(k)]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.tables, self.gates, self.news = [], [], []
        for d in "fb":
            self.tables.append(((w["E"] @ w[f"W{d}"] + w[f"b{d}"]) * scale).T.astype(np.float32).copy())
            self.gates.append((w[f"U{d}"] * 0.5).T.astype(np.float32).copy())
            self.news.append((w[f"R{d}"] * 0.5).T.astype(np.float32).copy())  # r h = (1 + tanh) h / 2
        self.out = w["V"].T.astype(np.float32).copy()
        self.bias = w["c"].astype(np.float32)[:, None]

    def states(self, d: int, windows: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (time, hidden, n) of one direction over windows (time, n); the state stays zero
        where ``real`` says that nothing has been read yet."""
        k, (time, n) = HIDDEN, windows.shape
        h, out = np.zeros((k, n), np.float32), np.empty((time, k, n), np.float32)
        table, u, r = self.tables[d], self.gates[d], self.news[d]
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            x = table.take(windows[t], axis=1)
            gates = x[: 2 * k]
            gates += u @ h
            np.tanh(gates, out=gates)
            z, reset = gates[:k], gates[k:]
            reset += 1
            reset *= h
            new = x[2 * k :]
            new += r @ reset
            np.tanh(new, out=new)
            # z' = (1 + z) / 2: h' = new + z' (h - new)
            z += 1
            z *= 0.5
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
            if real is not None:
                h *= real[t]
        return out

    def probabilities(self, windows: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Per window (n, time), the sum of the language probabilities of its real positions."""
        seen = np.ascontiguousarray(windows.T)
        begun = None if real.all() else np.ascontiguousarray(real.T.astype(np.float32))
        both = np.concatenate([self.states(0, seen), self.states(1, seen, begun)], 1)
        logits = self.out @ both
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (real.T / logits.sum(1))[:, None]
        return logits.sum(0).T

    def judge(self, found: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        parts, owners, texts_ = [], [], []
        result: list[tuple[str, float]] = [("und", 0.0)] * len(found)
        for i, text in enumerate(found):
            if text and any(map(str.isalpha, text)) and len(self.languages) > 0:
                w, m = windowed(text.encode("utf-8", "replace"))
                parts.append(w)
                owners.append(np.full(len(w), i))
                texts_.append(m)
        if not parts:
            return result
        windows, real, owner = np.concatenate(parts), np.concatenate(texts_), np.concatenate(owners)
        order = np.argsort(~real[:, -1], kind="stable")  # the last, shorter windows of the texts together
        windows, real, owner = windows[order], real[order], owner[order]
        sums = np.zeros((len(found), len(self.languages)))
        for a in range(0, len(windows), CHUNK):
            np.add.at(sums, owner[a : a + CHUNK], self.probabilities(windows[a : a + CHUNK], real[a : a + CHUNK]))
        for i in np.unique(owner):
            p = sums[i] / sums[i].sum()
            result[i] = self.languages[int(p.argmax())], float(min(1.0, p.max()))
        return result


def training_rows(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``sample_rows`` (text, language) of each language outside the held-out fold, whole texts."""
    marked = documents.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").filter(~held_out())
    counts = stage(marked.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")), "languages", 8)
    rows = max(1, min(sample_rows, SAMPLE_TOTAL // max(1, counts.count())))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # About half more than needed by the counts, one text of each doc_id; of these the first are taken before any leaves.
    wanted = marked.join(counts, "lang").filter(place < F.least(F.lit(1.0), (1.5 * rows + 30) / F.col("n")) * (1 << 32))
    single = wanted.groupBy("lang", place.alias("place"), "doc_id").agg(F.min("text").alias("text"))
    ranked = single.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("k") <= rows)
    taken = ranked.select("lang", "place", "doc_id", F.make_valid_utf8("text")).collect()
    discard(counts)
    return [(text, lang) for lang, _, _, text in sorted(map(tuple, taken))]


def language_id(documents: DataFrame, net: Network) -> DataFrame:
    """``documents`` (doc_id, text) → doc_id, held_out, lang_pred, score."""

    def make():
        reader = Reader(net)

        def work(batch):
            judged = reader.judge(texts(batch))
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": [lang for lang, _ in judged],
                "score": [s for _, s in judged],
            }

        return work

    return map_batches(documents.select("doc_id", "text", held_out().alias("held_out")), make, "doc_id bigint, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(documents, train(training_rows(documents)))
