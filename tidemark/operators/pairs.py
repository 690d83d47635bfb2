"""Joins and pairwise measures: event-locked means, masks, lagged correlations, similarity, kernels.

Event windows are exploded to equi-joins on (series, segment, t), never range joins. Measures
between series pair compact features, of which there are few per series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import input_bytes, stage, tasks_for

KEY = ("series_id", "segment_id")


def event_locked(gamma: DataFrame, events: DataFrame, half: int) -> DataFrame:
    """Mean probability at each offset from ``events`` (series_id, segment_id, t), within its segment."""
    near = events.select(*KEY, F.col("t").alias("at"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("offset"))
    near = near.withColumn("t", F.col("at") + F.col("offset"))
    return near.join(gamma, [*KEY, "t"]).groupBy("offset", "state").agg(F.avg("p").alias("p"), F.count("*").alias("n"))


def masked_transitions(path: DataFrame, mask: DataFrame) -> DataFrame:
    """Transition shares of the steps whose first sample is in ``mask`` (series_id, segment_id, t)."""
    after = F.lead("state").over(Window.partitionBy(*KEY).orderBy("t"))
    steps = path.select(*KEY, "t", F.col("state").alias("i"), after.alias("j")).filter("j IS NOT NULL")
    counts = steps.join(mask, [*KEY, "t"], "left_semi").groupBy("i", "j").agg(F.count("*").alias("n"))
    return counts.select("i", "j", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("p"))


def static_connectivity(long: DataFrame) -> DataFrame:
    """Correlation of each channel pair i < j over all samples of a series."""
    wide, channels = by_sample(long)
    pairs = [(a, b) for a in channels for b in channels if a < b]
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.corr(f"c{a}", f"c{b}").alias("r")) for a, b in pairs]
    return wide.groupBy("series_id").agg(F.array(*cells).alias("c")).select("series_id", F.inline("c")) if pairs else long.select("series_id", F.col("channel").alias("i"), F.col("channel").alias("j"), F.col("value").alias("r")).limit(0)


def by_sample(long: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per sample with a column ``c1``, ``c2`` … for each channel, and the channels, which are few."""
    channels = [r.channel for r in long.select("channel").distinct().orderBy("channel").collect()]
    dealt = long.repartition(*KEY)  # the one shuffle: samples and windows of a segment stay where they are
    return dealt.groupBy(*KEY, "t").agg(*(F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{c}") for c in channels)), channels


#: Series of a block on either side of a matrix over series; a task holds one block of each side.
BLOCK_SERIES = 256


def vectors(features: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """(series_id, v): one array per series, in the order of the given columns."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    return features.groupBy("series_id").agg(cells.alias("c")).select("series_id", F.col("c.v").alias("v"))


def block_pairs(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """Pairs (a, x, b, y) of series a <= b of (series_id, v). The output is the matrix asked for, so it
    grows with the square of the series; blocks of both sides meet, each pair in one task only. Without
    a number of blocks there is one for every ``BLOCK_SERIES`` series, eight at least."""
    blocks = blocks or max(8, -(-rows.count() // BLOCK_SERIES))
    block, every = F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select(F.col("series_id").alias("a"), F.col("v").alias("x"), block.alias("p"), F.explode(every).alias("q"))
    right = rows.select(F.col("series_id").alias("b"), F.col("v").alias("y"), block.alias("q"), F.explode(every).alias("p"))
    return left.join(right, ["p", "q"]).filter("a <= b").select("a", "x", "b", "y")


#: Series of a cell's sides that are measured at once, the blocks up to which a block has no more series than
#: these, and the most series and numbers of a block when there are more.
CELL_SERIES, BLOCKS, MOST_SERIES, MOST_NUMBERS = 512, 16, 4096, 1 << 20
#: Parts that either side is dealt into, a block each as long as there are no more blocks.
PARTS = 256


def block_cells(rows: DataFrame) -> DataFrame:
    """(p, q, x, y): blocks p <= q of (series_id, v) as arrays, each pair of series in one cell only. Vectors are
    shuffled once for either side; the tasks of the product read the parts that they need from there, so no copies
    for other blocks are written and nothing is sent to every machine."""
    rows = rows.select("series_id", "v").filter("series_id IS NOT NULL")
    held = stage(rows, "vectors", tasks_for(input_bytes(rows)))
    n, numbers = held.agg(F.count("*"), F.avg(F.size("v"))).first()
    most = min(MOST_SERIES, max(CELL_SERIES, int(MOST_NUMBERS / max(1.0, numbers or 0))))
    blocks = max(1, min(-(-n // CELL_SERIES), BLOCKS), -(-n // most))
    whole = held.groupBy(F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("series_id", "v")).alias("z"))
    dealt = whole.repartitionByRange(min(blocks, PARTS), "block")
    left, right = dealt.select(F.col("block").alias("p"), F.col("z").alias("x")), dealt.select(F.col("block").alias("q"), F.col("z").alias("y"))
    return left.hint("shuffle_replicate_nl").join(right, F.col("p") <= F.col("q")).select("p", "q", "x", "y")


def block_sides(batch: pa.RecordBatch, size: int, ready: Callable):
    """Pieces of each cell of a batch of ``block_cells``, of about ``size`` series on either side: whether it is a piece
    against itself, then series and ``ready`` vectors of both sides. Vectors of one length are rows of a matrix,
    others are in a list. A block against itself is one side twice: the two were gathered apart, so their series
    may come in different orders."""

    def pieces(z):
        v, names = z.field("v"), z.field("series_id").to_numpy()
        sizes = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(sizes), -1) if (sizes == sizes[0]).all() else np.split(flat, np.cumsum(sizes)[:-1])
        step = -(-len(names) // max(1, round(len(names) / size)))  # no slivers
        return [(names[at : at + step], ready(v[at : at + step])) for at in range(0, len(names), step)]

    for n in range(batch.num_rows):
        same = batch.column("p")[n].as_py() == batch.column("q")[n].as_py()
        left = pieces(batch.column("x")[n].values)
        right = left if same else pieces(batch.column("y")[n].values)
        for i, one in enumerate(left):
            for j, other in enumerate(right[i if same else 0 :]):
                yield same and not j, *one, *other


def measured_pairs(rows: DataFrame, measure: Callable, name: str, ready: Callable = lambda v: v) -> DataFrame:
    """(a, b, ``name``) for series a < b of (series_id, v), vectors of one length: ``measure`` takes what ``ready``
    makes of the vectors of n and m series as matrices and gives the n-by-m matrix of a symmetric measure."""

    def run(batches):
        for batch in batches:
            for same, left, x, right, y in block_sides(batch, CELL_SERIES, ready):
                found = measure(x, y)
                if same:
                    i, j = np.triu_indices(len(left), 1)
                    a, b, found = left[i], right[j], found[i, j]
                else:
                    a, b, found = np.repeat(left, len(right)), np.tile(right, len(left)), found.ravel()
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), name: found})

    return block_cells(rows).mapInArrow(run, f"a bigint, b bigint, {name} double")


_DOT = "aggregate(zip_with(x, y, (p, q) -> p * q), 0D, (t, u) -> t + u)"


def edge_similarity(edges: DataFrame) -> DataFrame:
    """Correlation between series a < b of their edge weights (series_id, i, j, r)."""
    mean = "(aggregate(v, 0D, (t, u) -> t + u) / size(v))"
    centred = vectors(edges, ["i", "j"], "r").select("series_id", F.expr(f"transform(v, u -> u - {mean})").alias("v"))
    length = F.expr("sqrt(aggregate(v, 0D, (t, u) -> t + u * u))")
    unit = centred.withColumn("l", length).select("series_id", F.expr("transform(v, u -> u / l)").alias("v"))
    return block_pairs(unit).filter("a < b").select("a", "b", F.expr(_DOT).alias("similarity"))


def lagged_correlation(long: DataFrame, max_lag: int) -> DataFrame:
    """Correlation per series of x_i(t - lag) with x_j(t), pooled over its segments: one window over samples,
    then one aggregate."""
    wide, channels = by_sample(long)
    w = Window.partitionBy(*KEY).orderBy("t")
    past = wide.select("*", *(F.lag(f"c{c}", k).over(w).alias(f"c{c}_{k}") for c in channels for k in range(1, max_lag + 1)))
    name = lambda c, k: f"c{c}_{k}" if k else f"c{c}"
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(k).alias("lag"), F.corr(name(a, k), f"c{b}").alias("r")) for a in channels for b in channels for k in range(max_lag + 1)]
    return past.groupBy("series_id").agg(F.array(*cells).alias("c")).select("series_id", F.inline("c"))


def flip(long: DataFrame, flips: DataFrame) -> DataFrame:
    """Changes the sign of the (series_id, channel) pairs in ``flips`` whose ``flip`` is 1."""
    joined = long.join(flips.select("series_id", "channel", "flip"), ["series_id", "channel"], "left")
    return joined.withColumn("value", F.col("value") * (1 - 2 * F.coalesce("flip", F.lit(0)))).drop("flip").select(*long.columns)


def apply_signs(edges: DataFrame, flips: DataFrame) -> DataFrame:
    """Edge weights (series_id, i, j, r) after the flips of both their channels."""
    sign = flips.select("series_id", F.col("channel").alias("c"), (1 - 2 * F.col("flip")).alias("s"))
    out = edges
    for end in ("i", "j"):
        out = out.join(sign.withColumnRenamed("c", end).withColumnRenamed("s", f"s_{end}"), ["series_id", end], "left")
    return out.select("series_id", "i", "j", (F.col("r") * F.coalesce("s_i", F.lit(1)) * F.coalesce("s_j", F.lit(1))).alias("r"))


def sign_score(edges: DataFrame) -> DataFrame:
    """Mean similarity over the pairs of series."""
    return edge_similarity(edges).agg(F.avg("similarity").alias("score"))


def state_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Summed minimum of the probabilities of state i of one time-course and state j of another."""
    other = second.select(*KEY, "t", F.col("state").alias("j"), F.col("p").alias("q"))
    return first.join(other, [*KEY, "t"]).groupBy(F.col("state").alias("i"), "j").agg(F.sum(F.least("p", "q")).alias("overlap"))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (shortest augmenting paths with
    potentials); rows must not outnumber columns. Infinite costs are avoided where possible."""
    cost = np.where(np.isinf(cost), 1e15, np.asarray(cost, float))
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            open_least = np.where(used[1:], np.inf, least[1:])
            j1 = int(open_least.argmin()) + 1
            delta = open_least[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def align_states(overlap: DataFrame, k: int) -> list[int]:
    """State j (1-based) for each state i of greatest total overlap; ``k`` squared numbers are fetched."""
    s = np.zeros((k, k))
    for i, j, value in overlap.select("i", "j", "overlap").collect():
        s[i - 1, j - 1] = value
    return [int(j) + 1 for j in assign(s.max() - s)]


def linear_kernel(features: DataFrame, normalise: bool = False) -> DataFrame:
    """Dot products between series a <= b of long features (series_id, feature, value)."""
    if normalise:
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("feature")))
        features = features.withColumn("value", F.col("value") / norm)
    return block_pairs(vectors(features, ["feature"], "value")).select("a", "b", F.expr(_DOT).alias("k"))


def distances(features: DataFrame) -> DataFrame:
    """Squared distances between series a < b."""
    squares = F.expr("aggregate(zip_with(x, y, (p, q) -> (p - q) * (p - q)), 0D, (t, u) -> t + u)")
    return block_pairs(vectors(features, ["feature"], "value")).filter("a < b").select("a", "b", squares.alias("d"))


#: Ranges that values are counted in on the way to a quantile, and values among which it is taken exactly.
RANGES, EXACT_VALUES = 1024, 100_000


def exact_median(rows: DataFrame, column: str) -> float | None:
    """Median without sorting all values in one task: ranges are counted, and the one in which the middle lies
    is split again, until few enough values are left."""
    rows = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    before, part = 0, rows
    first, last = (n - 1) // 2, n // 2  # places of the middle, from 0
    while n > EXACT_VALUES and low < high:
        place = F.least(F.floor((F.col("v") - low) / ((high - low) / RANGES)), F.lit(RANGES - 1)).alias("k")
        at, chosen = before, []
        for r in sorted(part.groupBy(place).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
            if at <= last and at + r.n > first:
                chosen.append((at, r.n, r.lo, r.hi))
            at += r.n
        if len(chosen) == 2:  # the middle lies between two ranges
            return (chosen[0][3] + chosen[1][2]) / 2
        before, n, low, high = chosen[0]
        part = rows.filter(F.col("v").between(low, high))
    if low == high:
        return low
    values = sorted(r.v for r in part.collect())
    return (values[first - before] + values[last - before]) / 2


def median_distance(d: DataFrame) -> DataFrame:
    """The median of the distances, for the width of a Gaussian kernel."""
    return d.sparkSession.createDataFrame([(exact_median(d, "d"),)], "sigma double")


#: Bits of a distance by which ranges are told apart at once.
DIGIT = 16


def median_of_distances(features: DataFrame) -> DataFrame:
    """``median_distance`` of the ``distances`` of long features (series_id, feature, value), of which none is
    stored: cells of series count theirs by the leading bits, which order as the numbers do, and again by
    the next bits within the range of the middle, until few enough are left to be fetched. Exact."""
    rows = vectors(features, ["feature"], "value").filter("NOT exists(v, x -> x IS NULL)")
    cells = block_cells(rows)

    def by_length(v):
        return {v.shape[1]: v} if isinstance(v, np.ndarray) else {n: np.array([u for u in v if len(u) == n]) for n in {len(u) for u in v}}

    def of(batch):
        """Arrays of distances as whole numbers; vectors of unlike length have none."""
        for same, _, x, _, y in block_sides(batch, CELL_SERIES, by_length):
            for size in x.keys() & y.keys():
                d = np.zeros((len(x[size]), len(y[size])))
                for k in range(size):
                    e = x[size][:, k, None] - y[size][:, k]
                    d += e * e
                d[np.isnan(d)] = np.nan  # of one sign, above all numbers
                yield (d[np.triu_indices(len(d), 1)] if same else d.ravel()).view(np.int64)

    def counted(heads, shift):
        """Numbers of distances by their bits from ``shift`` up, of those that begin like one of ``heads``."""

        def run(batches):
            counts = np.zeros((len(heads), 1 << DIGIT), np.int64)
            for batch in batches:
                for d in of(batch):
                    for n, head in enumerate(heads):
                        part = d if shift + DIGIT == 64 else d[d >> (shift + DIGIT) == head]
                        counts[n] += np.bincount((part >> shift) & ((1 << DIGIT) - 1), minlength=1 << DIGIT)
            n, digit = counts.nonzero()
            yield pa.RecordBatch.from_pydict({"head": (np.array(heads)[n] << DIGIT) + digit, "n": counts[n, digit]})

        return sorted(tuple(r) for r in cells.mapInArrow(run, "head bigint, n bigint").groupBy("head").agg(F.sum("n")).collect())

    def fetched(heads, shift):
        def run(batches):
            for batch in batches:
                for d in of(batch):
                    yield pa.RecordBatch.from_pydict({"v": d[np.isin(d >> shift, heads)]})

        return sorted(r.v for r in cells.mapInArrow(run, "v bigint").collect())

    shift, found, starts = 64 - DIGIT, counted([0], 64 - DIGIT), {0: 0}
    n = sum(c for _, c in found)
    if not n:
        return features.sparkSession.createDataFrame([(None,)], "sigma double")
    places = ((n - 1) // 2, n // 2)
    while True:
        inside, above = {}, None
        for head, c in found:  # in order; ``at`` is the place of a range's first distance among all
            at = starts[head >> DIGIT] if head >> DIGIT != above else at
            above = head >> DIGIT
            if at <= places[1] and at + c > places[0]:
                inside[head] = (at, c)
            at += c
        starts, first = {head: a for head, (a, _) in inside.items()}, min(a for a, _ in inside.values())
        if shift == 0 or sum(c for _, c in inside.values()) <= EXACT_VALUES:
            break
        shift -= DIGIT
        found = counted(list(inside), shift)
    if shift:
        values = fetched(list(inside), shift)
        low, high = (values[p - first] for p in places)
    else:
        low, high = (next(h for h, (a, c) in inside.items() if a <= p < a + c) for p in places)
    low, high = np.array([low, high], np.int64).view(np.float64)
    return features.sparkSession.createDataFrame([(float((low + high) / 2),)], "sigma double")


def gaussian_kernel(d: DataFrame, tau: float) -> DataFrame:
    """exp(-d / (2 tau^2)) of squared distances."""
    return d.select("a", "b", F.exp(-F.col("d") / (2 * tau * tau)).alias("k"))


def bands(spectra: DataFrame, limits: Sequence[tuple[float, float]]) -> DataFrame:
    """Sums of (…, f, value) within bands, edges included; the bands are literals, so no join is made."""
    rows = F.filter(
        F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, (a, b) in enumerate(limits, 1))),
        lambda x: (F.col("f") >= x["lo"]) & (F.col("f") <= x["hi"]),
    )
    keys = [c for c in spectra.columns if c not in ("f", "value")]
    return spectra.select(*keys, "value", F.explode(rows).alias("b")).groupBy(*keys, F.col("b.band").alias("band")).agg(F.sum("value").alias("value"))


def relative_spectra(spectra: DataFrame) -> DataFrame:
    """Spectra (state, f, i, j, value) less their mean across states."""
    return spectra.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("f", "i", "j")))


def scatter_divergence(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Symmetric Wishart divergence between series a < b of their scatter matrices: one matrix per
    series leaves the aggregate."""
    from tidemark.functions.special import symmetric_wishart
    from tidemark.operators.moments import products

    k = len(names)
    sums = products(wide, names, None, ["series_id"]).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "s"))).alias("m"))
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]  # the order of the sums

    def scatter(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.empty((len(v), k + 1, k + 1))
        for c, (i, j) in enumerate(at):
            m[:, i, j] = m[:, j, i] = v[:, c]
        n, first = m[:, 0, 0], m[:, 0, 1:]
        return n / 2 + k, (m[:, 1:, 1:] - first[:, :, None] * first[:, None, :] / n[:, None, None] + 1e-6 * np.eye(k)) / 2

    return measured_pairs(sums.select("series_id", F.col("m.s").alias("v")), lambda x, y: symmetric_wishart(*x, *y), "divergence", scatter)
