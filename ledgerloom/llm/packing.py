"""Problem 8: texts, sized in tokens, into containers of fixed capacity.

The global histogram of sizes is all that a plan needs. Dynamic programming over it chooses the
boundaries of length buckets that minimise padding. Batches form inside each bucket, from the
longest, as many texts as the token budget takes; the space that they leave is topped up from the
shorter buckets, tightest space first, still on counts alone. Batches of one bucket only would
leave the space beside every long text unused. The plan then gives each rank of each bucket its
container; ranks come from a salted window, so a size that a third of all texts have is split.

Size bounds: a histogram has at most ``capacity`` rows and a plan a few times ``max_buckets``; only
these reach the driver. ``specs`` is the fixed table of container sizes.

Defined results
  * a text longer than the capacity is cut into full pieces and a rest; no other text is cut.
  * null and empty texts have one piece of no tokens and go round the containers in turn
    (container 0 where there is none).
  * no texts: no rows; a capacity that is null or below 1: no rows for that spec.
  * ids repeated in the input are packed once for each row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.tokens import TOKENIZER_DIR, token_counts
from ledgerloom.session import materialise

MAX_BUCKETS = 512
SALTS = 64


def _cheapest(sizes: list[int], c: list[int], w: list[int], fee: int, many: bool) -> tuple[int, list[int]]:
    """Least padding plus ``fee`` a bucket, and the ends of its buckets (as few or as ``many`` as tie).

    A bucket of sizes j to i-1 pads sizes[i-1] (c[i] - c[j]) - (w[i] - w[j]): a line in sizes[i-1] for each j, of falling
    slope, so the best j only moves on and each line is looked at once.
    """
    n, sign = len(sizes), -1 if many else 1
    best, count, back = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    lines, head = [0], 0

    def value(j: int, x: int) -> tuple[int, int]:
        return best[j] + w[j] - x * c[j], sign * count[j]

    def useless(i: int, j: int, k: int) -> bool:  # whether line j is nowhere under both i and k
        bi, bj, bk = (best[t] + w[t] for t in (i, j, k))
        left, right = (bj - bi) * (c[k] - c[j]), (bk - bj) * (c[j] - c[i])
        return left > right or left == right and sign * count[j] >= max(sign * count[i], sign * count[k])

    for i in range(1, n + 1):
        x = sizes[i - 1]
        while head + 1 < len(lines) and value(lines[head + 1], x) <= value(lines[head], x):
            head += 1
        j = lines[head]
        best[i], count[i], back[i] = best[j] + w[j] - x * c[j] + x * c[i] - w[i] + fee, count[j] + 1, j
        while len(lines) - head >= 2 and useless(lines[-2], lines[-1], i):
            lines.pop()
        lines.append(i)
    ends, i = [], n
    while i:
        ends.append(i)
        i = back[i]
    return best[n], ends[::-1]


def length_buckets(sizes: np.ndarray, counts: np.ndarray, most: int = MAX_BUCKETS) -> np.ndarray:
    """The boundaries of at most ``most`` buckets of ascending ``sizes`` with the least total padding.

    Padding falls ever less with each further bucket, so a fee for each leads to any number of them: the fee is
    searched, and each trial is linear in the sizes. Where no fee gives just ``most``, the best plans with fewer and with more
    have a bucket of one inside a bucket of the other, and change over there without loss.
    """
    n = len(sizes)
    if n <= most:
        return sizes
    own = [int(x) for x in sizes]
    c, w = [0], [0]
    for x, k in zip(own, counts.tolist()):
        c.append(c[-1] + int(k))
        w.append(w[-1] + int(k) * x)
    low, high = 0, own[-1] * c[-1] + 1  # at the low fee there are too many buckets, at the high one not
    while high - low > 1:
        fee = (low + high) // 2
        if len(_cheapest(own, c, w, fee, False)[1]) <= most:
            high = fee
        else:
            low = fee
    few, many = _cheapest(own, c, w, high, False)[1], _cheapest(own, c, w, high, True)[1]
    ends = few
    if len(few) < most < len(many):
        a, b, more = [0, *few], [0, *many], most - len(few)
        at = next(i for i in range(len(few)) if a[i] <= b[i + more] and b[i + more + 1] <= a[i + 1])
        ends = [*b[1:at + more + 2], *a[at + 2:]]
    elif len(many) <= most:
        ends = many
    return np.array([own[i - 1] for i in ends])


def plan(buckets: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple], int]:
    """``(placements, containers)``; a placement is (bucket, first rank, end rank, first container, texts each).

    Groups of containers with equal content are kept as (first container, how many) by free space.
    """
    placements, free, groups, containers = [], [], defaultdict(list), 0

    def add(space: int, first: int, many: int) -> None:
        if many:
            if not groups[space]:
                insort(free, space)
            groups[space].append((first, many))

    for size, left in sorted(zip(buckets.tolist(), counts.tolist()), reverse=True):
        rank = 0
        while left:
            at = bisect_left(free, size)
            if at < len(free):
                space = free[at]
                first, many = groups[space].pop()
                if not groups[space]:
                    free.pop(at)
            else:
                space, first = capacity, containers
                many = -(-left // (capacity // size))
                containers += many
            each = space // size
            full = min(many, left // each)
            rest = 0 if full == many else left % each
            if full:
                placements.append((size, rank, rank + full * each, first, each))
                rank, left = rank + full * each, left - full * each
                add(space - each * size, first, full)
            if rest and left:
                placements.append((size, rank, rank + rest, first + full, rest))
                rank, left = rank + rest, left - rest
                add(space - rest * size, first + full, 1)
                add(space, first + full + 1, many - full - 1)
            else:
                add(space, first + full, many - full)
    return placements, containers


def _assign(placements: list[tuple], containers: int):
    table = np.array(sorted(placements), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            bucket, rank = (batch.column(i).to_numpy() for i in (4, 5))
            out = rank % max(containers, 1)
            real = bucket > 0
            at = np.searchsorted(key, bucket[real] << 44 | rank[real], side="right") - 1
            row = table[at]
            out[real] = row[:, 3] + (rank[real] - row[:, 1]) // row[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], ["doc_id", "piece", "start_token", "n_tokens", "container"])

    return run


def pack_one(sizes: DataFrame, capacity: int, max_buckets: int = MAX_BUCKETS, salts: int = SALTS) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens, container`` for ``sizes`` (doc_id, n_tokens)."""
    spark = sizes.sparkSession
    last = F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / F.lit(capacity))
    pieces = sizes.select("doc_id", F.greatest("n_tokens", F.lit(0)).alias("total"))
    pieces = pieces.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start_token"),
                           F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"))
    histogram = pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most `capacity` rows
    histogram.sort()
    lengths = np.array([r[0] for r in histogram], np.int64)
    counts = np.array([r[1] for r in histogram], np.int64)
    edges = length_buckets(lengths, counts, max_buckets) if len(lengths) else lengths
    held = np.bincount(np.searchsorted(edges, lengths), weights=counts, minlength=len(edges)).astype(np.int64) if len(lengths) else counts
    placements, containers = plan(edges, held, capacity)
    to_bucket = spark.createDataFrame([(0, 0)] + [(int(n), int(edges[np.searchsorted(edges, n)])) for n in lengths], "n_tokens long, bucket long")
    salted = pieces.join(F.broadcast(to_bucket), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    own = Window.partitionBy("bucket", "salt")
    ranked = salted.withColumn("r", F.row_number().over(own.orderBy("doc_id", "piece")).cast("long") - 1)
    per_salt = salted.groupBy("bucket", "salt").count()  # at most max_buckets times salts rows
    offsets = per_salt.select("bucket", "salt", (F.sum("count").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("count")).alias("base"))
    placed = ranked.join(F.broadcast(offsets), ["bucket", "salt"]).select(
        "doc_id", "piece", "start_token", "n_tokens", "bucket", (F.col("r") + F.col("base")).alias("rank"))
    return placed.mapInArrow(_assign(placements, containers), "doc_id long, piece long, start_token long, n_tokens long, container long")


def pack(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """``spec, container, doc_id, piece, start_token, n_tokens`` for every spec (spec, capacity, tokenizer)."""
    rows = [r for r in specs.select("spec", "capacity", "tokenizer").collect() if r["capacity"] and r["capacity"] > 0]
    counted, out = {}, None
    for r in rows:
        if r["tokenizer"] not in counted:
            counted[r["tokenizer"]] = materialise(token_counts(docs, key, text, r["tokenizer"], folder), "sizes")
        one = pack_one(counted[r["tokenizer"]], int(r["capacity"]), max_buckets).select(
            F.lit(r["spec"]).alias("spec"), "container", "doc_id", "piece", "start_token", "n_tokens")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "spec string, container long, doc_id long, piece long, start_token long, n_tokens long")
    return out


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, for each spec."""
    used = packed.groupBy("spec").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(specs.select("spec", "capacity").filter("capacity > 0")), "spec").select(
        "spec", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))
