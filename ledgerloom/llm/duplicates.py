"""Problem 2: records that differ only in whitespace, case, punctuation or field order.

Every text becomes the sorted list of its fields, each stripped to letters and digits, and that a
128-bit hash. Blocks of bit positions of the hashes are merged across partitions into the Bloom
filter of bits that were set at least twice. A hash whose bits are all in it may be a repeat; only
those rows are shuffled and grouped exactly. All others are emitted as single records.

Size bounds: a filter has ``bits_per_row`` bits a row and at most ``max_filter_bytes`` (a
parameter), so what the driver gathers and broadcasts is bounded. Where all rows would need more, the hashes are
written in slices, each read once and given a filter of its own, so the filter is as sharp for
billions of rows as for a few. Bit positions are shipped sorted, as compressed differences: about three bytes a
row, where the exact grouping of all rows would ship twenty-four.

Skew: groups are counted by an aggregate that combines before the shuffle; rows find their group
by a join that adaptive execution splits where one group holds a large part of all rows.

Defined results
  * null text: a record of its own; texts without any letter or digit are equal to each other.
  * an empty table gives no rows; other columns are ignored, whatever their names.
  * ``doc_key`` is taken as unique; a repeated row is one more copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.session import materialise

#: Bits of the filter that are handled as one block: 2**22 bits are 512 KiB.
BLOCK_BITS = 22


def canonical_text(text: Column) -> Column:
    """The fields of a text, bare of everything but letters and digits, in sorted order."""
    bare = F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\n\r|;•]+", "")
    return F.array_join(F.array_sort(F.filter(F.split(bare, r"[\n\r|;•]+"), lambda x: x != "")), "\n")


def canonical_hashes(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """``doc_key, h1, h2``: two independent 64-bit hashes of the canonical text."""
    form = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_key"), canonical_text(F.col(text)).alias("form"))
    return form.select("doc_key", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(7), "form").alias("h2"))


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions a hash, both in the block that its topmost bits choose."""
    u = h.astype(np.uint64)
    blocks = bits >> BLOCK_BITS
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    block = ((u >> np.uint64(44)) % np.uint64(blocks)) << np.uint64(BLOCK_BITS)
    return block | (u & mask), block | ((u >> np.uint64(22)) & mask)


def _squeeze(positions: np.ndarray) -> bytes:
    """Ascending positions as compressed differences, their low bytes first and their high bytes last."""
    import zstandard

    steps = np.diff(positions.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _positions_of(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _pack(block: int, once: np.ndarray, twice: np.ndarray) -> dict:
    return {"block": block, "once": _squeeze(once), "twice": _squeeze(twice)}


_SPARSE = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _sparse_blocks(bits: int):
    """For one partition, the bit positions set and those set by two hashes of the partition, by block."""

    def flush(positions: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
        rows = []
        once, counts = np.unique(positions, return_counts=True)
        twice = np.union1d(once[counts > 1], repeated)
        edges = np.unique(once >> np.uint64(BLOCK_BITS))
        low = np.uint64((1 << BLOCK_BITS) - 1)
        for b in edges:
            lo, hi = np.uint64(int(b) << BLOCK_BITS), np.uint64((int(b) + 1) << BLOCK_BITS)
            pick = lambda a: a[np.searchsorted(a, lo):np.searchsorted(a, hi)] & low  # noqa: E731, B023
            rows.append(_pack(int(b), pick(once), pick(twice)))
        return pa.RecordBatch.from_pylist(rows, schema=_SPARSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= 1_000_000:
                yield flush(*_both(held, bits))
                held, size = [], 0
        if size:
            yield flush(*_both(held, bits))

    return run


def _both(held: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _positions(np.concatenate(held), bits)
    return np.concatenate([p, q[q != p]]), np.empty(0, dtype=np.uint64)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block: the bits set in two of a block's rows, or twice in one."""
    current, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": current, "bits": np.packbits(twice, bitorder="little").tobytes()}],
                                          schema=pa.schema([("block", pa.int32()), ("bits", pa.binary())]))

    for batch in batches:
        for block, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if block != current:
                if current is not None:
                    yield done()
                current, once, twice = block, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            at = _positions_of(o)
            twice[at] |= once[at]
            once[at] = True
            twice[_positions_of(t)] = True
    if current is not None:
        yield done()


#: Bits of the filter for each row, and the bytes of a filter at most.
BITS_PER_ROW, MAX_FILTER_BYTES = 8, 128 << 20


def possible_repeats(hashes: DataFrame, bits_per_row: int = BITS_PER_ROW, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``hashes`` with ``maybe``: false only where a hash is certain to stand alone."""
    spark = hashes.sparkSession
    wanted = max(1, min(hashes.count() * bits_per_row, max_filter_bytes * 8) >> BLOCK_BITS)
    bits = (wanted + 1) << BLOCK_BITS
    sparse = hashes.select("h1").mapInArrow(_sparse_blocks(bits), "block int, once binary, twice binary")
    merged = sparse.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_blocks, "block int, bits binary")
    filter_bits = np.zeros(bits >> 3, np.uint8)  # at most max_filter_bytes and a block
    for row in merged.toLocalIterator():
        at = row["block"] << (BLOCK_BITS - 3)
        filter_bits[at:at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(filter_bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            p, q = _positions(batch.column("h1").to_numpy(zero_copy_only=False), bits)
            hit = lambda x: (seen[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((hit(p) & hit(q)).astype(bool))], [*batch.schema.names, "maybe"])

    return hashes.mapInArrow(mark, "doc_key long, h1 long, h2 long, maybe boolean")


def _marked(docs: DataFrame, key: str, text: str, max_filter_bytes: int) -> DataFrame:
    """All hashes with ``maybe``, by one filter for each slice of them that a filter can serve."""
    hashes = canonical_hashes(docs, key, text)
    slices = -(-docs.count() * BITS_PER_ROW // (max_filter_bytes * 8))
    if slices <= 1:
        return materialise(possible_repeats(materialise(hashes, "canonical"), max_filter_bytes=max_filter_bytes), "marked")
    sliced = materialise(hashes.withColumn("slice", F.pmod("h2", F.lit(slices)).cast("int")), "canonical", ["slice"])
    out = None
    for k in range(slices):
        one = materialise(possible_repeats(sliced.filter(F.col("slice") == k).drop("slice"), max_filter_bytes=max_filter_bytes), "marked")
        out = one if out is None else out.unionAll(one)
    return out


def collapse(docs: DataFrame, key: str = "doc_key", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(records, members)``: ``first_key, copies`` of every record, ``first_key, doc_key`` of repeats.

    ``members`` has the rows other than the smallest key of their record.
    """
    marked = _marked(docs, key, text, max_filter_bytes)
    maybe = marked.filter("maybe")
    groups = maybe.groupBy("h1", "h2").agg(F.min("doc_key").alias("first_key"), F.count("*").alias("copies"))
    repeated = groups.filter("copies > 1")
    alone = marked.filter("not maybe").select(F.col("doc_key").alias("first_key"), F.lit(1).cast("long").alias("copies"))
    blank = docs.filter(F.col(text).isNull()).select(F.col(key).alias("first_key"), F.lit(1).cast("long").alias("copies"))
    records = groups.select("first_key", "copies").unionAll(alone).unionAll(blank)
    members = maybe.join(repeated.select("h1", "h2", "first_key"), ["h1", "h2"]).filter("doc_key <> first_key")
    return records, members.select("first_key", "doc_key")
