"""Problem 9: long spans that stand verbatim in more than one record.

The tokens are the overlapping grams of ``gram`` characters, hashed once. A compact window <first, centre, last>
is the run of all stretches of ``span`` characters whose least gram hash lies at ``centre``: a node of
the Cartesian tree over the hashes whose subtree is at least as wide as a stretch, with the starts
that belong to it. A text of n characters has about 2 n / (span - gram) windows and each of its
stretches lies in one. Two texts that share a stretch share its least gram hash, the signature of
the window, so one hash function finds every verbatim span; more would only add near ones.

Windows are joined by signature, as intervals, never character by character:
  * a window whose signature and whole text (a hash of all its characters) two different texts
    have is shared from end to end;
  * only windows in which a shared span ends have a signature in common, but not the text. One of
    each different text is taken to its stretches, which are verified by the hash of all their
    ``span`` characters beside the signature: 128 bits.
Overlapping intervals are merged for the amount of each text that is shared.

Skew: signatures are counted by aggregates that combine before the shuffle (least and greatest text),
and the joins back are semi joins that adaptive execution splits. No pairs of texts are
formed, so a passage that stands in a third of all texts costs what it is long. A task reads a text once, however many copies of it it holds.

Defined results
  * null, empty and shorter texts have no shared span; a text that stands in two rows is shared whole.
  * lengths count Unicode code points, exactly as stored; no folding. Texts are told apart by a 64-bit hash.
  * an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import materialise

GRAM = 48
_CHUNK = 1 << 20
#: Texts that a task remembers, so as not to read their copies again.
_SEEN = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``width`` consecutive elements, by doubling."""
    power, piece, size = _U(base), _mix(codes + _U(base & 0xFFFFFFFF)), 1
    total, done, rest = None, 0, width
    with np.errstate(over="ignore"):
        factor = _U(1)  # base ** done
        while rest:
            if rest & 1:
                part = piece[done:]
                total = part if total is None else total[:len(part)] + factor * part[:len(total)]
                done += size
                factor *= power
            rest >>= 1
            if rest:
                piece = piece[:-size] + power * piece[size:] if len(piece) > size else piece[:0]
                power *= power
                size <<= 1
        return _mix(total[:max(0, len(codes) - width + 1)])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, keys
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:len(keys) - width + 1], low[width - size:]) if width > size else low


def signatures(codes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of ``span`` codes: the least gram hash in it and that gram's position."""
    h = rolling(codes, gram, 0x9E3779B97F4A7C15)
    at = np.arange(len(h), dtype=_U)
    keys = (h & ~_U((1 << 26) - 1)) | (at & _U((1 << 26) - 1))  # ties: the leftmost
    low = sliding_min(keys, span - gram + 1)
    position = (low & _U((1 << 26) - 1)).astype(np.int64)
    if len(h) >= 1 << 26:  # a text longer than the position field: positions are found block by block
        base = np.arange(len(low)) >> 26 << 26
        position = np.where(base + position < np.arange(len(low)), base + (1 << 26) + position, base + position)
    return h[position], position


def _chunks(ids: list, texts: list, span: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of about a million characters at a time: ids, codes, the text of each code, its end."""
    held, size = [], 0
    for key, text in zip(ids, texts):
        if text is None or len(text) < span:
            continue
        held.append((key, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)))
        size += len(text)
        if size >= _CHUNK:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.array([len(c) for _, c in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    return [k for k, _ in held], np.concatenate([c for _, c in held]), owner, np.cumsum(sizes)


_WINDOW = pa.schema([("text_id", pa.int64()), ("sig", pa.int64()), ("run", pa.int64()), ("body", pa.int64())])


def compact_windows(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(owner, signature, first start, last start, hash of all its characters)`` of each window of joined texts."""
    sig, centre = signatures(codes, span, gram)
    starts = np.arange(len(sig))
    valid = starts + span <= ends[owner[:len(sig)]]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (centre[1:] != centre[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & fresh)
    stops = np.ones(len(sig), bool)
    stops[:-1] = (centre[1:] != centre[:-1]) | ~valid[1:]
    last = np.flatnonzero(valid & stops)
    whole = rolling(codes, span, 0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):  # a window is shorter than two stretches, so its first and its last one cover it
        shape = (last - first).astype(_U) << _U(32) | (centre[first] - first).astype(_U)
        body = _mix(_mix(whole[first] + shape) * _U(3) + whole[last])
    return owner[first], sig[first].view(np.int64), first, last, body.view(np.int64)


def _all_windows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key not in seen:
                    ids.append(key)
                    texts.append(text)
                    if len(seen) < _SEEN:
                        seen.add(key)
            for keys, codes, owner, ends in _chunks(ids, texts, span):
                begin = np.concatenate([[0], ends[:-1]])
                who, sig, first, last, body = compact_windows(codes, owner, ends, span, gram)
                at = (first - begin[who]) << 32 | (last - begin[who])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[who]), pa.array(sig), pa.array(at), pa.array(body)], schema=_WINDOW)

    return run


def _stretches(span: int):
    """The stretches of the windows in question, each with the hash of all its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for keys, codes, _, ends in _chunks(list(wanted), batch.column(1).to_pylist(), span):
                whole, begin = rolling(codes, span, 0xC2B2AE3D27D4EB4F).view(np.int64), 0
                for number, key in enumerate(keys):
                    runs = wanted[key]
                    first = np.array([r["run"] >> 32 for r in runs], np.int64)
                    many = np.array([r["run"] & 0xFFFFFFFF for r in runs], np.int64) - first + 1
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), key, np.int64)), pa.array(np.repeat(np.array([r["sig"] for r in runs], np.int64), many)),
                         pa.array(at), pa.array(whole[begin + at]), pa.array(np.repeat(np.array([r["alone"] for r in runs], bool), many))],
                        ["text_id", "sig", "start", "whole", "alone"])
                    begin = int(ends[number])

    return run


def shared_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 120, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``(members, intervals)``: ``doc_id, text_id, chars`` of texts of ``span`` characters or more, ``text_id, start, stop`` of what texts share."""
    own = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")).filter(F.length("text") >= span)
    members = materialise(own.select("doc_id", "text_id", F.length("text").cast("long").alias("chars")), "members")
    read = own.select("text_id", "text")
    windows = materialise(read.mapInArrow(_all_windows(span, gram), "text_id long, sig long, run long, body long"), "windows")
    ends = (F.min("text_id").alias("a"), F.max("text_id").alias("b"))
    met = windows.groupBy("sig").agg(*ends).filter("a <> b").select("sig")
    alike = materialise(windows.join(met, "sig", "left_semi"), "alike")
    bodies = materialise(alike.groupBy("sig", "body").agg(*ends, F.min_by("run", "text_id").alias("run")), "bodies")
    shared, alone = bodies.filter("a <> b"), bodies.filter("a = b").select("sig", "body")
    whole = alike.join(shared.select("sig", "body"), ["sig", "body"], "left_semi").select("text_id", "run")
    edges = alike.join(alone, ["sig", "body"], "left_semi").select("text_id", "sig", "run", F.lit(True).alias("alone")).unionAll(
        shared.join(alone.select("sig").distinct(), "sig", "left_semi").select(F.col("a").alias("text_id"), "sig", "run", F.lit(False).alias("alone")))
    wanted = edges.groupBy("text_id").agg(F.collect_list(F.struct("sig", "run", "alone")).alias("runs"))  # a text's own windows
    one = wanted.join(members.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")), "text_id")
    texts = own.select("doc_id", "text").join(one, "doc_id").select("text_id", "text", "runs")
    stretches = materialise(texts.mapInArrow(_stretches(span), "text_id long, sig long, start long, whole long, alone boolean"), "stretches")
    # what isn't alone stands in two texts already, though only one of them is taken to its stretches
    twice = stretches.groupBy("sig", "whole").agg(*ends, F.bool_and("alone").alias("alone")).filter("a <> b or not alone").select("sig", "whole")
    part = stretches.filter("alone").join(twice, ["sig", "whole"], "left_semi").select("text_id", "start", (F.col("start") + span).alias("stop"))
    run = whole.select("text_id", F.shiftright("run", 32).alias("start"), (F.col("run").bitwiseAND(F.lit(0xFFFFFFFF)) + span).alias("stop"))
    return members, run.unionAll(part)


def shared_spans(intervals: DataFrame) -> DataFrame:
    """Maximal shared spans ``text_id, start, length`` from overlapping or touching intervals."""
    before = Window.partitionBy("text_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))
    island = intervals.withColumn("open", opens.cast("int")).withColumn("n", F.sum("open").over(Window.partitionBy("text_id").orderBy("start")))
    return island.groupBy("text_id", "n").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length")).drop("n")


def shared_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 120, gram: int = GRAM) -> DataFrame:
    """``doc_id, shared_chars`` of every document with a shared span."""
    members, intervals = shared_intervals(docs, key, text, span, gram)
    parts = shared_spans(intervals).groupBy("text_id").agg(F.sum("length").alias("part"))
    copied = members.groupBy("text_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.first("chars").alias("chars"))
    copied = copied.filter("a <> z").select("text_id", F.col("chars").alias("part"))
    most = parts.unionAll(copied).groupBy("text_id").agg(F.max("part").alias("shared_chars"))
    return members.join(most, "text_id").select("doc_id", "shared_chars")
