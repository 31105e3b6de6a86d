"""Problem 7: the corpus as token ids of a public byte-level BPE vocabulary.

Each partition holds its distinct words in an in-process DuckDB. A recursive query keeps the
token-position rows of every word, joins neighbouring tokens with the merge table, contracts the
word's pairs of least rank from the left and repeats until no pair of any word merges. Ordered
aggregation puts ids back in order and decodes them again. The merges are read once on the driver
(50,000 rows, fixed by the vocabulary) and broadcast.

Contracting all separate occurrences of the least pair in one step equals contracting the leftmost
again and again: a token made by a merge of rank r takes part only in merges of rank above r.

Defined results
  * null and empty text: an empty list. Strings of special tokens in a text are ordinary text.
  * repeated rows and ids stay; an empty table gives no rows; other columns are ignored.
  * unpaired surrogates can't occur in Spark strings; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a recursive query takes at once, and words a task remembers before it starts afresh.
WORDS_AT_ONCE, WORDS_HELD = 20_000, 400_000
#: Words of more bytes take a step of the query for each of thousands of merges; a linked list does
#: the same contractions one by one.
LONG_WORD = 2_000

_CONTRACT = """
WITH RECURSIVE w(wid, toks) USING KEY (wid) AS (
  SELECT wid, toks FROM fresh
  UNION
  (WITH pos AS (
     SELECT wid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM w WHERE len(toks) > 1),
   pair AS (
     SELECT p.wid, p.i, p.tok, m.rank, m.made
     FROM (SELECT *, lead(tok) OVER (PARTITION BY wid ORDER BY i) AS nxt FROM pos) p
     LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt),
   least AS (SELECT *, min(rank) OVER (PARTITION BY wid) AS low FROM pair),
   hit AS (SELECT *, coalesce(rank = low, false) AS is_hit FROM least WHERE low IS NOT NULL),
   run AS (SELECT *, i - sum(is_hit::INT) OVER (PARTITION BY wid ORDER BY i) AS island FROM hit),
   odd AS (SELECT *, is_hit AND (row_number() OVER (PARTITION BY wid, island, is_hit ORDER BY i)) % 2 = 1 AS take FROM run),
   gone AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY wid ORDER BY i), false) AS eaten FROM odd)
   SELECT wid, list(CASE WHEN take THEN made ELSE tok END ORDER BY i) FILTER (WHERE NOT eaten) AS toks
   FROM gone GROUP BY wid))
SELECT wid, toks FROM w
"""

_DECODE = """
SELECT n, string_agg(hex(v.bytes), '' ORDER BY i) AS bytes
FROM (SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM given) g JOIN vocab v USING (id) GROUP BY n
"""


def _byte_letters() -> list[str]:
    """The printable letter that the vocabulary writes for each byte, by the public rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Vocabulary:
    """Ids of the 256 bytes, the merge table and the bytes of each id, as plain picklable values."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [vocab[letter] for letter in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.a = [vocab[x] for x, _ in pairs]
        self.b = [vocab[y] for _, y in pairs]
        self.made = [vocab[x + y] for x, y in pairs]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}

    def merges(self) -> pa.Table:
        return pa.table({"rank": pa.array(range(len(self.a)), pa.int32()), "a": pa.array(self.a, pa.int32()),
                         "b": pa.array(self.b, pa.int32()), "made": pa.array(self.made, pa.int32())})


def _connection():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
    return con


class Encoder:
    """Encodes words of one partition; the recursive query runs over its new distinct words."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(PATTERN).findall
        self.con = _connection()
        merges = vocabulary.merges()  # noqa: F841 - read by name
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.known: dict[str, list[int]] = {}
        self.pairs: dict | None = None

    def _contract_long(self, toks: list[int]) -> list[int]:
        """The same least-pair contraction for one very long word, by a heap over a linked list."""
        if self.pairs is None:
            v = self.vocabulary
            self.pairs = {(x, y): (r, z) for r, (x, y, z) in enumerate(zip(v.a, v.b, v.made))}
        n, pairs = len(toks), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(pairs[p][0], i, p) for i in range(n - 1) if (p := (toks[i], toks[i + 1])) in pairs]
        heapq.heapify(heap)
        toks = list(toks)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if toks[i] is not None else n
            if j >= n or (toks[i], toks[j]) != p:
                continue
            toks[i], toks[j], after[i] = pairs[p][1], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (q := (toks[left], toks[right])) in pairs:
                    heapq.heappush(heap, (pairs[q][0], left, q))
        return [t for t in toks if t is not None]

    def _learn(self, words: list[str]) -> None:
        ids = self.vocabulary.byte_ids
        for w in words:
            if len(b := w.encode()) > LONG_WORD:
                self.known[w] = self._contract_long([ids[x] for x in b])
        words = [w for w in words if w not in self.known]
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start:start + WORDS_AT_ONCE]
            fresh = pa.table({"wid": pa.array(range(len(some)), pa.int32()),
                              "toks": pa.array([[ids[b] for b in w.encode()] for w in some], pa.list_(pa.int32()))})
            self.con.register("fresh", fresh)
            for wid, toks in self.con.execute(_CONTRACT).fetchall():
                self.known[some[wid]] = toks
            self.con.unregister("fresh")

    def split_and_learn(self, texts: list[str | None]) -> list[list[str]]:
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        parts = [self.split(t) if t else [] for t in texts]
        self._learn(list({w for words in parts for w in words} - self.known.keys()))
        return parts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        return [[i for w in words for i in known[w]] for words in self.split_and_learn(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        known = self.known
        return [sum(len(known[w]) for w in words) for words in self.split_and_learn(texts)]


def _shared(spark: SparkSession, name: str, folder: str):
    return spark.sparkContext.broadcast(Vocabulary(name, folder))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``; no shuffle."""
    shared = _shared(docs.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = pa.array(encoder.encode(batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs``, without building the ids."""
    shared = _shared(docs.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            counts = pa.array(encoder.count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["doc_id", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the exact text that was encoded, empty for an empty list."""
    shared = _shared(encoded.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        items = shared.value.bytes_of
        vocab = pa.table({"id": pa.array(items.keys(), pa.int32()), "bytes": pa.array(items.values(), pa.binary())})  # noqa: F841
        con.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                con.register("given", pa.table({"n": pa.array(range(part.num_rows), pa.int32()), "ids": part.column(1)}))
                found = dict(con.execute(_DECODE).fetchall())
                con.unregister("given")
                texts = [bytes.fromhex(found.get(n, "")).decode("utf-8", "replace") for n in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
