"""Byte-level BPE by two tiers: a minimal perfect hash over the vocabulary, and a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import pickle
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import ship, text_of

#: Pre-tokens that a worker remembers (beyond, it begins anew), and their characters at most.
REMEMBER, REMEMBER_CHARS = 400_000, 64


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: n keys take n slots.

    Keys fall into about n / 3 buckets by their 64-bit hash. From the largest bucket on, each looks for the first
    displacement d at which all its keys, their hashes mixed with d, meet free slots of their own; buckets of one key
    name a slot that is left. A look-up hashes once and compares the key in the slot.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 3)
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.values = [-1] * n
        members: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            members.setdefault(h % self.buckets, []).append((h, i))
        order = sorted(members, key=lambda b: -len(members[b]))
        free = None
        for b in order:
            group = members[b]
            if len(group) == 1:
                free = iter([s for s in range(n) if self.slots[s] is None]) if free is None else free
                spots = [next(free)]
                self.shift[b] = -spots[0] - 1
            else:
                d = 0
                while len(set(spots := [self._spot(h, d) for h, _ in group])) < len(group) or any(self.slots[s] is not None for s in spots):
                    d += 1
                    if d > 64 * n:
                        raise ValueError("two keys have one hash")
                self.shift[b] = d
            for s, (_, i) in zip(spots, group, strict=True):
                self.slots[s], self.values[s] = keys[i], i

    def _spot(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The key's place in the list it was built from; -1 if it wasn't there."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._spot(h, d)
        return self.values[s] if self.slots[s] == key else -1


def read_ranks(blob: bytes) -> tuple[list[bytes], list[int]]:
    """Tokens and ids of a rank file: lines of a base64 token and its rank."""
    pairs = [x.split() for x in blob.splitlines() if x.strip()]
    return [base64.b64decode(t) for t, _ in pairs], [int(i) for _, i in pairs]


class Tokenizer:
    """encode() as the rank file and pattern say, without special tokens."""

    def __init__(self, blob: bytes, pattern: str, words: PerfectHash | None = None):
        self.tokens, self.ids = read_ranks(blob)
        self.words = words or PerfectHash(self.tokens)
        self.rank = dict(zip(self.tokens, self.ids, strict=True))
        self.bytes_of = dict(zip(self.ids, self.tokens, strict=True))
        self.text_of = {i: str(i) for i in self.ids}
        self.split = regex.compile(pattern).findall
        self.known = Known(self)

    def word(self, token: str) -> tuple[int, ...]:
        data = token.encode()
        at = self.words.get(data)
        return (self.ids[at],) if at >= 0 else self.merged(data)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, the leftmost first, until none is in the vocabulary. A node is the byte its piece begins
        at; after[] links it to the next one (0: it was merged into the one before). The heap holds rank and node of
        pairs as they were when they arose; a pair that has changed since is skipped. n log n for any length."""
        n, rank = len(data), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r << 40) | i for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFFFF
            mid = after[i]
            if not mid or mid >= n:
                continue
            end = after[mid]
            if rank(data[i:end]) != x >> 40:
                continue
            after[i], after[mid] = end, 0
            before[end] = i
            if end < n and (r := rank(data[i : after[end]])) is not None:
                heappush(heap, (r << 40) | i)
            if (p := before[i]) >= 0 and (r := rank(data[p:end])) is not None:
                heappush(heap, (r << 40) | p)
        out, i = [], 0
        while i < n:
            out.append(self.rank[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > REMEMBER:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Known(dict):
    """Ids of the short pre-tokens met so far."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = self.tokenizer.word(token)
        if len(token) <= REMEMBER_CHARS:
            self[token] = out
        return out


@lru_cache(maxsize=2)
def sent(ranks_path: str) -> tuple[bytes, bytes]:
    """A rank file, and the perfect hash of its tokens, pickled: built once, on the driver."""
    with open(ranks_path, "rb") as f:
        blob = f.read()
    return blob, pickle.dumps(PerfectHash(read_ranks(blob)[0]))


@lru_cache(maxsize=2)
def tokenizer(blob: bytes, words: bytes, pattern: str) -> Tokenizer:
    """A worker's tokenizer, kept from task to task."""
    return Tokenizer(blob, pattern, pickle.loads(words))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of each row's whole text, and the text back from the ids.

    A row for each row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of
    the bytes the ids decode to) and, with_ids, ids. Null counts as empty: no tokens. The rank file is read on the
    driver and sent to the executors; its size does not depend on the documents. Each row is its own work: nothing is
    shuffled, and a worker holds a batch of rows and a bounded memory of pre-tokens.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(sent(ranks_path))

    def run(batches):
        import pyarrow as pa

        tok = tokenizer(*vocabulary.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                n, a, b, kept = [], [], [], []
                for x in batch.column("text"):
                    ids = tok.encode(x.as_py())
                    n.append(len(ids))
                    a.append(sha(" ".join(map(tok.text_of.__getitem__, ids)).encode()))
                    b.append(sha(tok.decode(ids)))
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                if with_ids:
                    ends = pa.array([0, *_sums(n)], pa.int32())
                    cols["ids"] = pa.ListArray.from_arrays(ends, pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _sums(n: list[int]) -> list[int]:
    out, total = [], 0
    for x in n:
        out.append(total := total + x)
    return out


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column decoded, the bytes of their ids (null ids: null)."""
    spark = rows.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(sent(ranks_path))

    @F.pandas_udf("binary")
    def back(ids):
        import pandas as pd

        tok = tokenizer(*vocabulary.value, pattern)
        return pd.Series([None if x is None else tok.decode(x.tolist()) for x in ids])

    return rows.withColumn("decoded", back(F.col(f"`{ids_col}`")))
