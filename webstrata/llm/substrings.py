"""Substring dedup by seed and extend: repeated runs of at least ``WINDOW`` words go.

Seeds: in every window the least hash of its ``GRAM``-word grams is an anchor (winnowing), so
two documents that share a window share its anchor; about one word in twenty is one. Anchors
meet in an exchange and those of one document only fall away. Extend: around each anchor that
other documents share, the windows that hold it as their anchor are hashed to both sides and meet
in a second exchange, which gives each window the least ``doc_id`` it starts in. Overlapping
windows that a smaller document has merge to maximal repeats, which are removed.

A block of documents sends each distinct anchor or window once, so a passage that many documents
share is one entry for each block and no pairs are made. Windows are told apart by 64-bit hashes.

Defined results: a NULL or blank text has no words; a row of NULL ``doc_id`` neither loses words
nor makes others lose them; rows of equal ``doc_id`` do not judge each other; fewer than
``WINDOW`` words lose nothing; an empty table gives an empty result; a text of any length is handled
whole, alone in its block if it is long. Other columns are kept, but for those named like an added
one, which give way to it, and those whose names start with an underscore, which are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm import blocks
from webstrata.llm.common import admitted

WINDOW = 50
GRAM = 10
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_ROW = pa.schema(
    {
        "block": pa.int64(),
        "data": pa.binary(),
        "parts": pa.list_(pa.struct({"bucket": pa.int32(), "blob": pa.binary()})),
    }
)


class WordHashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base², ... in 64-bit arithmetic."""
    out = np.full(count, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_STEP, len(words)), out=sums[1:])
    runs = (sums[length:] - sums[:-length]) * powers(_BACK, len(words) - length + 1)
    return mixed(runs)


def rolling_min(values: np.ndarray, length: int) -> np.ndarray:
    """Least of every ``length`` consecutive values."""
    reach = 1
    while 2 * reach <= length:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = length - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Words:
    """The words of a block, one after the other, and the windows inside documents."""

    def __init__(self, table: pa.Table) -> None:
        hashes = WordHashes()
        self.lists = [(t.as_py() or "").encode().split() for t in table.column("text")]
        self.counts = np.fromiter(map(len, self.lists), np.int64, len(self.lists))
        total = int(self.counts.sum())
        flat = (hashes[w] for words in self.lists for w in words)
        self.hashes = np.fromiter(flat, np.uint64, total)
        ids = table.column("doc_id")
        self.known = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.ends = np.cumsum(self.counts)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        inside = np.arange(total) + WINDOW <= self.ends[doc]
        self.starts = np.flatnonzero(inside & self.known[doc])  # of windows
        self.owner = doc[self.starts]

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        least = rolling_min(run_hashes(self.hashes, GRAM), WINDOW - GRAM + 1)
        return least[self.starts]

    def windows(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return run_hashes(self.hashes, WINDOW)[self.starts]

    def parts(self, tokens: np.ndarray, ids: np.ndarray, buckets: int) -> list[dict]:
        """The distinct tokens with the least and the largest document of the block."""
        if not len(tokens):
            return []
        order = np.argsort(tokens, kind="stable")
        tokens, ids = tokens[order], ids[order]
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
        low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        tokens = tokens[first]
        return [
            {
                "bucket": b,
                "blob": blocks.bundle(blocks.pack_sorted(tokens[s]), blocks.pack(low[s]), blocks.pack(high[s])),
            }
            for b, s in blocks.split_by_bucket(tokens, buckets)
        ]


def _to_blocks(buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks.cut(batches, limit):
            words = Words(table)
            parts = words.parts(words.anchors(), words.ids[words.owner], buckets)
            row = {"block": number, "data": blocks.packed_table(table), "parts": parts}
            yield pa.RecordBatch.from_pylist([row], _ROW)

    return run


def _least_documents(group: pd.DataFrame, shared_only: bool) -> pd.DataFrame:
    """For each block's tokens the least document of all: for seeds those that two documents
    share, for windows those where a document of the block is larger."""
    sent = [blocks.unbundle(blob) for blob in group["blob"]]
    tokens = [blocks.unpack_sorted(s[0], np.uint64) for s in sent]
    lows = [blocks.unpack(s[1], np.int64) for s in sent]
    highs = [blocks.unpack(s[2], np.int64) for s in sent]
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)))
    low = np.minimum.reduceat(np.concatenate(lows)[order], first)
    high = np.maximum.reduceat(np.concatenate(highs)[order], first)
    named = ordered[first]
    out = []
    for block, bucket, own, most in zip(group["block"], group["bucket"], tokens, highs, strict=True):
        at = np.searchsorted(named, own)
        keep = (low[at] < high[at]) if shared_only else (low[at] < most)
        if keep.any():
            blob = blocks.bundle(blocks.pack_sorted(own[keep]), blocks.pack(low[at][keep]))
            out.append((block, bucket, blob))
    return pd.DataFrame(out, columns=["block", "bucket", "blob"])


def _seeds(group: pd.DataFrame) -> pd.DataFrame:
    return _least_documents(group, True)


def _repeats(group: pd.DataFrame) -> pd.DataFrame:
    return _least_documents(group, False)


def _answers(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, ascending, and their least documents."""
    found = [blocks.unbundle(b) for _, b in blocks.by_bucket(batch.column("answers")[row].as_py())]
    tokens = [np.zeros(0, np.uint64), *[blocks.unpack_sorted(f[0], np.uint64) for f in found]]
    low = [np.zeros(0, np.int64), *[blocks.unpack(f[1], np.int64) for f in found]]
    return np.concatenate(tokens), np.concatenate(low)


def _found(tokens: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are in the ascending ``named``, and the place of those."""
    if not len(named):
        return np.zeros(len(tokens), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(named, tokens), len(named) - 1)
    held = named[at] == tokens
    return held, at[held]


def _extend(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = Words(blocks.unpacked_table(batch.column("data")[row].as_py()))
                seeded, _ = _found(words.anchors(), _answers(batch, row)[0])
                tokens, ids = words.windows()[seeded], words.ids[words.owner[seeded]]
                parts = words.parts(tokens, ids, buckets)
                out = {"block": batch.column("block")[row].as_py(), "parts": parts}
                yield pa.RecordBatch.from_pylist([out], pa.schema([_ROW.field(0), _ROW.field(2)]))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            table = blocks.unpacked_table(batch.column("data")[row].as_py())
            words = Words(table)
            tokens, low = _answers(batch, row)
            held, at = _found(words.windows(), tokens)
            later = low[at] < words.ids[words.owner[held]]
            starts = words.starts[held][later]
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + WINDOW, -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept_texts, removed = [], []
            for one, end in zip(words.lists, words.ends.tolist(), strict=True):
                mask = gone[end - len(one) : end]
                n = int(mask.sum())
                removed.append(n)
                kept = [w for w, g in zip(one, mask.tolist(), strict=True) if not g] if n else one
                kept_texts.append(b" ".join(kept).decode())
            table = table.append_column("n_words", pa.array(words.counts))
            table = table.append_column("n_removed", pa.array(removed, pa.int64()))
            table = table.append_column("kept_text", pa.array(kept_texts, pa.string()))
            yield from table.to_batches(max_chunksize=2000)



def dedup(docs: DataFrame, limit: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text``: the words left, joined by one space."""
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    docs = admitted(docs, [name for name, _ in added])
    buckets = blocks.bucket_count(docs)
    made = docs.mapInArrow(
        _to_blocks(buckets, limit), f"block long, data binary, parts array<{blocks.PART}>"
    )
    stored = blocks.store(made, "substrings")
    seeds = blocks.exchange(stored.select("block", "parts"), _seeds)
    data = stored.select("block", "data")
    windows = blocks.with_answers(data, seeds).mapInArrow(
        _extend(buckets), f"block long, parts array<{blocks.PART}>"
    )
    repeats = blocks.exchange(windows, _repeats)
    out = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in added]])
    return blocks.with_answers(data, repeats).mapInArrow(_remove, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


ORACLE = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w, row_number() over () r from documents),
p as (select r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) i from w),
h as (select r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) h from p),
m as (select h, min(doc_id) m from h group by h),
g as (select distinct r, i + k g from h join m using (h), range({WINDOW}) k(k) where m.m < h.doc_id),
n as (select r, count(*) n from g group by r),
k as (select w.r, string_agg(word, ' ' order by i) t from (select r, unnest(w) word, unnest(range(1, len(w) + 1)) i from w) w
  left join g on g.r = w.r and g.g = w.i where g.r is null group by w.r)
select doc_id, len(w)::bigint n_words, coalesce(n.n, 0)::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256
from w left join n using (r) left join k using (r)
"""
