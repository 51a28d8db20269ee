"""Phrase collocation mining: an FM-index over word ids for each shard of documents.

1. *Words.* A block of documents (see ``blocks``) is a shard. Its texts become one sequence of word
   ids, one id for each (language, word), with breaks between pieces and documents.
2. *Index.* A shard sorts its positions by the next words, and those of the reversed sequence
   likewise: two BWTs. A phrase is a pair of intervals of the same size, and extending it to the left
   by every word that precedes it gives the phrases of the next length (rank counts give the new
   interval, the counts of smaller words shift its twin). Both BWTs tell whether one word alone
   stands next to a phrase, on either side.
3. *Filter.* Phrases of up to ``FILTERED`` words are counted over all shards by 40-bit hashes. Those
   that reach ``LEAST`` go on, and longer phrases are made only where all parts of ``FILTERED`` words
   do. A collision can only leave more in: no phrase is lost by the filter.
4. *Sum.* What is left is counted by 80-bit hashes; the first shard that holds a frequent phrase
   gives its words. Two of 10**10 phrases share a hash once in 24,000 tables. A phrase that two words
   follow in one shard, and two precede in one, has no longer one that is as frequent; all others
   are compared with those.
5. *Score.* Each cut of a candidate looks up its two parts, which are at least as frequent.

Shuffled are the distinct phrases of a shard, packed, at about three bytes each, so a very common
word or phrase is one entry for each shard.

Defined results: a NULL text is empty; a NULL ``lang`` is ``und``; repeated rows count each; an empty
table gives an empty result; a text of any length is handled whole (a block holds at least one
document). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm import blocks
from webstrata.llm.common import stored
from webstrata.llm.substrings import mixed, powers

LEAST = 100
DEPTH = 5
TOP = 2000
FILTERED = 4
UNKNOWN = "und"
#: Hashes of the filter keep their upper 40 bits.
_KEPT = np.uint64(((1 << 40) - 1) << 24)
#: The others keep 48 bits, and 32 of a second hash.
_LONG = np.uint64(((1 << 48) - 1) << 16)
_STEP = 0x9E3779B97F4A7C15
#: Characters that end a piece become a line feed, the other blank between words a space.
_ENDS = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
_SIZES = "array<struct<lang:string,n:long>>"
_MADE = pa.schema(
    {
        "block": pa.int64(),
        "data": pa.binary(),
        "sizes": pa.list_(pa.struct({"lang": pa.string(), "n": pa.int64()})),
    }
)
_PART = pa.list_(pa.struct({"bucket": pa.int32(), "blob": pa.binary()}))
_SENT = pa.schema({"block": pa.int64(), "places": pa.binary(), "parts": _PART})
_COUNTED = pa.schema(
    {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "n": pa.int64(), "alone": pa.bool_()}
)


class _Ids(dict):
    """Numbers of the words of one language, in order of appearance."""

    def __init__(self, first: int) -> None:
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.first + len(self)
        return value


class Sequence:
    """A shard's word ids with 0 for a break, and the word and language of each id from 1 on."""

    def __init__(self, ids: np.ndarray, words: list[bytes], langs: np.ndarray, names: list[str]):
        self.ids, self.words, self.langs, self.names = ids, words, langs, names

    @classmethod
    def of(cls, texts: list[str | None], langs: list[str | None]) -> Sequence:
        by_lang: dict[str, list[bytes]] = {}
        for text, lang in zip(texts, langs, strict=True):
            by_lang.setdefault(lang if lang is not None else UNKNOWN, []).append((text or "").encode())
        runs, words, owner = [np.zeros(1, np.int32)], [], []
        for at, lang in enumerate(by_lang):
            data = b"\n".join(by_lang[lang]).translate(_ENDS).lower()
            found = _Ids(len(words))
            # Numbers from -1 down are no words, the rest are shifted by one.
            table = {b"": -2, b"\n": -1}
            parts = data.replace(b"\n", b" \n ").split(b" ")
            own = np.fromiter(
                (table[p] if p in table else found[p] for p in parts), np.int32, len(parts)
            )
            runs += [own[own > -2] + 1, np.zeros(1, np.int32)]
            words += found
            owner += [at] * len(found)
        return cls(_without_double_breaks(np.concatenate(runs)), words, np.array(owner, np.int32), list(by_lang))

    def sizes(self) -> list[dict]:
        """Words of each language, all occurrences."""
        per_id = np.bincount(self.ids, minlength=len(self.words) + 1)[1:]
        total = np.bincount(self.langs, per_id, len(self.names)).astype(np.int64)
        return [{"lang": x, "n": int(n)} for x, n in zip(self.names, total, strict=True)]

    def hashes(self) -> np.ndarray:
        """64-bit hash of (language, word) by id; 0 for the break."""
        heads = [x.encode() + b"\0" for x in self.names]
        made = (xxhash.xxh3_64_intdigest(heads[x] + w) for x, w in zip(self.langs.tolist(), self.words, strict=True))
        return np.concatenate([np.zeros(1, np.uint64), np.fromiter(made, np.uint64, len(self.words))])

    def packed(self) -> bytes:
        return blocks.bundle(
            blocks.pack(self.ids), b"\n".join(self.words), blocks.pack(self.langs), "\0".join(self.names).encode()
        )

    @classmethod
    def unpacked(cls, blob: bytes) -> Sequence:
        ids, words, langs, names = blocks.unbundle(blob)
        langs = blocks.unpack(langs, np.int32)
        return cls(blocks.unpack(ids, np.int32), words.split(b"\n") if len(langs) else [], langs, names.decode().split("\0"))


def _without_double_breaks(ids: np.ndarray) -> np.ndarray:
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    return ids[keep]


def _order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the next ``depth`` symbols, by doubling their ranks; the end meets the start."""
    rank, have = ids.astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        key = rank * (rank.max() + 1) + np.roll(rank, -step)
        rank, have = np.unique(key, return_inverse=True)[1].reshape(-1), have + step
    return np.argsort(rank, kind="stable")


class Index:
    """BWT of a sequence with the number of occurrences of a symbol before a place."""

    def __init__(self, ids: np.ndarray, depth: int, symbols: int) -> None:
        self.order = _order(ids, depth)
        self.bwt = ids[self.order - 1].astype(np.int64)
        self.symbols, self.size = symbols, len(ids)
        counts = np.bincount(ids, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        places = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[places] * self.size + places

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the positions with ``symbol`` in front, of those before ``place``, end in the order."""
        return np.searchsorted(self.keys, symbol * self.size + place)

    def gathered(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols in front of all positions of the intervals, interval after interval."""
        shift = low - (np.cumsum(size) - size)
        return self.bwt[np.arange(int(size.sum())) + np.repeat(shift, size)]

    def single(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The one symbol in front of all positions of each interval, 0 if there are several."""
        if not len(low):
            return np.zeros(0, np.int64)
        symbols, starts = self.gathered(low, size), np.cumsum(size) - size
        least = np.minimum.reduceat(symbols, starts)
        return np.where(least == np.maximum.reduceat(symbols, starts), least, 0)


class Bidirectional:
    """Intervals of phrases in the index of a sequence and, if wanted, in that of the reversed one."""

    def __init__(self, ids: np.ndarray, symbols: int, depth: int = DEPTH, both: bool = True) -> None:
        self.ids, self.symbols = ids, symbols
        self.ahead = Index(ids, depth, symbols)
        self.behind = Index(ids[::-1], depth, symbols) if both else None
        size = np.bincount(ids, minlength=symbols)
        word = np.flatnonzero(size[1:]) + 1
        self.level = (self.ahead.first[word], size[word], self.ahead.first[word])
        self.words = 1

    def extend(self) -> None:
        """To all phrases one word longer, by the words in front of those of this level."""
        low, size, twin = self.level
        symbols = self.ahead.gathered(low, size)
        owner = np.repeat(np.arange(len(low)), size)
        found, counts = np.unique(owner * self.symbols + symbols, return_counts=True)
        owner, symbol = np.divmod(found, self.symbols)
        smaller = np.cumsum(counts) - counts - (np.cumsum(size) - size)[owner]
        keep = symbol > 0
        owner, symbol, counts, smaller = owner[keep], symbol[keep], counts[keep], smaller[keep]
        self.level = (self.ahead.step(symbol, low[owner]), counts, twin[owner] + smaller)
        self.words += 1

    def only(self, keep: np.ndarray) -> None:
        """Go on with some phrases of this level."""
        self.level = tuple(part[keep] for part in self.level)

    def starts(self) -> np.ndarray:
        """A place in the sequence where each phrase of this level stands."""
        return self.ahead.order[self.level[0]]

    def hashes(self, named: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hash of each phrase of this level from its words' hashes, in order."""
        start, sums = self.starts(), np.uint64(self.words + (salt << 8))
        for i, power in enumerate(powers(_STEP + 2 * salt, self.words)):
            sums = sums + named[self.ids[start + i]] * power
        return mixed(sums)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The one word before, and the one after, all occurrences of each phrase; else 0."""
        low, size, twin = self.level
        return self.ahead.single(low, size), self.behind.single(twin, size)


def _words(limit: int):
    """Texts → sequences, and the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks.cut(batches, limit):
            made = Sequence.of(table.column("text").to_pylist(), table.column("lang").to_pylist())
            row = {"block": [number], "data": [made.packed()], "sizes": [made.sizes()]}
            yield pa.RecordBatch.from_pydict(row, _MADE)

    return run


def _short(buckets: int, filtered: int):
    """How often each phrase of up to ``filtered`` words occurs in a shard, by 40-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = Sequence.unpacked(row["data"])
                named = made.hashes()
                index = Bidirectional(made.ids, len(made.words) + 1, filtered, both=False)
                tokens, counts = [], []
                while True:
                    tokens.append(index.hashes(named) & _KEPT)
                    counts.append(index.level[1])
                    if index.words == filtered:
                        break
                    index.extend()
                tokens, place = np.unique(np.concatenate(tokens), return_inverse=True)
                counts = np.bincount(place.reshape(-1), np.concatenate(counts), len(tokens)).astype(np.uint32)
                parts = [
                    {"bucket": b, "blob": blocks.bundle(blocks.pack_sorted(tokens[s] >> np.uint64(24)), blocks.pack(counts[s]))}
                    for b, s in (blocks.split_by_bucket(tokens, buckets) if len(tokens) else [])
                ]
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "places": [None], "parts": [parts]}, _SENT)

    return run


def _frequent(least: int):
    """Of each block's tokens those with at least ``least`` occurrences over all blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sent = [blocks.unbundle(blob) for blob in group["blob"]]
        tokens = [blocks.unpack_sorted(s[0], np.uint64) for s in sent]
        counts = np.concatenate([blocks.unpack(s[1], np.uint32) for s in sent])
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=every[order[:1]] + np.uint64(1)))
        enough = np.add.reduceat(counts[order].astype(np.int64), first) >= least
        alive = np.empty(len(every), bool)
        alive[order] = np.repeat(enough, np.diff(np.append(first, len(every))))
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        blobs = [blocks.pack_sorted(t[alive[e - len(t) : e]]) for t, e in zip(tokens, ends, strict=True)]
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "blob": blobs})

    return run


def _long(buckets: int, filtered: int, depth: int):
    """All phrases of a shard that the filter leaves, with counts and neighbours, by 80-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = Sequence.unpacked(row["data"])
                found = [blocks.unpack_sorted(blob, np.uint64) for _, blob in blocks.by_bucket(row["answers"])]
                alive = np.concatenate([np.zeros(0, np.uint64), *found]) << np.uint64(24)
                yield _sent(row["block"], made, alive, buckets, filtered, depth)

    return run


def _sent(block: int, made: Sequence, alive: np.ndarray, buckets: int, filtered: int, depth: int) -> pa.RecordBatch:
    named = made.hashes()
    index = Bidirectional(made.ids, len(made.words) + 1, depth)
    whole = np.zeros(len(made.ids), bool)  # where a phrase of ``filtered`` words that goes on stands
    columns = []
    while True:
        if index.words <= filtered:
            index.only(np.isin(index.hashes(named) & _KEPT, alive))
            if index.words == filtered:
                low, size, _ = index.level
                shift = low - (np.cumsum(size) - size)
                whole[index.ahead.order[np.arange(int(size.sum())) + np.repeat(shift, size)]] = True
        else:
            index.only(whole[index.starts()])
        before, after = index.neighbours()
        columns.append(
            (
                index.hashes(named) & _LONG, (index.hashes(named, 1) >> np.uint64(32)).astype(np.uint32),
                index.level[1].astype(np.uint32), (before > 0).astype(np.uint8) + 2 * (after > 0).astype(np.uint8),
                index.starts().astype(np.uint32), np.full(len(before), index.words, np.uint8),
            )
        )
        if index.words == depth or not len(before):
            break
        index.extend()
    token, check, counts, sides, starts, words = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.lexsort((check, token))
    token, check, counts, sides = token[order], check[order], counts[order], sides[order]
    split = blocks.split_by_bucket(token, buckets) if len(token) else []
    parts = [
        {
            "bucket": b,
            "blob": blocks.bundle(
                blocks.pack_sorted(token[s] >> np.uint64(16)), blocks.pack(check[s]), blocks.pack(counts[s]), blocks.pack(sides[s])
            ),
        }
        for b, s in split
    ]
    held = np.array([(b, s.stop - s.start) for b, s in split], np.int64).reshape(-1)
    places = blocks.bundle(blocks.pack(starts[order]), blocks.pack(words[order]), blocks.pack(held))
    return pa.RecordBatch.from_pydict({"block": [block], "places": [places], "parts": [parts]}, _SENT)


def _summed(least: int):
    """Frequent phrases of a bucket: to the first block that holds one, its place there, its count
    and whether no longer phrase can be as frequent."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", kind="stable")
        sent = [blocks.unbundle(blob) for blob in group["blob"]]
        tokens = [blocks.unpack_sorted(s[0], np.uint64) for s in sent]
        sizes = np.array([len(t) for t in tokens])
        token = np.concatenate(tokens)
        check = np.concatenate([blocks.unpack(s[1], np.uint32) for s in sent])
        counts = np.concatenate([blocks.unpack(s[2], np.uint32) for s in sent]).astype(np.int64)
        sides = np.concatenate([blocks.unpack(s[3], np.uint8) for s in sent])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((check, token))  # stable: the first block's entry comes first
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(token[order]) != 0) | (np.diff(check[order]) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        single = np.bitwise_and.reduceat(sides[order], first)
        enough = total >= least
        at, total, alone = order[first[enough]], total[enough], (single[enough] == 0).astype(np.uint8)
        out = []
        for i in np.unique(owner[at]).tolist():
            own = np.flatnonzero(owner[at] == i)
            blob = blocks.bundle(
                blocks.pack(place[at[own]].astype(np.uint32)), blocks.pack(total[own]), blocks.pack(alone[own])
            )
            out.append((group["block"].iloc[i], group["bucket"].iloc[i], blob))
        return pd.DataFrame(out, columns=["block", "bucket", "blob"])

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the frequent phrases that a block was asked for."""
    for batch in batches:
        for row in batch.to_pylist():
            made = Sequence.unpacked(row["data"])
            starts, words, held = blocks.unbundle(row["places"])
            starts, words = blocks.unpack(starts, np.uint32).astype(np.int64), blocks.unpack(words, np.uint8)
            held = blocks.unpack(held, np.int64).reshape(-1, 2)
            shift = dict(zip(held[:, 0].tolist(), (np.cumsum(held[:, 1]) - held[:, 1]).tolist(), strict=True))
            found = [(bucket, blocks.unbundle(blob)) for bucket, blob in blocks.by_bucket(row["answers"])]
            at = np.concatenate([blocks.unpack(b[0], np.uint32).astype(np.int64) + shift[k] for k, b in found])
            total = np.concatenate([blocks.unpack(b[1], np.int64) for _, b in found])
            alone = np.concatenate([blocks.unpack(b[2], np.uint8) for _, b in found])
            known = pa.array([None, *[w.decode() for w in made.words]], pa.string())
            langs = pa.array(made.names, pa.string())
            for count in np.unique(words[at]).tolist():
                own = np.flatnonzero(words[at] == count)
                ids = [made.ids[starts[at[own]] + i] for i in range(count)]
                table = pa.table(
                    [
                        langs.take(pa.array(made.langs[ids[0] - 1])),
                        pc.binary_join_element_wise(*[known.take(pa.array(c)) for c in ids], " "),
                        pa.array(np.full(len(own), count, np.int32)),
                        pa.array(total[own]),
                        pa.array(alone[own] > 0),
                    ],
                    schema=_COUNTED,
                )
                yield from table.to_batches(max_chunksize=50_000)


def counted(
    docs: DataFrame, least: int = LEAST, depth: int = DEPTH, limit: int = blocks.BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n, alone`` of phrases of up to ``depth`` words that occur at least
    ``least`` times in texts of their language, and ``lang, n`` words of each language.

    A phrase is ``alone`` if it is known that no phrase one word longer is as frequent.
    """
    buckets, filtered = blocks.bucket_count(docs), min(FILTERED, depth)
    sent = f"block long, places binary, parts array<{blocks.PART}>"
    texts = blocks.store(
        docs.select("text", "lang").mapInArrow(_words(limit), f"block long, data binary, sizes {_SIZES}"), "phrase-words"
    )
    data = texts.select("block", "data")
    answers = blocks.exchange(data.mapInArrow(_short(buckets, filtered), sent), _frequent(least))
    joined = blocks.with_answers(data, answers)
    made = blocks.store(joined.mapInArrow(_long(buckets, filtered, depth), sent), "phrase-counts")
    answers = blocks.exchange(made.select("block", "parts"), _summed(least))
    told = data.join(made.select("block", "places"), "block").join(answers, "block")
    counts = told.mapInArrow(_told, "lang string, phrase string, words int, n long, alone boolean")
    sizes = texts.select(F.explode("sizes").alias("s")).groupBy("s.lang").agg(F.sum("s.n").alias("n"))
    return stored(counts, "phrases"), sizes


def candidates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Phrases of two words or more that stand in no longer counted one as frequent as they are.

    One word longer is enough: of the phrases between the two, each is as frequent as both.
    """
    longer = counts.filter("words > 2").select("lang", F.col("n").alias("_n"), F.split("phrase", " ").alias("_w"))
    parts = F.array(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1))
    inner = longer.select("lang", "_n", F.explode(parts).alias("_p"))
    inner = inner.select("lang", F.array_join("_p", " ").alias("phrase"), "_n")
    inner = inner.groupBy("lang", "phrase").agg(F.max("_n").alias("_n"))
    wanted = counts.filter("words > 1")
    open_ = wanted.filter((F.col("words") < depth) & ~F.col("alone")).join(inner, ["lang", "phrase"], "left")
    kept = open_.filter(F.coalesce(F.col("_n") < F.col("n"), F.lit(True))).drop("_n")
    return wanted.filter((F.col("words") == depth) | F.col("alone")).unionByName(kept)


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, limit: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of each language."""
    counts, sizes = counted(docs, least, depth, limit)
    cuts = (
        candidates(counts, depth)
        .select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("_k"))
        .select(
            "lang", "phrase", "a", "_k",
            F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " ").alias("_l"),
            F.array_join(F.slice("_w", F.col("_k") + 1, F.size("_w")), " ").alias("_r"),
        )
    )
    part = lambda to, name: counts.select("lang", F.col("phrase").alias(to), F.col("n").alias(name))
    # One row per language.
    scored = (
        cuts.join(part("_l", "l"), ["lang", "_l"]).join(part("_r", "r"), ["lang", "_r"]).join(sizes, "lang")
        .withColumn("score", F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)"))
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "a", "l", "r", "n")).alias("s"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        lowest.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(least: int = LEAST, depth: int = DEPTH, top: int = TOP) -> str:
    return rf"""
with d as (select coalesce(lang, '{UNKNOWN}') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from d),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest(range(1, {depth} + 1)) k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) a from g group by all having count(*) >= {least}),
n as (select lang, sum(len(w)) n from w group by lang),
s as (select lang, k, phrase, a, string_split(phrase, ' ') p from f),
e as (select distinct lang, sub from (
  select lang, a, k, unnest([array_to_string(p[1:k - 1], ' '), array_to_string(p[2:k], ' ')]) sub from s where k > 1) x
  where exists (select 1 from f where f.lang = x.lang and f.phrase = x.sub and f.k = x.k - 1 and x.a >= f.a)),
c as (select s.* from s where k > 1 and not exists (select 1 from e where e.lang = s.lang and e.sub = s.phrase)),
u as (select lang, phrase, a, unnest(range(1, k)) j, p, k from c),
v as (select u.lang, u.phrase, u.a, j, l.a l, r.a r, n.n, (1000::hugeint * u.a * n.n) // (l.a::hugeint * r.a) score
  from u join f l on l.lang = u.lang and l.k = j and l.phrase = array_to_string(p[1:j], ' ')
  join f r on r.lang = u.lang and r.k = u.k - j and r.phrase = array_to_string(p[j + 1:], ' ')
  join n on n.lang = u.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, j) o from v)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase,
    a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from b where o = 1)
where rank <= {top}
"""
