"""N-gram Jaccard join by a token-group matrix.

1. *Sets.* Blocks of documents make the distinct five-word shingles of each text and one class
   for each distinct set. Shingles meet in an exchange (see ``blocks``) that counts the classes
   that hold each; one that a single class holds can be in no intersection. A class can link only
   if 80 % of its shingles are shared, which leaves the copies and near copies.
2. *Groups.* Classes with a common least hash (four hash functions) are compared with one
   leader, first the class whose shingles most classes hold, then in turn others by hash, unless
   they are connected already; connected ones form a group. A large group of near copies is thus
   compared a few times per member and no pairs within it are made.
3. *Matrix.* For each group the union of its members' prefix shingles is stored, rarest first:
   two classes that link share one (see ``_prefixes``). Groups that share one and fit in size are
   candidates; first the larger one's leader is compared with the smaller one's members.
4. *Open.* For those not connected by then, a query class's overlap with the whole union of the
   other group's shingles bounds its overlap with any member; only groups that reach 80 % are
   opened and their members with a common prefix shingle compared.

Links decide nothing but components, so links inside a group need not be found; none between
different components is lost. Shingles are told apart by 48-bit hashes, sets by 128 bits: two texts
of 1,000 shingles have a false common one once in 500 million pairs.

Defined results: a text with one to four words has one shingle, its whole sequence; NULL, empty and
blank texts have none and form a component each; a NULL ``doc_id`` takes part, but is nobody's
``component_id`` (a component of such rows alone has NULL); repeated rows are documents of one
class; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import blocks
from webstrata.llm.common import stored
from webstrata.llm.components import components
from webstrata.llm.substrings import WordHashes, mixed, powers
from webstrata.operators.checkpoints import fresh_folder

SHINGLE = 5
PERCENT = 80
KEYS = 4
#: How often the classes of a key are compared with a leader before groups are formed.
TURNS = 3
#: Shingle hashes keep their upper 48 bits, as differences of sorted ones then pack to 3.5 bytes.
KEPT_BITS = np.uint64(((1 << 48) - 1) << 16)
_STEP = 0x9E3779B97F4A7C15
_PARTS = pa.list_(pa.struct({"bucket": pa.int32(), "blob": pa.binary()}))


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a text's word hashes, ascending."""
    if not len(words):
        return np.zeros(0, np.uint64)
    length = min(SHINGLE, len(words))
    power = powers(_STEP, length)
    sums = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        sums += words[i : len(words) - length + 1 + i] * power[i]
    return np.unique(mixed(sums + np.uint64(length)) & KEPT_BITS)


def _to_blocks(buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks.cut(batches, limit):
            hashes = WordHashes()
            local: dict[bytes, int] = {}
            sets, names, sizes, docs = [], [], [], []
            for text in table.column("text"):
                words = (text.as_py() or "").encode().lower().split()
                own = shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                name = xxhash.xxh3_128_hexdigest(own.tobytes())
                docs.append((name, len(own)))
                if len(own) and name not in local:
                    local[name] = len(names)
                    sets.append(own)
                    names.append(name)
                    sizes.append(len(own))
            sizes = np.array(sizes, np.int64)
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)[order]
            first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
            counts = np.diff(np.append(first, len(tokens))).astype(np.uint32)
            tokens = tokens[first]
            places = blocks.split_by_bucket(tokens, buckets) if len(tokens) else []
            parts = [
                {"bucket": b, "blob": blocks.bundle(blocks.pack_sorted(tokens[s] >> np.uint64(16)), blocks.pack(counts[s]))}
                for b, s in places
            ]
            held = np.array([[b, s.stop - s.start] for b, s in places], np.int64).reshape(-1)
            data = blocks.bundle(
                blocks.pack(owner), blocks.pack(counts), blocks.pack(held), blocks.pack(sizes),
                "\n".join(names).encode(),
            )
            row = {
                "block": [number], "data": [data], "parts": [parts],
                "docs": [[{"doc_id": i, "cls": c, "n": n} for i, (c, n) in zip(table.column("doc_id").to_pylist(), docs, strict=True)]],
            }
            yield pa.RecordBatch.from_pydict(row, _schema(table.schema.field("doc_id").type))

    return run


def _schema(key: pa.DataType) -> pa.Schema:
    docs = pa.list_(pa.struct({"doc_id": key, "cls": pa.string(), "n": pa.int64()}))
    return pa.schema({"block": pa.int64(), "data": pa.binary(), "parts": _PARTS, "docs": docs})


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's shingles that two classes hold: their places, numbers and counts."""
    sent = [blocks.unbundle(blob) for blob in group["blob"]]
    tokens = [blocks.unpack_sorted(s[0], np.uint64) for s in sent]
    counts = [blocks.unpack(s[1], np.uint32) for s in sent]
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)))
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
    named = ordered[first]
    shared = total >= 2
    number = np.cumsum(shared) - 1
    out = []
    for block, bucket, own in zip(group["block"], group["bucket"], tokens, strict=True):
        at = np.searchsorted(named, own)
        keep = np.flatnonzero(shared[at])
        if len(keep):
            at = at[keep]
            blob = blocks.bundle(
                blocks.pack_sorted(keep.astype(np.uint32)),
                blocks.pack_sorted(number[at].astype(np.uint32)),
                blocks.pack(total[at].astype(np.uint32)),
            )
            out.append((block, bucket, blob))
    return pd.DataFrame(out, columns=["block", "bucket", "blob"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of a block of which enough shingles are shared, rarest shingles first."""
    for batch in batches:
        for row in range(batch.num_rows):
            owner, counts, held, sizes, names = blocks.unbundle(batch.column("data")[row].as_py())
            owner, counts = blocks.unpack(owner, np.uint32), blocks.unpack(counts, np.uint32)
            held, sizes = blocks.unpack(held, np.int64).reshape(-1, 2), blocks.unpack(sizes, np.int64)
            start = dict(zip(held[:, 0].tolist(), (np.cumsum(held[:, 1]) - held[:, 1]).tolist()))
            number = np.full(len(counts), -1, np.int64)
            times = np.zeros(len(counts), np.int64)
            for bucket, blob in blocks.by_bucket(batch.column("answers")[row].as_py()):
                place, rank, total = blocks.unbundle(blob)
                place = blocks.unpack_sorted(place, np.uint32).astype(np.int64) + start[bucket]
                number[place] = (bucket << 40) + blocks.unpack_sorted(rank, np.uint32).astype(np.int64)
                times[place] = blocks.unpack(total, np.uint32)
            number, times = np.repeat(number, counts), np.repeat(times, counts)
            some = number >= 0
            owner, number, times = owner[some], number[some], times[some]
            order = np.lexsort((number, times, owner))
            owner, number, times = owner[order], number[order], times[order]
            found = np.bincount(owner, minlength=len(sizes))
            ends = np.cumsum(found)
            names = names.decode().split("\n")
            out = {"cls": [], "n": [], "toks": [], "weight": [], "keys": []}
            for c in np.flatnonzero(100 * found >= PERCENT * np.maximum(sizes, 1)).tolist():
                own = slice(ends[c] - found[c], ends[c])
                tokens = number[own]
                out["cls"].append(names[c])
                out["n"].append(int(sizes[c]))
                out["toks"].append(tokens)
                out["weight"].append(int(times[own].sum() // sizes[c]))
                out["keys"].append([int((mixed(tokens.view(np.uint64) + np.uint64(_STEP * (k + 1) % 2**64)) >> np.uint64(1)).min()) for k in range(KEYS)])
            yield pa.RecordBatch.from_pydict(out, _CLASSES)


_CLASSES = pa.schema(
    {
        "cls": pa.string(),
        "n": pa.int64(),
        "toks": pa.list_(pa.int64()),
        "weight": pa.int64(),
        "keys": pa.list_(pa.int64()),
    }
)


def _linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes that link."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("toks").alias("t_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("toks").alias("t_b"))
    size = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    link = 100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)
    return pairs.join(left, "a").join(right, "b").filter(size).filter(link).select("a", "b")


def link_classes(classes: DataFrame) -> DataFrame:
    """``cls, root`` of the stored candidate classes: equal roots are one component."""
    keyed = stored(classes.select("cls", "weight", F.posexplode("keys").alias("slot", "key")), "keys")
    links, roots = None, classes.select("cls", F.col("cls").alias("root"))
    for turn in range(TURNS):
        rank = F.xxhash64("cls", "slot", F.lit(turn)) if turn else F.col("weight")
        strongest = F.max(F.struct(rank.alias("rank"), "cls")).alias("lead")
        leaders = keyed.groupBy("slot", "key").agg(strongest, F.count(F.lit(1)).alias("held"))
        leaders = leaders.filter("held > 1").select("slot", "key", F.col("lead.cls").alias("b"))
        stars = keyed.join(leaders, ["slot", "key"]).filter("cls <> b")
        stars = stars.select(F.col("cls").alias("a"), "b").distinct()
        apart = stars.join(roots.select(F.col("cls").alias("a"), F.col("root").alias("r")), "a").join(
            roots.select(F.col("cls").alias("b"), F.col("root").alias("q")), "b"
        )
        found = _linked(apart.filter("r <> q").select("a", "b"), classes)
        links = stored(found if links is None else links.union(found), "stars")
        roots = _with_root(classes.select("cls"), links)
    grouped = stored(classes.drop("keys").join(roots, "cls"), "grouped")

    prefix = _prefixes(grouped)
    sides = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach")]
    matrix = prefix.groupBy("tok", "root").agg(*sides)
    one = matrix.select("tok", *[F.col(c).alias(f"{c}_g") for c in ("root", "lo", "hi", "reach")])
    two = matrix.select("tok", *[F.col(c).alias(f"{c}_h") for c in ("root", "lo", "hi", "reach")])
    fits = F.expr(
        f"root_g < root_h and lo_h <= reach_g and lo_g <= reach_h"
        f" and 100 * hi_g >= {PERCENT} * lo_h and 100 * hi_h >= {PERCENT} * lo_g"
    )
    groups = one.join(two, "tok").filter(fits).select(F.col("root_g").alias("g"), F.col("root_h").alias("h"))
    groups = stored(groups.distinct(), "groups")

    # The smaller group of a pair queries the other one: first its leader, then, if need be, all.
    sizes = grouped.groupBy("root").agg(
        F.count(F.lit(1)).alias("members"), F.max(F.struct("weight", "cls"))["cls"].alias("lead")
    )
    sizes = stored(sizes, "group-sizes")
    left = sizes.select(F.col("root").alias("g"), F.col("members").alias("m_g"), F.col("lead").alias("l_g"))
    right = sizes.select(F.col("root").alias("h"), F.col("members").alias("m_h"), F.col("lead").alias("l_h"))
    swap = F.col("m_g") > F.col("m_h")
    asked = groups.join(left, "g").join(right, "h").select(
        F.when(swap, F.col("h")).otherwise(F.col("g")).alias("root"),
        F.when(swap, F.col("g")).otherwise(F.col("h")).alias("target"),
        F.when(swap, F.col("l_g")).otherwise(F.col("l_h")).alias("b"),
        F.greatest("m_g", "m_h").alias("members"),
    )
    asked = stored(asked, "asked")
    members = grouped.select("root", F.col("cls").alias("a"), F.col("n").alias("n_a"))
    first = asked.join(members, "root").select("a", "b", "root", "target")
    links = links.union(_linked(first.select("a", "b").distinct(), classes))
    links = stored(links, "led")
    again = _with_root(classes.select("cls"), links)

    root = again.select(F.col("cls"), F.col("root").alias("now"))
    there = root.select(F.col("cls").alias("target"), F.col("now").alias("there"))
    unlinked = asked.join(root.select(F.col("cls").alias("root"), "now"), "root").join(there, "target")
    # A group of one class has been compared whole.
    unlinked = unlinked.filter("now <> there and members > 1").select("root", "target")
    unlinked = stored(unlinked, "unlinked")
    asked_of = grouped.join(unlinked.select(F.col("target").alias("root")).distinct(), "root", "left_semi")
    union = asked_of.select(F.col("root").alias("target"), F.explode("toks").alias("tok")).distinct()
    queries = grouped.join(unlinked, "root").select("cls", "n", "target", F.explode("toks").alias("tok"))
    bound = queries.join(union, ["target", "tok"]).groupBy("cls", "n", "target").agg(F.count(F.lit(1)).alias("held"))
    opened = bound.filter(100 * F.col("held") >= PERCENT * F.col("n")).select(F.col("cls").alias("a"), "target")
    opened = stored(opened, "opened")
    ask = prefix.select("tok", *[F.col(c).alias(d) for c, d in (("cls", "a"), ("n", "n_a"), ("reach", "r_a"))])
    held = prefix.select(
        "tok", *[F.col(c).alias(d) for c, d in (("root", "target"), ("cls", "b"), ("n", "n_b"), ("reach", "r_b"))]
    )
    meet = F.expr("n_b <= r_a and n_a <= r_b")
    pairs = ask.join(opened, "a").join(held, ["target", "tok"]).filter(meet).select("a", "b").distinct()
    links = stored(links.union(_linked(pairs, classes)), "all-links")
    return _with_root(classes.select("cls"), links)


def _prefixes(grouped: DataFrame) -> DataFrame:
    """``cls, n, root, tok, reach``: prefix shingles of each class, rarest first.

    A pair that links shares ``c = ceil(0.8 (n + m) / 1.8)`` shingles, so one of the first
    ``n - c + 1`` of the one is among the first ``m - c + 1`` of the other. ``reach`` is the largest
    ``m`` for which a shingle is among them; rows whose reach is below ``0.8 n`` are left out.
    """
    at = F.expr("n - size(toks)") + F.col("at")  # before it; those of this class only come first
    whole = 100 + PERCENT
    reach = F.floor((whole * (F.col("n") - at) - PERCENT * F.col("n")) / PERCENT)
    rows = grouped.select("cls", "n", "root", "toks", F.posexplode("toks").alias("at", "tok"))
    rows = rows.select("cls", "n", "root", "tok", reach.alias("reach"))
    return rows.filter(100 * F.col("reach") >= PERCENT * F.col("n"))


def _with_root(classes: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).withColumnRenamed("node", "cls").withColumnRenamed("root", "_root")
    found = classes.join(roots, "cls", "left")
    return stored(found.withColumn("root", F.coalesce("_root", "cls")).drop("_root"), "rooted")


def join(docs: DataFrame, limit: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    made = docs.mapInArrow(
        _to_blocks(blocks.bucket_count(docs), limit),
        f"block long, data binary, parts array<{blocks.PART}>, "
        f"docs array<struct<doc_id:{kind},cls:string,n:long>>",
    )
    folder = fresh_folder(docs.sparkSession, "shingles")
    kept = blocks.store_at(made, folder)
    narrow = kept.select(F.explode("docs").alias("d")).select("d.doc_id", "d.cls", F.col("d.n").alias("n_shingles"))
    narrow = stored(narrow, "documents")
    answers = blocks.exchange(kept.select("block", "parts"), _shared)
    found = blocks.with_answers(kept.select("block", "data"), answers.filter("answers is not null"))
    classes = found.mapInArrow(
        _candidates, "cls string, n long, toks array<long>, weight long, keys array<long>"
    )
    classes = classes.groupBy("cls").agg(
        *[F.first(c).alias(c) for c in ("n", "toks", "weight", "keys")]
    )
    classes = stored(classes, "classes")
    blocks.remove(docs.sparkSession, folder)  # documents and candidate classes are all that is needed
    roots = link_classes(classes)
    least = narrow.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(component, "root").select("cls", "component_id"), "named")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    # Documents without shingles have no partner: a key of their own keeps them apart.
    key = F.when(F.col("n_shingles") > 0, F.col("cls")).otherwise(F.col("doc_id").cast("string"))
    return narrow.withColumn("cls", key).join(named, "cls", "left").select(
        "doc_id", "n_shingles", own.alias("component_id")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) || least(len(w), 5) s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b using (s) where a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 80 * (a.n + b.n - c)),
r as (select doc_id d, doc_id m from n union select l.y, r.m from r join l on l.x = r.d),
m as (select d, min(m) m from r group by d)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.m, doc_id) component_id
from w left join n using (doc_id) left join m on m.d = doc_id
"""
