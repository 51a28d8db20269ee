"""Conversation prefix trie: a double-array trie for each shard of prefixes, merged at its edges.

1. *Paths.* A turn is a token: the first 128 bits of the SHA-256 of its role and text, then the bytes of
   its text. A conversation is a path, the tokens of its turns one after the other, so paths sort as
   the trie does. Equal paths are one row with their members, which are dealt by (path, range of
   ids), so that many copies of one conversation are spread before they meet as packed lists.
2. *Shards.* Paths are dealt by ranges and cut into shards of ``SHARD_BYTES``. A shard numbers its
   distinct turns, packs BASE and CHECK arrays over these numbers, and walks them with all its paths
   at once; the slots passed are its nodes. A list of members is hashed as it streams by.
3. *Edges.* Only nodes on the first or the last path of a shard can lie in other shards too. All others
   are whole and final. The edge nodes of all shards meet by a running hash of their path; what
   they add to the nodes above them flows up along the shard that owns them. The work is linear in
   the lengths of two paths a shard.

Defined results: rows of NULL ``conv_id`` belong to no conversation; NULL role or text are empty; turns
of one number are ordered by the hash of role and text; a row given twice is two turns; a remainder
has the sign of its id; an empty table gives no node, not even a root; a text of any length is one
token, and one conversation's tokens must fit in a row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import join_lookup, stored

GROUP = 5
KEPT = 9
#: A token: 16 bytes of hash and 4 of the text's length.
TOKEN = 20
SHARD_BYTES = 4 << 20
#: Ids of one path that agree but for so many bits meet before the lists of a path do.
ID_BITS = 12
#: Places tried for the children of a node before the end of the array is taken.
TRIES = 24
NO_MEMBER = hashlib.sha256(b"").hexdigest()
_INNER, _BELOW_EDGE, _EDGE = 0, 1, 2
_MADE = pa.schema(
    {
        "kind": pa.int32(),
        "shard": pa.int64(),
        "chain": pa.int32(),
        "fork": pa.int64(),
        "key": pa.binary(),
        "up": pa.binary(),
        "bytes": pa.int64(),
        "conv_id": pa.int64(),
        "depth": pa.int64(),
        "parent_conv_id": pa.int64(),
        "n_convs": pa.int64(),
        "n_children": pa.int64(),
        "n_leaves": pa.int64(),
        "saved_tokens": pa.int64(),
        "ends_sha256": pa.string(),
    }
)


class DoubleArray:
    """Trie of ascending paths of codes: the child of slot ``s`` by code ``c`` is ``base[s] + c``,
    and ``check`` of that slot is ``s``. Slot 0 is the root."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        self.codes, self.lengths = codes, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        self.size, self.free = 1, 1
        self._pack()

    def _pack(self) -> None:
        at = np.zeros(len(self.lengths), np.int64)
        for depth in range(int(self.lengths.max(initial=0))):
            rows = np.flatnonzero(self.lengths > depth)
            code, slot = self.codes[self.starts[rows] + depth], at[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (code[1:] != code[:-1]) | (slot[1:] != slot[:-1])
            children, parents = code[new], slot[new]
            edges = np.flatnonzero(np.diff(parents, prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(parents)], strict=True):
                self._place(int(parents[a]), children[a:b])
            at[rows] = self.base[slot] + code

    def _place(self, parent: int, children: np.ndarray) -> None:
        first, last = int(children[0]), int(children[-1])
        while self.free < self.size and self.check[self.free] >= 0:
            self.free += 1
        slot = self.free
        for _ in range(TRIES):
            if slot >= self.size:
                break
            if self.check[slot] < 0:
                wanted = children + (slot - first)
                if (self.check[wanted[wanted < self.size]] < 0).all():
                    break
            slot += 1
        else:
            slot = self.size
        need = slot + last - first + 1
        if need > len(self.check):
            more = max(need, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
        self.size = max(self.size, need)
        self.base[parent] = slot - first
        self.check[children + (slot - first)] = parent

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth from 0: the paths that reach it and the slots they are in."""
        at = np.zeros(len(self.lengths), np.int64)
        yield 0, np.arange(len(at)), at.copy()
        for depth in range(int(self.lengths.max(initial=0))):
            rows = np.flatnonzero(self.lengths > depth)
            slot = self.base[at[rows]] + self.codes[self.starts[rows] + depth]
            if not np.array_equal(self.check[slot], at[rows]):
                raise AssertionError("a path left the trie")
            at[rows] = slot
            yield depth + 1, rows, slot


def _chain(path: bytes) -> list[bytes]:
    """Running hash of a path at every depth."""
    keys = [bytes(16)]
    for i in range(0, len(path), TOKEN):
        keys.append(hashlib.blake2b(keys[-1] + path[i : i + TOKEN], digest_size=16).digest())
    return keys


def _shard(number: int, paths: list[bytes], counts: list[int], least: list[int], ends: list[str]) -> pa.Table:
    """Nodes of a shard: whole ones, whole ones below an edge node, and parts of edge nodes."""
    tokens = np.frombuffer(b"".join(paths), f"S{TOKEN}")
    names, codes = np.unique(tokens, return_inverse=True)
    sizes = np.frombuffer(names.tobytes(), np.uint8).reshape(-1, TOKEN)[:, 16:].astype(np.int64) @ (256 ** np.arange(3, -1, -1))
    lengths = np.array([len(p) // TOKEN for p in paths], np.int64)
    codes = codes.reshape(-1).astype(np.int64) + 1
    trie = DoubleArray(codes, lengths)
    counts, least = np.array(counts, np.int64), np.array(least, np.int64)
    n_convs, smallest = np.zeros(trie.size, np.int64), np.full(trie.size, np.iinfo(np.int64).max)
    depths, size, end = np.full(trie.size, -1), np.zeros(trie.size, np.int64), np.full(trie.size, -1)
    edge = np.zeros(trie.size, np.int64)  # 1 on the first path, 2 only on the last
    for depth, rows, slots in trie.walk():
        np.add.at(n_convs, slots, counts[rows])
        np.minimum.at(smallest, slots, least[rows])
        depths[slots] = depth
        if depth:
            size[slots] = sizes[codes[trie.starts[rows] + depth - 1] - 1]
        done = lengths[rows] == depth
        end[slots[done]] = rows[done]
        if rows[-1] == len(paths) - 1:
            edge[slots[-1]] = 2
        if rows[0] == 0:
            edge[slots[0]] = 1
    used = np.flatnonzero(depths >= 0)
    used = used[np.argsort(depths[used], kind="stable")]
    parent = trie.check[: trie.size]
    n_children = np.bincount(parent[used[1:]], minlength=trie.size)
    inner = edge == 0
    whole_children = np.bincount(parent[used[inner[used]]], minlength=trie.size)
    leaves = np.where(inner & (n_children == 0), 1, 0)
    saved = np.where(inner, (n_convs - 1) * size, 0)
    borders = np.flatnonzero(np.diff(depths[used], prepend=-1))
    for a, b in reversed(list(zip(borders.tolist(), [*borders[1:].tolist(), len(used)], strict=True))):
        level = used[a:b][inner[used[a:b]]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    key = np.full(trie.size, None, object)
    fork = int(depths[edge == 1].max())
    if (edge == 2).any():
        fork = int(depths[edge == 2].min()) - 1
    for which, path in ((1, paths[0]), (2, paths[-1])):
        chain = _chain(path)
        for slot in np.flatnonzero(edge == which).tolist():
            key[slot] = chain[depths[slot]]
    up = np.full(trie.size, None, object)
    up[used[1:]] = key[parent[used[1:]]]
    is_edge = ~inner[used]
    kind = np.where(is_edge, _EDGE, np.where(edge[parent[used]] > 0, _BELOW_EDGE, _INNER))
    shown = [ends[e] if e >= 0 else NO_MEMBER for e in end[used].tolist()]
    columns = [
        kind.astype(np.int32),
        np.full(len(used), number, np.int64),
        np.where(edge[used] == 2, 1, 0).astype(np.int32),
        np.full(len(used), fork, np.int64),
        pa.array(key[used], pa.binary()),
        pa.array(up[used], pa.binary()),
        size[used],
        smallest[used],
        depths[used].astype(np.int64),
        pa.array(smallest[parent[used]], pa.int64(), mask=kind != _INNER),
        n_convs[used],
        np.where(is_edge, whole_children[used], n_children[used]),
        leaves[used].astype(np.int64),
        saved[used],
        pa.array(shown, pa.string()),
    ]
    return pa.table([pa.array(c) for c in columns], schema=_MADE)


def _shards(limit: int):
    """Sorted (path, list of members) → nodes, a shard after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        paths: list[bytes] = []
        counts: list[int] = []
        least: list[int] = []
        ends: list = []
        held = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "n", "least", "ids"))
            for path, n, first, ids in zip(*columns, strict=True):
                if paths and paths[-1] == path:
                    counts[-1] += n
                    least[-1] = min(least[-1], first)
                    ends[-1].update(b"," + ids.encode())
                    continue
                if held >= limit:
                    yield from _shard(number, paths, counts, least, [e.hexdigest() for e in ends]).to_batches(20_000)
                    paths, counts, least, ends, held = [], [], [], [], 0
                    number += 1
                paths.append(path)
                counts.append(n)
                least.append(first)
                ends.append(hashlib.sha256(ids.encode()))
                held += len(path) + TOKEN
        if paths:
            yield from _shard(number, paths, counts, least, [e.hexdigest() for e in ends]).to_batches(20_000)

    return run


def paths(turns: DataFrame, group: int = GROUP, kept: int = KEPT) -> DataFrame:
    """``conv_id, path`` of the rebuilt conversations, by one shuffle.

    A conversation ``c`` starts with the first turns of ``c - c % group``, as many as CRC-32 of ``c`` as text
    leaves by ``kept``, and goes on with its own turns behind that many.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")
    token = F.concat(F.substring(F.sha2(said, 256), 1, 32), size)
    width = 2 * TOKEN
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kept * width
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), token.alias("token"))
    own = (
        turns.filter("conv_id is not null")
        .select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("_g"), order.alias("_t"))
        .repartition("_g")
        .groupBy("_g", "conv_id")
        .agg(F.array_join(F.array_sort(F.collect_list("_t"))["token"], "").alias("_own"))
    )
    base = F.max(F.when(F.col("conv_id") == F.col("_g"), F.col("_own"))).over(Window.partitionBy("_g"))
    joined = F.concat(
        F.substring(F.coalesce("_base", F.lit("")), F.lit(1), F.col("_first")),
        F.substring("_own", F.col("_first") + 1, F.length("_own")),
    )
    return (
        own.withColumn("_base", base)
        .withColumn("_first", first.cast("int"))
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(joined).alias("path"))
    )


def nodes(members: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The trie of ``conv_id, path``: one row per node."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    gathered = stored(
        members.groupBy("path", F.shiftright("conv_id", ID_BITS).alias("_range")).agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
        ),
        "trie-paths",
    )
    dealt = gathered.repartitionByRange("path").sortWithinPartitions("path", "_range").drop("_range")
    fields = ", ".join(f"{f.name} {_kind(f.type)}" for f in _MADE)
    made = stored(dealt.mapInArrow(_shards(limit), fields), "trie-nodes")
    return _merged(made)


def _kind(kind: pa.DataType) -> str:
    return {"int32": "int", "int64": "long", "binary": "binary", "string": "string"}[str(kind)]


def _merged(made: DataFrame) -> DataFrame:
    """Whole nodes as they are, and the edge nodes of all shards put together."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = made.filter(F.col("kind") == _EDGE)
    place = F.struct("shard", "chain")
    ends = F.max(F.when(F.col("ends_sha256") != NO_MEMBER, F.col("ends_sha256")))
    whole = parts.groupBy("key").agg(
        F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"),
        F.min(place).alias("_owner"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("_inner"), F.coalesce(ends, F.lit(NO_MEMBER)).alias("ends_sha256"),
    )
    whole = stored(whole, "trie-edges")
    below = whole.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("_edges"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("_inner") + F.coalesce("_edges", F.lit(0)))
    # What lies below a part of a node, and at the part that owns the node what it adds itself, is summed
    # from the end of the path.
    adds = whole.select(
        "key", "_owner", (F.col("n_children") == 0).cast("long").alias("_leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("_save"),
    )
    up = Window.partitionBy("shard", "chain").orderBy(F.desc("depth"))
    other = F.col("chain") == 1
    flow = parts.select("key", "shard", "chain", "depth", "fork", "n_leaves", "saved_tokens").join(adds, "key")
    owned = lambda c: F.when(F.col("_owner") == place, F.col(c)).otherwise(0)
    flow = flow.withColumns(
        {"_leaf": owned("_leaf") + F.col("n_leaves"), "_save": owned("_save") + F.col("saved_tokens")}
    )
    joins = (F.col("chain") == 0) & (F.col("depth") <= F.col("fork"))
    for c in ("_leaf", "_save"):
        branch = F.coalesce(F.sum(F.when(other, F.col(c))).over(Window.partitionBy("shard")), F.lit(0))
        flow = flow.withColumn(f"{c}_branch", branch)
    for c in ("_leaf", "_save"):
        flow = flow.withColumn(f"{c}_sum", F.sum(c).over(up) + F.when(joins, F.col(f"{c}_branch")).otherwise(0))
    flow = flow.groupBy("key").agg(
        F.sum("_leaf_sum").alias("n_leaves"), F.sum("_save_sum").alias("saved_tokens")
    )
    whole = stored(whole.join(flow, "key").drop("_owner", "_inner", "_edges"), "trie-merged")
    parents = whole.select(F.col("key").alias("up"), F.col("conv_id").alias("_parent"))
    open_ = made.filter(F.col("kind") == _BELOW_EDGE).select(*[c for c in out if c != "parent_conv_id"], "up")
    open_ = open_.unionByName(whole.select(*open_.columns))
    found = join_lookup(open_, parents, "up", ["conv_id", "depth"])
    found = found.withColumnRenamed("_parent", "parent_conv_id").select(*out)
    return made.filter(F.col("kind") == _INNER).select(*out).unionByName(found)


def trie(turns: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations."""
    return nodes(paths(turns), limit)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 bit by bit: a list step takes a byte, or 0 for the other bits of the byte before it.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(conv_id::varchar) + 1),
    lambda i: [ascii((conv_id::varchar)[i])::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null),
c as (select conv_id, {_CRC} % {KEPT} h,
  list({{'r': r, 't': t}} order by turn nulls first, sha256(strlen(r) || ':' || r || t)) l from t group by conv_id),
p as (select c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], c.l[c.h + 1:]) p
  from c left join c b on b.conv_id = c.conv_id - c.conv_id % {GROUP}),
x as (select conv_id, d, p[1:d] k, len(p) n from (select conv_id, p, unnest(range(0, len(p) + 1)) d from p)),
n as (select d, k, min(conv_id) conv_id, count(*) n_convs,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) ends from x group by d, k),
c2 as (select d - 1 d, k[1:d - 1] k, count(*) n_children from n where d > 0 group by all),
m as (select n.*, coalesce(n_children, 0) n_children,
  case when d = 0 then 0 else (n_convs - 1) * strlen(k[d].t) end own from n left join c2 using (d, k)),
s as (select e d, k[1:e] k, sum(own) saved, sum((n_children = 0)::int) n_leaves
  from (select k, own, n_children, unnest(range(0, d + 1)) e from m) group by all)
select m.conv_id, m.d depth, q.conv_id parent_conv_id, m.n_convs, m.n_children, s.n_leaves::bigint n_leaves,
  s.saved::bigint saved_tokens, m.ends ends_sha256
from m join s on s.d = m.d and s.k = m.k left join n q on q.d = m.d - 1 and q.k = m.k[1:m.d - 1]
"""
