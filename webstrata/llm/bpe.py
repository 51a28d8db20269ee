"""BPE encoding and decoding through a table of distinct words.

Spark splits the texts into words; every block names its distinct words once and its texts
become places in that list. The words of all blocks meet by hash bucket, where each distinct word
is encoded once, and the ids return to the blocks by place: a text's ids are those of its words in
order. Decoding looks every id up in the id-to-piece table, which has as many rows as the
vocabulary (at most ``MAX_PIECES``, checked) and is held by each task, and joins the pieces.

The tokenizer is a file of the tokenizers library with a byte-level pre-tokenizer; its path, which
all executors can open, is a parameter. Special tokens in a text become their ids, as the library
does by default.

Defined results: a NULL text is encoded as an empty one; an empty text has no ids and decodes to
an empty text; repeated rows are encoded each; an empty table gives an empty result. Other columns
are kept.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm import blocks
from webstrata.llm.common import admitted

MAX_PIECES = 1_000_000
# --- Fixed value: the pre-tokenizer's pattern of byte-level BPE ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _letters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.cache
def _specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    byte = {c: b for b, c in enumerate(_letters())}
    table = [b""] * (1 + max([*vocabulary.values(), *_specials(path).values()]))
    for piece, at in vocabulary.items():
        table[at] = bytes(map(byte.__getitem__, piece))
    for piece, at in _specials(path).items():
        table[at] = piece.encode()
    return table


@functools.cache
def _unassigned():
    """Finds characters that Python's Unicode tables do not assign."""
    free = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for c, before in zip(free, [-2, *free]) if c != before + 1]
    ends = [c for c, after in zip(free, [*free[1:], -2]) if c != after - 1]
    spans = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))
    return re.compile(f"[{spans}]").search


def _word_finder(path: str):
    """Splits by the pattern. The regex module and the tokenizer know different versions of
    Unicode, so a text with characters newer than Python's tables is split by the tokenizer."""
    pattern, letters = regex.compile(PATTERN).findall, _letters()
    byte = {c: b for b, c in enumerate(letters)}

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _unassigned()(text):
                split = _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)
                return [bytes(map(byte.__getitem__, w)).decode() for w, _ in split]
        return pattern(text)

    return find


def split_words(path: str):
    """A function that splits a text into its words and special tokens."""
    find = _word_finder(path)
    marks = sorted(_specials(path), key=len, reverse=True)
    if not marks:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split

    def words(text: str) -> list[str]:
        if not any(mark in text for mark in marks):
            return find(text)
        return [w for i, part in enumerate(cut(text)) for w in ([part] if i % 2 else find(part))]

    return words


def encode_word(word: str, path: str) -> list[int]:
    special = _specials(path).get(word)
    if special is not None:
        return [special]
    letters = _letters()
    return [t.id for t in _tokenizer(path).model.tokenize("".join(letters[b] for b in word.encode()))]


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    text = zstandard.ZstdCompressor(level=1).compress(b"".join(words))
    return blocks.bundle(blocks.pack(sizes), text)


def _unpack_words(blob: bytes) -> list[bytes]:
    sizes, text = blocks.unbundle(blob)
    text = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(blocks.unpack(sizes, np.uint32), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _to_blocks(path: str, buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = split_words(path)
        for number, table in blocks.cut(batches, limit):
            words, counts = [], []
            for text in table.column("text"):
                found = split(text.as_py() or "")
                words += found
                counts.append(len(found))
            names = sorted(set(words))
            raw = [name.encode() for name in names]
            bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(names), np.uint32)
            place[order] = np.arange(len(names), dtype=np.uint32)
            code = dict(zip(names, place.tolist(), strict=True))
            codes = np.fromiter(map(code.__getitem__, words), np.uint32, len(words))
            held = np.bincount(bucket, minlength=buckets)
            ends, order = np.cumsum(held), order.tolist()
            parts = [
                {"bucket": b, "blob": _pack_words([raw[i] for i in order[ends[b] - held[b] : ends[b]]])}
                for b in np.flatnonzero(held).tolist()
            ]
            data = blocks.bundle(
                blocks.packed_table(table.drop_columns(["text"])),
                blocks.pack(codes), blocks.pack(np.array(counts, np.uint32)),
            )
            yield pa.RecordBatch.from_pylist(
                [{"block": number, "data": data, "parts": parts}],
                pa.schema({"block": pa.int64(), "data": pa.binary(), "parts": _PARTS}),
            )

    return run


_PARTS = pa.list_(pa.struct({"bucket": pa.int32(), "blob": pa.binary()}))


def _encode_bucket(path: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, list[int]] = {}
        answers = []
        for blob in group["blob"]:
            found = []
            for word in _unpack_words(blob):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode_word(word.decode(), path)
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            answers.append(blocks.bundle(blocks.pack(sizes), blocks.pack(flat)))
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "blob": answers})

    return run


def _ids_by_place(codes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple:
    """Ids of the words at ``codes`` in order, and where each word's ids end."""
    starts = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    inside = np.arange(total) - np.repeat(ends - each, each)
    return flat[np.repeat(starts[codes], each) + inside], ends


def _from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column("data")[row].as_py()
            rows, codes, counts = blocks.unbundle(data)
            table = blocks.unpacked_table(rows)
            answers = blocks.by_bucket(batch.column("answers")[row].as_py())
            found = [blocks.unbundle(blob) for _, blob in answers]
            none = np.zeros(0, np.uint32)
            sizes = np.concatenate([none, *[blocks.unpack(f[0], np.uint32) for f in found]])
            flat = np.concatenate([none, *[blocks.unpack(f[1], np.uint32) for f in found]])
            ids, ends = _ids_by_place(blocks.unpack(codes, np.uint32), sizes.astype(np.int64), flat)
            last = np.concatenate([[0], ends])[np.cumsum(blocks.unpack(counts, np.uint32), dtype=np.int64)]
            packed = ids.astype("<u4").tobytes()
            edges = [0, *(4 * last).tolist()]
            table = table.append_column("ids", pa.array([packed[a:b] for a, b in zip(edges, edges[1:])], pa.binary()))
            yield from table.to_batches(max_chunksize=2000)



def encode(
    docs: DataFrame, path: str | None = None, limit: int = blocks.BLOCK_BYTES, decoded: bool = False
) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: little-endian unsigned 32-bit integers.

    With ``decoded``, the ids are decoded again in the same task (see ``decode``).
    """
    path = path or default_path()
    docs = admitted(docs, ("ids", "decoded") if decoded else ("ids",))
    kept = docs.drop("text").schema
    made = docs.mapInArrow(
        _to_blocks(path, blocks.bucket_count(docs), limit),
        f"block long, data binary, parts array<{blocks.PART}>",
    )
    stored = blocks.store(made, "bpe")
    answers = blocks.exchange(stored.select("block", "parts"), _encode_bucket(path))
    out = T.StructType([*kept.fields, T.StructField("ids", T.BinaryType())])
    joined = blocks.with_answers(stored.select("block", "data"), answers)
    if not decoded:
        return joined.mapInArrow(_from_blocks, out)
    out = out.add("decoded", T.StringType())
    turned = _decoded(path)
    return joined.mapInArrow(lambda batches: turned(_from_blocks(batches)), out)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path).__getitem__
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                numbers = np.frombuffer(ids.as_py() or b"", "<u4").tolist()
                texts.append(b"".join(map(piece, numbers)).decode("utf-8", "replace"))
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; NULL ids give an empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decoded(path or default_path()), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    both = encode(docs.select("doc_id", "text"), path, decoded=True)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
