"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. *Split.* Each task cuts its texts at white space into words (a word keeps the space before it),
   in blocks of about ``BLOCK_BYTES``. Of a block, one row per text holds the positions (numbers of
   the block's distinct words in order), and one row per bucket of a hash holds the distinct words
   themselves. Both are made from the texts when they are shuffled; a block is named by a hash of
   its texts, its partition and its number there, so that the two always fit each other and equal
   blocks stay apart.
2. *Encode.* The words are dealt out by bucket, so that equal words of all blocks meet, each is
   encoded once, and every block gets the ids of its words back.
3. *Reassemble.* By block, ids are put where the positions name them.

Only distinct words are shuffled with their bytes. A word in every text is one entry per block,
so frequent words make no hot task. Pre-token boundaries of the pattern always exist where white
space follows something else, hence words can be encoded on their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text whose distinct words are numbered together; bounds a task's memory.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 20
#: Parts into which the words are hashed; a task holds the distinct words of one at a time.
BUCKETS = 512
#: Words whose ids a task remembers; beyond it forgets them all and encodes anew.
REMEMBERED = 2_000_000

# The characters with the Unicode property White_Space.
_WHITE = "\\t-\\r \x85\xa0  -     　"
_WORDS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: White space before a space: such texts can't be cut at every space.
_UNEVEN = f"[{_WHITE}] "


class Ranks:
    """A byte-level vocabulary read from a rank file, and the pattern of its pre-tokens.

    The file is read once, on the driver; tasks get its contents (as large as the vocabulary).
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.tokens = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.pattern = pattern

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.tokens, special_tokens={})

    def token_bytes(self) -> list[bytes]:
        """The token-byte table: bytes by id."""
        table = [b""] * (max(self.tokens.values(), default=-1) + 1)
        for token, rank in self.tokens.items():
            table[rank] = token
        return table


def public_ranks() -> Ranks:
    import public_tokenizers

    return Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _pack(*arrays: np.ndarray, body: bytes = b"") -> bytes:
    """Arrays of unsigned numbers, and bytes, as one compressed value. Bytes of equal weight are
    put together, which compresses better."""
    import zstandard

    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    planes = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes, body]))


def _unpack(value: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    count = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, np.uint32, count, 4)
    at, arrays = 4 + 4 * count, []
    for n in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 * n
    return arrays, raw[at:]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and where each text's begin (and the last end).

    Texts in which every space follows something that is not white space (most) are cut by Arrow.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    even = pc.split_pattern(pc.if_else(uneven, pa.scalar("", pa.large_string()), texts), " ")
    even = even.combine_chunks() if isinstance(even, pa.ChunkedArray) else even
    starts = np.asarray(even.offsets).astype(np.int64)
    starts -= starts[0]
    flat = even.flatten()
    del even  # each of these is as large as the texts and their words' offsets
    first = np.zeros(len(flat), bool)
    first[starts[:-1]] = True  # every text has a first part, if an empty one
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat, pa.scalar(" ", pa.large_string()))
    words = pc.if_else(pa.array(first), flat, spaced)
    del flat, spaced
    odd = np.flatnonzero(np.asarray(uneven))
    if len(odd) == 0:
        return words, starts
    pieces, sizes, done = [], np.diff(starts), 0
    for i in odd.tolist():
        cut = _WORDS.findall(texts[i].as_py())
        pieces += [words.slice(starts[done], starts[i] - starts[done]), pa.array(cut, pa.large_string())]
        sizes[i], done = len(cut), i + 1
    pieces.append(words.slice(starts[done]))
    return pa.concat_arrays(pieces), np.concatenate(([0], np.cumsum(sizes)))


class _Block:
    """The texts of a block as positions in its distinct words, which are in order of bucket and
    then of bytes; ``key`` names the block by its texts and its ``place``: partition and number there."""

    def __init__(self, batches: list[pa.RecordBatch], text: str, place: tuple[int, int]):
        self.table = pa.Table.from_batches(batches)
        texts, pieces, starts = self.table.column(text), [], [np.zeros(1, np.int64)]
        step = max(1, len(texts) * PIECE_BYTES // max(1, texts.nbytes))
        for at in range(0, len(texts), step):  # the words of a piece take several times its bytes
            flat, cuts = words_of(texts.slice(at, step).combine_chunks())
            pieces.append(flat.dictionary_encode())
            starts.append(cuts[1:] + starts[-1][-1])
        del flat
        self.starts = np.concatenate(starts)
        coded = pa.chunked_array(pieces).unify_dictionaries()
        del pieces
        words = coded.chunk(0).dictionary.cast(pa.large_binary())
        buckets = np.fromiter((zlib.crc32(w.as_buffer()) % BUCKETS for w in words), np.int32, len(words))
        order = np.asarray(pc.sort_indices(words)).astype(np.int64)
        order = order[np.argsort(buckets[order], kind="stable")]  # by bucket, then by bytes
        self.words, self.buckets = words.take(pa.array(order)).to_pylist(), buckets[order]
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        self.places = np.concatenate([np.zeros(0, np.uint32), *[rank[np.asarray(c.indices)] for c in coded.chunks if len(c)]])
        key = xxhash.xxh64(np.array(place, np.int64).tobytes())
        key.update(self.starts.tobytes())
        key.update(self.places.tobytes())
        key.update(b"\0".join(self.words))
        self.key = int.from_bytes(key.digest(), "big", signed=True)

    def word_rows(self) -> tuple[list[int], list[bytes]]:
        """Buckets that have words, and the words of each."""
        present, cuts = np.unique(self.buckets, return_index=True)
        parts = [self.words[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.words)])]
        return present.tolist(), [_pack(np.fromiter(map(len, p), np.uint32, len(p)), body=b"".join(p)) for p in parts]

    def position_rows(self) -> list[bytes]:
        return [_pack(self.places[a:b]) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist())]


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[_Block]:
    held, size, partition, number = [], 0, TaskContext.get().partitionId(), 0
    for batch in batches:
        step = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield _Block(held, text, (partition, number))
                held, size, number = [], 0, number + 1
    if held:
        yield _Block(held, text, (partition, number))


def split_words(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``block, bucket, packed``: the distinct words of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, text):
            buckets, packed = block.word_rows()
            columns = [pa.array([block.key] * len(packed), pa.int64()), pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())]
            del block, packed  # the next one is made before this name gets it
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "packed"])

    # the same columns as for the positions, so that both read the same plan
    return docs.select(*{text: None, **dict.fromkeys(keep)}).mapInArrow(run, "block bigint, bucket int, packed binary")


def split_positions(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``block, packed`` and the columns ``keep`` as ``k0, k1, ...``: the positions of every text."""
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("packed", T.BinaryType()), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, text):
            packed = block.position_rows()
            kept = [block.table.column(c).cast(arrow.field(f"k{i}").type).combine_chunks() for i, c in enumerate(keep)]
            columns = [pa.array([block.key] * len(packed), pa.int64()), pa.array(packed, pa.binary()), *kept]
            del block, packed, kept
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*{text: None, **dict.fromkeys(keep)}).mapInArrow(run, schema)


def encode_words(dealt: DataFrame, ranks: Ranks) -> DataFrame:
    """Step 2: ``block, bucket, packed`` with the ids of each word in place of the words."""
    shared = dealt.sparkSession.sparkContext.broadcast((ranks.tokens, ranks.pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        tokens, pattern = shared.value
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        known, current = {}, None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if bucket != current or len(known) > REMEMBERED:
                    known, current = {}, bucket
                (sizes,), body = _unpack(packed)
                ids, at = [], 0
                for n in sizes.tolist():
                    word = body[at:at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode(word.decode())
                    ids.append(found)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
                out.append(_pack(lengths, flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "packed"])

    dealt = dealt.select("block", "bucket", "packed")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, dealt.schema)


def _gather(places: np.ndarray, lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of the words at ``places``, one after another."""
    sizes = lengths[places]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - sizes), sizes)
    return flat[at]


#: What to make of each text's ids: columns of a schema, one array each.
Finish = Callable[[list[np.ndarray]], list[pa.Array]]


def _reassembled(docs: DataFrame, ranks: Ranks, text: str, keep: list[str], made: list[T.StructField], finish: Finish) -> DataFrame:
    """Step 3: the columns ``keep`` and those that ``finish`` makes of the ids of a block's texts."""
    words, positions = encode_words(split_words(docs, text, keep), ranks), split_positions(docs, text, keep)
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *made])

    def rebuild(texts: pa.Table, dealt: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        parts = dict(zip(dealt.column("bucket").to_pylist(), dealt.column("packed").to_pylist()))
        unpacked = [_unpack(parts[b])[0] for b in sorted(parts)]
        lengths = np.concatenate([np.zeros(0, np.uint32), *[u[0] for u in unpacked]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[u[1] for u in unpacked]])
        starts = np.cumsum(lengths) - lengths
        places = [_unpack(p)[0][0] for p in texts.column("packed").to_pylist()]
        if not len(lengths) and any(map(len, places)):
            raise ValueError("the texts were not the same when they were read again; write them to a table first")
        columns = [texts.column(f"k{i}") for i in range(len(keep))]
        columns += finish([_gather(p, lengths, starts, flat) for p in places])
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return positions.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(rebuild, schema)


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) with ``n_tokens`` and ``ids array<int>``.

    A null text counts as the empty one, which has no ids. Special tokens' strings are ordinary
    text. Rows appear as often as they do in ``docs``. Raises where ``keep`` has ``n_tokens`` or
    ``ids`` itself. ``docs`` is read twice and must give the same rows in the same order in each
    task, as a written table does; where it doesn't, blocks don't fit and this raises.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    if {"n_tokens", "ids"} & set(keep):
        raise ValueError("docs has a column named n_tokens or ids; rename it or leave it out of keep")

    def lists(rows: list[np.ndarray]) -> list[pa.Array]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = pa.array(np.concatenate([np.zeros(0, np.uint32), *rows]).view(np.int32))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return [pa.array(sizes), pa.ListArray.from_arrays(offsets, ids)]

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return _reassembled(docs, ranks, text, keep, made, lists)


def bytes_of(ids: np.ndarray, table: list[bytes]) -> bytes:
    """Every id looked up in the token-byte table, joined in order; an unknown id raises."""
    return b"".join([table[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for. The token-byte table, as large as the
    vocabulary, goes to every task, which joins the ids with it. Null ids: null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks.token_bytes())

    @F.pandas_udf("binary")
    def look_up(rows: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([None if r is None else bytes_of(r, table) for r in rows], dtype=object)

    return encoded.withColumn(out, look_up(F.col(ids)))


def round_trip(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text is encoded, and its ids are
    decoded where they are put together, so that neither ids nor bytes need travel."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks.token_bytes())

    def digests(rows: list[np.ndarray]) -> list[pa.Array]:
        table, sha = shared.value, hashlib.sha256
        ids = [sha(r.astype("<u4").tobytes()).hexdigest() for r in rows]
        decoded = [sha(bytes_of(r, table)).hexdigest() for r in rows]
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _reassembled(docs, ranks, "text", ["doc_id"], made, digests)
