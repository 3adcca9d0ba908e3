"""Token-id files: static range asymmetric numeral systems over independent interleaved blocks.

A segment holds the ids of consecutive documents:

    magic, counts | table | document lengths | block checkpoints | coded words

Its frequency table is shared by all its blocks. A block is `BLOCK` ids coded by `LANES` interleaved
states of 63 bits that emit 32-bit words; its checkpoint gives the word where it begins, its final
states and the crc32 of its ids, so any block decodes alone and is verified. All blocks of a segment
are coded side by side, a step of every lane at a time.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .tokens import TEXT_BYTES, encoder
from .words import text_slices

MAGIC = b"RANS0001"
LANES = 32
BLOCK = LANES * 2048
SEGMENT = BLOCK * 48  # ids after which a segment ends with the document at hand
BITS = 18  # frequencies of a table sum to 2**BITS; more ids than that take a table of their own width
LOW = 1 << 31  # states stay in [LOW, LOW * 2**32)
HEAD = struct.Struct("<8sqqqqqq")
END = 0


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive counts scaled to positive numbers that sum to 2**bits."""
    total = 1 << bits
    scaled = np.maximum(1, counts * (total / counts.sum())).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    while (over := int(scaled.sum()) - total) != 0:
        if over < 0:
            scaled[order[0]] -= over
        else:
            room = scaled[order] - 1
            cut = np.minimum(room, np.maximum(1, room * over // max(1, int(room.sum()))))
            cut = np.where(np.cumsum(cut) <= over, cut, 0)
            scaled[order] -= cut
    return scaled


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the place of each id among them."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    # Ids of a vocabulary are small: a table of them spares the sort.
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen) - 1)[ids]


def encode(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment of documents with the given numbers of ids."""
    ids, lengths = np.asarray(ids, np.uint32), np.asarray(lengths, np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    symbols, rank = _ranked(ids)
    bits = max(BITS, int(len(symbols)).bit_length() + 2)
    freq = frequencies(np.bincount(rank).astype(np.float64), bits) if n else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    lanes = blocks * LANES
    steps = BLOCK // LANES
    # Row k of the grid is step k of every lane; the last block is filled up with the cheapest symbol.
    padded = np.full(blocks * BLOCK, int(np.argmax(freq)) if n else 0, np.int64)
    padded[:n] = rank
    grid = padded.reshape(blocks, steps, LANES)
    state = np.full(lanes, LOW, np.uint64)
    words, owners = [], []
    f_all, s_all = freq.astype(np.uint64), start.astype(np.uint64)
    shift, word_bits, top = np.uint64(bits), np.uint64(32), np.uint64(63 - bits)
    for k in range(steps - 1, -1, -1):
        at = grid[:, k, :].reshape(-1)
        f = f_all[at]
        full = np.flatnonzero(state >= (f << top))
        if len(full):
            words.append((state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append(full)
            state[full] >>= word_bits
        q = state // f
        state = (q << shift) + (state - q * f) + s_all[at]
    # Decoding reads words in the reverse order of emission, block by block.
    if words:
        word = np.concatenate(words[::-1])
        block = np.concatenate(owners[::-1]) // LANES
        order = np.argsort(block, kind="stable")
        word, per_block = word[order], np.bincount(block, minlength=blocks)
    else:
        word, per_block = np.zeros(0, np.uint32), np.zeros(blocks, np.int64)
    begin = np.cumsum(per_block) - per_block
    sums = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
    body = b"".join(
        (
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            begin.astype("<u8").tobytes(),
            np.array(sums, "<u4").tobytes(),
            state.astype("<u8").tobytes(),
        )
    )
    body = zlib.compress(body, 1)
    head = HEAD.pack(MAGIC, n, len(lengths), len(symbols), bits, blocks, len(body))
    return head + struct.pack("<I", zlib.crc32(body)) + body + word.astype("<u4").tobytes()


def decode(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of blocks first to last (all: none given) and the documents' numbers of ids."""
    magic, n, docs, count, bits, blocks, size = HEAD.unpack_from(data)
    at = HEAD.size + 4
    body = data[at : at + size]
    if magic != MAGIC or zlib.crc32(body) != struct.unpack_from("<I", data, HEAD.size)[0]:
        raise ValueError("not a token segment, or a damaged one")
    words = np.frombuffer(data, "<u4", offset=at + size)
    body, where = zlib.decompress(body), 0

    def take(kind: str, number: int) -> np.ndarray:
        nonlocal where
        out = np.frombuffer(body, kind, number, where)
        where += out.nbytes
        return out

    symbols, freq, lengths = take("<u4", count), take("<u4", count), take("<u4", docs)
    begin, sums, states = take("<u8", blocks), take("<u4", blocks), take("<u8", blocks * LANES)
    last = blocks if last is None else last
    if first >= last:
        return np.zeros(0, np.uint32), lengths
    f_all = freq.astype(np.uint64)
    start = np.cumsum(f_all) - f_all
    slot = np.repeat(np.arange(count, dtype=np.int32), freq)
    state = states[first * LANES : last * LANES].copy()
    cursor = begin[first:last].astype(np.int64)
    steps = BLOCK // LANES
    out = np.empty((steps, len(state)), np.int32)
    mask, shift, low = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(LOW)
    for k in range(steps):
        rest = state & mask
        at = slot[rest]
        out[k] = at
        state = f_all[at] * (state >> shift) + rest - start[at]
        short = (state < low).reshape(-1, LANES)
        if short.any():
            rank = np.cumsum(short, axis=1)
            # Damaged words may ask for more than there are; the checksum tells.
            place = np.minimum((cursor[:, None] + rank - 1)[short], len(words) - 1)
            hungry = np.flatnonzero(short.reshape(-1))
            state[hungry] = (state[hungry] << np.uint64(32)) | words[place].astype(np.uint64)
            cursor += rank[:, -1]
    ids = symbols[out.reshape(steps, last - first, LANES).transpose(1, 0, 2).reshape(-1)]
    ids = ids[: min(n, last * BLOCK) - first * BLOCK]
    for b in range(first, last):
        part = ids[(b - first) * BLOCK : (b - first + 1) * BLOCK]
        if zlib.crc32(part.astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"block {b} is damaged")
    return ids, lengths


def segments(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text) -> rows (part, segment, doc_ids, tokens, data)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    coder = encoder(path, False)
    keys, ids, lengths, number = [], [], [], 0

    def flush():
        nonlocal keys, ids, lengths, number
        flat, sizes = np.concatenate(ids), np.concatenate(lengths)
        row = {
            "part": [part],
            "segment": [number],
            "doc_ids": [[k for some in keys for k in some]],
            "tokens": [len(flat)],
            "data": [encode(flat, sizes)],
        }
        keys, ids, lengths, number = [], [], [], number + 1
        return pa.RecordBatch.from_pydict(row, schema=SEGMENT_ARROW)

    held = 0
    for batch in text_slices(batches, 1, TEXT_BYTES):
        flat, sizes = coder.ids(batch.column(1))
        ends = np.cumsum(sizes)
        with_end = np.insert(flat, ends, END)
        keys.append(batch.column(0).to_pylist())
        ids.append(with_end)
        lengths.append(sizes + 1)
        held += len(with_end)
        if held >= SEGMENT:
            yield flush()
            held = 0
    if held:
        yield flush()


SEGMENT_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("tokens", pa.int64()),
        ("data", pa.binary()),
    ]
)
SEGMENT_SCHEMA = "part int, segment int, doc_ids array<bigint>, tokens bigint, data binary"
READ_SCHEMA = "part int, segment int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of each segment: its place among the segment's ids, their number and crc32."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = decode(row["data"])
            lengths = lengths.astype(np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            size = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * size, pa.int32()),
                    pa.array([row["segment"]] * size, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ],
                ["part", "segment", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, scratch: Scratch, path: str) -> DataFrame:
    """Token files of documents (doc_id, text) in ascending doc_id order: a table of segments.

    Nulls: a null text is empty and has the end id alone; null ids come first. Documents of one id
    follow their texts' hash. Segments are Parquet rows, so task retries and every store are Spark's.
    """
    ordered = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_tie")
    )
    order = ["doc_id", "_h", "_tie"]
    placed = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.save(
        placed.mapInArrow(lambda it: segments(it, path), SEGMENT_SCHEMA), codec="none"
    )


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, decoded from the files."""
    before = Window.partitionBy().orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        "part", "segment", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_before")
    )
    found = files.select(*[f.name for f in SEGMENT_ARROW]).mapInArrow(read_segments, READ_SCHEMA)
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, Scratch(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(files)
