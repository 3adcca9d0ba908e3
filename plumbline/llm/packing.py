"""Packing documents into fixed-length sequences: bulk-synchronous best fit.

A round range-sorts documents and gaps together by size (documents before gaps of the same size) and
sweeps each partition once: a gap takes the largest document that fits and is not taken, that is, a
document gets the nearest free gap above it. What a partition leaves over, small gaps and large
documents, is matched by rank across partitions from their counts. Then gaps are updated and the next
round begins.

The rows are bins. A bin filled to half at most is a document, a fuller one is a gap; a match joins
two bins. Documents that no gap can take are joined with their neighbours in rank, so each round
halves the small bins and the rounds are logarithmic, however small the documents are. A row lists
its pieces, at most `capacity`, so nothing has to be traced back at the end.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch
from .tokens import TEXT_BYTES, encoder
from .words import text_slices

CAPACITY = 2048
END = 0
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of documents (doc_id, text): ids and an end id, cut at `capacity` if longer.

    A null text is empty: its piece is the end id. Repeated rows have pieces of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, True)
        for batch in text_slices(batches, 1, TEXT_BYTES):
            flat, sizes = coder.ids(batch.column(1))
            ends = np.cumsum(sizes + 1)
            raw = memoryview(np.insert(flat, np.cumsum(sizes), END).astype("<u4").tobytes())
            count = -(-(sizes + 1) // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, (sizes + 1)[doc] - start)
            at = (ends - sizes - 1)[doc] + start
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (size, is_gap, bin) -> (part, bin, is_gap, pair, rank): matched rows share a pair, the
    others are numbered in order by kind."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    free: list[int] = []
    pairs, gap_rank = 0, 0
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "bin", "is_gap", "pair", "rank"]
        )

    for batch in batches:
        for is_gap, bin_id in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not is_gap:
                free.append(bin_id)
            elif free:
                out.append((part, free.pop(), False, pairs, None))
                out.append((part, bin_id, True, pairs, None))
                pairs += 1
            else:
                out.append((part, bin_id, True, None, gap_rank))
                gap_rank += 1
        if len(out) > 50_000:
            yield batch_of(out)
            out = []
    out += [(part, b, False, None, k) for k, b in enumerate(free)]
    if out:
        yield batch_of(out)


def _match_counts(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """counts: (part, gaps left, documents left) in order of parts. A gap left in a part takes the
    last document left in the parts before it. Returns runs (part, first rank, end rank, first pair)
    of gaps and of documents, whose ranks descend, and the runs of documents that stay."""
    stack: list[list[int]] = []
    gaps, docs, pair = [], [], 0
    for part, gap, doc in counts:
        at = 0
        while at < gap and stack:
            top = stack[-1]
            n = min(gap - at, top[1])
            gaps.append((part, at, at + n, pair))
            docs.append((top[0], top[1] - n, top[1], pair))
            pair, at = pair + n, at + n
            top[1] -= n
            if not top[1]:
                stack.pop()
        if doc:
            stack.append([part, doc])
    # Documents without a gap: neighbours by rank form pairs, the largest two first.
    rest, left = [], 0
    for part, n in reversed(stack):
        rest.append((part, 0, n, left))
        left += n
    return [(*g, "gap") for g in gaps] + [(*d, "doc") for d in docs], [(*r, pair) for r in rest]


def best_fit(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """(bin, size) with 0 < size <= capacity and unique long `bin` -> (sequence_id, bins, sizes),
    the bins of each sequence in their order there."""
    spark = items.sparkSession
    state = scratch.save(
        items.select("bin", F.col("size").alias("fill"), F.array("bin").alias("bins"), F.array("size").alias("sizes"))
    )
    closed = []
    run_schema = "part int, first bigint, end bigint, pair bigint, kind string"
    while True:
        small = F.col("fill") <= capacity // 2
        least, smalls = state.where(small).agg(F.min("fill"), F.count(F.lit(1))).first()
        if smalls == 0 or (smalls == 1 and not state.where(~small & (capacity - F.col("fill") >= least)).take(1)):
            closed.append(state)
            break
        # A gap below the smallest document stays as it is from now on.
        closed.append(state.where(capacity - F.col("fill") < least))
        state = state.where(capacity - F.col("fill") >= least)
        keyed = state.select(
            F.when(small, F.col("fill")).otherwise(capacity - F.col("fill")).alias("size"),
            (~small).alias("is_gap"),
            "bin",
        )
        order = ["size", "is_gap", "bin"]
        swept = scratch.save(
            keyed.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .mapInArrow(_sweep, "part int, bin bigint, is_gap boolean, pair bigint, rank bigint")
        )
        counts = (
            swept.where("rank is not null")
            .groupBy("part")
            .agg(F.count_if("is_gap").alias("gaps"), F.count_if(~F.col("is_gap")).alias("docs"))
            .orderBy("part")
        )
        runs, rest = _match_counts([tuple(r) for r in counts.collect()])
        own = swept.where("rank is null").select(
            "bin", "is_gap", F.struct(F.lit("own").alias("how"), F.col("part").alias("a"), F.col("pair").alias("b")).alias("pair")
        )
        left = swept.where("rank is not null")
        matched = [own]
        if runs:
            table = spark.createDataFrame(runs, run_schema)
            # Gaps count up from the first rank, documents down from the last.
            number = F.when(
                F.col("is_gap"), F.col("r.pair") + F.col("rank") - F.col("first")
            ).otherwise(F.col("r.pair") + F.col("end") - 1 - F.col("rank"))
            matched.append(
                left.alias("l")
                .join(table.alias("r"), (F.col("l.part") == F.col("r.part")) & (F.col("kind") == F.when(F.col("is_gap"), "gap").otherwise("doc")))
                .where("rank >= first and rank < end")
                .select("bin", "is_gap", F.struct(F.lit("run").alias("how"), F.lit(0).alias("a"), number.alias("b")).alias("pair"))
            )
        if rest:
            table = spark.createDataFrame(
                [r[:4] for r in rest], "part int, first bigint, end bigint, before bigint"
            )
            down = F.col("before") + F.col("end") - 1 - F.col("rank")
            matched.append(
                left.where("not is_gap")
                .join(table, "part")
                .where("rank < end")
                .select("bin", (down % 2 == 0).alias("is_gap"), F.struct(F.lit("rest").alias("how"), F.lit(0).alias("a"), F.expr("(before + end - 1 - rank) div 2").alias("b")).alias("pair"))
            )
        pairs = matched[0]
        for more in matched[1:]:
            pairs = pairs.unionByName(more)
        alone = F.struct(F.lit("alone").alias("how"), F.lit(0).alias("a"), F.col("bin").alias("b"))
        joined = state.join(pairs, "bin", "left").withColumn("pair", F.coalesce("pair", alone))
        ends = joined.groupBy("pair").agg(
            F.sort_array(
                F.collect_list(F.struct((~F.coalesce("is_gap", F.lit(True))).alias("late"), "bin", "fill", "bins", "sizes"))
            ).alias("two")
        )
        merged = ends.select(
            F.col("two")[0]["bin"].alias("bin"),
            F.aggregate("two", F.lit(0).cast("bigint"), lambda s, x: s + x["fill"]).alias("fill"),
            F.flatten(F.transform("two", lambda x: x["bins"])).alias("bins"),
            F.flatten(F.transform("two", lambda x: x["sizes"])).alias("sizes"),
        )
        state = scratch.save(merged)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), "bins", "sizes")


def pack_documents(docs: DataFrame, scratch: Scratch, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with `sequence_id` and `offset`. Full pieces are sequences of their own."""
    pieces = scratch.save(
        token_pieces(docs, path, capacity).withColumn("bin", F.monotonically_increasing_id())
    )
    fitted = best_fit(
        pieces.where(F.col("length") < capacity).select("bin", F.col("length").alias("size")), scratch, capacity
    )
    places = fitted.select(
        "sequence_id", F.posexplode("bins").alias("at", "bin"), "sizes"
    ).select(
        "sequence_id",
        "bin",
        F.aggregate(F.slice("sizes", 1, F.col("at")), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("offset"),
    )
    full = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, F.col("bin").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    placed = pieces.where(F.col("length") < capacity).join(places, "bin")
    return full.unionByName(placed).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"))
