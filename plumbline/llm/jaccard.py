"""Exact similarity join on word shingles by T-occurrence search.

Two sets of sizes a and b with Jaccard similarity of t percent share T = ceil(t (a + b) / (100 + t))
elements. A document's search merges its short inverted lists and probes the long ones by binary
search (DivideSkip): with L long lists put aside, a partner must occur T - L times in the short ones.

Three exact filters come first, so that only documents with a possible partner meet:

1. Equal sets are one class; the rest works on classes.
2. A linked class of n elements misses at most e = n - ceil(t n / 100) of them in its partner. So of
   its elements in a fixed part of the hash range, all but e also occur in another class.
3. The same with rare-first order: its e + 1 rarest elements include one that it shares, and the two
   classes share one that is in both prefixes. Classes without such an element have no partner. The
   others fall into clusters, connected by prefix elements; partners are in one cluster.

A cluster within `CLUSTER` elements is searched in one task. A larger one is first compared with its
centre; only what the centre does not link is searched against all members, in blocks. Links inside
a component that is already known are not sought: the result is the components.

Nulls: a null or empty text has no shingles and is linked with nothing; a null doc_id has no
component and gives none its name. Repeated rows keep their places. Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .records import field, from_struct, in_struct
from .storage import Scratch
from .words import SLICE_BYTES, shingles, text_slices, word_hashes

WIDTH = 5
PERCENT = 80
PART = 0.3  # of the hash range, for the first filter
CLUSTER = 1_000_000  # elements of a cluster, or of a block pair, in a task
LONG_SHARE = 0.5  # of the T - 1 lists that may be put aside


def missing(n: int | np.ndarray | Column, percent: int = PERCENT):
    """Elements of a set of n that a partner may lack: n - ceil(percent * n / 100)."""
    if isinstance(n, Column):
        return n - F.ceil(n * percent / F.lit(100)).cast("bigint")
    return n - -(-n * percent // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


RAW_SCHEMA = "h bigint, class bigint, kind byte, a bigint, n bigint, part bigint, text bigint"


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> rows by h: 0 (class, a doc_id, n, part, text hash) members; 1 (class, a count) elements
    shared within the batch; 2 elements of one class of the batch; 3 elements of several."""
    limit = np.uint64(int(PART * 2**64))
    for batch in text_slices(batches, 1, SLICE_BYTES):
        sets = shingles(*word_hashes(batch.column(1)), WIDTH)
        keys = np.array([_class_of(s) if len(s) else 0 for s in sets], np.int64)
        heads = [s[: np.searchsorted(s, limit)] for s in sets]
        sizes = np.array([len(s) for s in sets], np.int64)
        parts = np.array([len(s) for s in heads], np.int64)
        out = [(keys, keys, np.full(len(keys), 0), batch.column(0), sizes, parts, batch.column(2))]
        _, once = np.unique(keys, return_index=True)
        once = once[parts[once] > 0]
        if len(once):
            h = np.concatenate([heads[i] for i in once])
            owner = np.repeat(once, parts[once])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            run = np.cumsum(new) - 1
            several = np.bincount(run) > 1
            shared = np.bincount(owner[several[run]], minlength=len(keys))
            have = np.flatnonzero(shared)
            zero = lambda n: np.zeros(n, np.int64)
            out.append((keys[have], keys[have], np.full(len(have), 1), shared[have], *[zero(len(have))] * 3))
            single = ~several[run]
            out.append((_signed(h[single]), keys[owner[single]], np.full(single.sum(), 2), *[zero(single.sum())] * 4))
            multi = _signed(h[new][several])
            out.append((multi, zero(len(multi)), np.full(len(multi), 3), *[zero(len(multi))] * 4))
        names = ["h", "class", "kind", "a", "n", "part", "text"]
        for columns in out:
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, pa.int8() if name == "kind" else pa.int64())
                    for name, c in zip(names, columns)
                ],
                names,
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h -> members as they are, and (class, a count) of elements in two classes or more.

    Only the first row of an element waits for the second one, so the longest list needs no room."""
    held: tuple[int, int] | None = None  # element, class of its only row so far (None: known as shared)
    for batch in batches:
        kind = batch.column(2).to_numpy()
        plain = pa.array(kind < 2)
        yield batch.filter(plain).drop_columns(["h"])
        h = batch.column(0).to_numpy()[kind >= 2]
        key = batch.column(1).to_numpy()[kind >= 2]
        several = kind[kind >= 2] == 3
        if not len(h):
            continue
        new = np.append(True, h[1:] != h[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        differs = several | (key != key[first][run])
        many = np.bincount(run, differs) > 0
        counted = many[run] & ~several
        late = []
        if held is not None and held[0] == h[0]:
            own = run == 0
            known = held[1] is None
            joined = known or many[0] or bool((key[own] != held[1]).any()) or bool(several[own].any())
            if joined:
                counted |= own & ~several
                many[0] = True
                if not known:
                    late.append(held[1])
        last = run[-1]
        if held is not None and held[0] == h[-1] and held[1] is None or many[last]:
            held = (int(h[-1]), None)
        elif not (held is not None and held[0] == h[-1]):
            # All rows of the last element have one class and may be joined by later rows.
            held = (int(h[-1]), int(key[-1]))
        classes, counts = np.unique(np.append(key[counted], np.array(late, np.int64)), return_counts=True)
        zero = np.zeros(len(classes), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.int64()), pa.array(np.full(len(classes), 1), pa.int8()), pa.array(counts, pa.int64()), *[pa.array(zero)] * 3],
            ["class", "kind", "a", "n", "part", "text"],
        )


def classes_and_members(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The table (class, kind, a, n, part, text): members (kind 0) and shared counts (kind 1)."""
    raw = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(_raw, RAW_SCHEMA)
    by_h = raw.repartition("h").sortWithinPartitions("h", "kind", "class")
    return scratch.save(by_h.mapInArrow(_shared, RAW_SCHEMA.removeprefix("h bigint, ")))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, class) -> (class, n, h) for the texts of that class."""
    for batch in text_slices(batches, 0, SLICE_BYTES):
        want = batch.column(1).to_pylist()
        sets = shingles(*word_hashes(batch.column(0)), WIDTH)
        good = [(c, s) for c, s in zip(want, sets) if len(s) and _class_of(s) == c]
        sizes = np.array([len(s) for _, s in good], np.int64)
        flat = np.concatenate([s for _, s in good]) if good else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([c for c, _ in good], np.int64), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(_signed(flat))],
            ["class", "n", "h"],
        )


class Index:
    """Inverted lists of some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        lengths = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), lengths)
        flat = np.concatenate(sets)
        order = np.lexsort((owner, flat))
        self.owner, flat = owner[order], flat[order]
        self.tokens, self.first = np.unique(flat, return_index=True)
        self.end = np.append(self.first[1:], len(flat))

    def search(self, query: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Numbers of the sets that reach the overlap with a query set of n elements."""
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        a, b = self.first[at], self.end[at]
        order = np.argsort(b - a, kind="stable")
        a, b = a[order], b[order]
        # The least overlap that any partner needs: it has at least percent of n elements.
        least = max(1, n - int(missing(n, percent)))
        aside = min(len(a), int((least - 1) * LONG_SHARE))
        short = len(a) - aside
        # Merge the short lists: occurrences of each set in them.
        merged = np.concatenate([self.owner[x:y] for x, y in zip(a[:short], b[:short])]) if short else np.zeros(0, np.int64)
        ids, count = np.unique(merged, return_counts=True)
        enough = count >= least - aside
        ids, count = ids[enough], count[enough]
        # Probe the long lists for the sets that are left.
        for x, y in zip(a[short:], b[short:]):
            if not len(ids):
                break
            long = self.owner[x:y]
            k = np.minimum(np.searchsorted(long, ids), len(long) - 1)
            count += long[k] == ids
        m = self.sizes[ids]
        return ids[100 * count >= percent * (n + m - count)]


def link_cluster(sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The root (a number of a set) of each set's component. A set is searched for as long as it is
    outside the largest component: each pair across components then has been looked at."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    index = Index(sets, sizes)
    spread = index.end - index.first
    weight = [spread[np.searchsorted(index.tokens, s)].mean() if len(s) else 0 for s in sets]
    waiting = list(np.argsort(weight, kind="stable"))  # the centre last, taken first
    while waiting:
        if (np.bincount(root).max()) == len(root):
            break
        k = waiting.pop()
        big = np.argmax(np.bincount(root))
        if root[k] == big and any(root[w] != big for w in waiting):
            # Put off members of the largest component: those outside may make them needless.
            later = [w for w in waiting if root[w] == big]
            waiting = [k, *later, *[w for w in waiting if root[w] != big]]
            k = waiting.pop()
        elif root[k] == big:
            break
        found = index.search(sets[k], int(sizes[k]), percent)
        roots = np.unique(np.append(root[found], root[k]))
        root[np.isin(root, roots)] = roots[0]
    return root


def _search_cluster(frame: pd.DataFrame) -> pd.DataFrame:
    sets = [np.sort(np.asarray(t, np.int64)) for t in frame["tokens"]]
    root = link_cluster(sets, frame["n"].to_numpy())
    key = frame["class"].to_numpy()
    return pd.DataFrame({"a": key, "b": key[root]})


def _search_blocks(key, outside: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(outside) and len(members):
        index = Index([np.asarray(t, np.int64) for t in members["tokens"]], members["n"].to_numpy())
        names = members["class"].to_numpy()
        for own, tokens, n in zip(outside["class"], outside["tokens"], outside["n"]):
            for k in index.search(np.sort(np.asarray(tokens, np.int64)), int(n), PERCENT):
                out.append((own, names[k]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def link_classes(docs: DataFrame, table: DataFrame, scratch: Scratch, cluster_elements: int = CLUSTER) -> DataFrame:
    """(node, root) of the classes that are linked with another class."""
    members = table.where("kind = 0 and n > 0 and a is not null")
    classes = members.groupBy("class").agg(F.min("a").alias("doc_id"), F.first("n").alias("n"), F.first("part").alias("part"))
    shared = table.where("kind = 1").groupBy("class").agg(F.sum("a").alias("shared"))
    # A class with no element in the part of the hash range passes as well.
    likely = (
        classes.join(shared, "class", "left")
        .where(F.coalesce("shared", F.lit(0)) >= F.col("part") - missing(F.col("n")))
        .select("doc_id", "class")
    )
    sets = scratch.save(
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .join(likely, "doc_id")
        .select("text", "class")
        .mapInArrow(_sets, "class bigint, n bigint, h bigint")
    )
    lists = (
        sets.groupBy("h")
        .agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("low < high")
        .select("h", "df")
    )
    ranked = (
        sets.join(lists, "h")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("by_df"))
        .withColumn("reach", missing(F.col("n")) + 1 - (F.col("n") - F.size("by_df")))
        .where("reach > 0")
        .select(
            "class",
            "n",
            F.transform("by_df", lambda x: x["h"]).alias("tokens"),
            F.transform(F.slice("by_df", F.lit(1), F.col("reach").cast("int")), lambda x: x["h"]).alias("prefix"),
        )
    )
    ranked = scratch.save(ranked)
    entries = ranked.select("class", F.explode("prefix").alias("h"))
    hubs = entries.groupBy("h").agg(F.min("class").alias("hub"), F.max("class").alias("other")).where("hub < other")
    near = components(
        entries.join(hubs, "h").select(F.col("class").alias("a"), F.col("hub").alias("b")), scratch
    )
    clustered = scratch.save(
        ranked.drop("prefix").join(near.withColumnsRenamed({"node": "class", "root": "cluster"}), "class")
    )
    weight = clustered.groupBy("cluster").agg(F.sum(F.size("tokens")).alias("elements"))
    small = clustered.join(weight.where(F.col("elements") <= cluster_elements), "cluster")
    links = small.select("cluster", "class", "n", "tokens").groupBy("cluster").applyInPandas(
        _search_cluster, "a bigint, b bigint"
    )
    large = weight.where(F.col("elements") > cluster_elements)
    if large.take(1):
        links = links.unionByName(_link_large(clustered.join(large, "cluster"), scratch, cluster_elements))
    return components(links, scratch)


def _link_large(rows: DataFrame, scratch: Scratch, cluster_elements: int) -> DataFrame:
    """Links in clusters of any size: with the centre first, then of those outside, in blocks."""
    df = rows.select("class", F.explode("tokens").alias("h"), "cluster")
    common = df.groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("df"))
    weight = df.join(common, ["cluster", "h"]).groupBy("cluster", "class").agg(F.avg("df").alias("common"))
    centre = weight.groupBy("cluster").agg(F.max_by("class", F.struct("common", "class")).alias("class"))
    centres = rows.join(centre, ["cluster", "class"]).select(
        "cluster", F.col("class").alias("c_class"), F.col("n").alias("c_n"), F.col("tokens").alias("c_tokens")
    )
    overlap = F.size(F.array_intersect("tokens", "c_tokens"))
    compared = scratch.save(
        rows.join(centres, "cluster")
        .withColumn("linked", 100 * overlap >= PERCENT * (F.col("n") + F.col("c_n") - overlap))
        .withColumn("blocks", F.expr(f"elements div {max(1, cluster_elements // 2)} + 1"))
        .withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
        .drop("c_tokens", "c_n")
    )
    star = compared.where("linked").select(F.col("class").alias("a"), F.col("c_class").alias("b"))
    outside = compared.where("not linked").select("cluster", "class", "n", "tokens", "block", "blocks")
    # Blocks of those outside are as many as their elements ask for.
    ask = outside.groupBy("cluster").agg(
        F.expr(f"sum(size(tokens)) div {max(1, cluster_elements // 2)} + 1").alias("asks")
    )
    queries = outside.join(ask, "cluster").select(
        "cluster",
        F.pmod(F.xxhash64("class", F.lit(1)), "asks").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        "class",
        "n",
        "tokens",
    )
    against = compared.join(ask, "cluster").select(
        "cluster",
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("i"),
        F.col("block").alias("j"),
        *[F.col(c).alias(c) for c in ("class", "n", "tokens")],
    ).withColumn("cluster", F.col("cluster") + 0)
    pair = ["cluster", "i", "j"]
    found = queries.groupBy(*pair).cogroup(against.groupBy(*pair)).applyInPandas(
        _search_blocks, "a bigint, b bigint"
    )
    return star.unionByName(found)


def class_roots(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(class, root) of all classes with shingles; `linked` names the root of those that are linked."""
    classes = members.where("n > 0").select("class").distinct()
    return classes.join(linked.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("root", "class").alias("root")
    )


def link_documents(docs: DataFrame, scratch: Scratch, cluster_elements: int = CLUSTER) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text)."""
    table = classes_and_members(docs, scratch)
    members = table.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "class")
    roots = class_roots(members, link_classes(docs, table, scratch, cluster_elements))
    least = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(roots, "class")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = least.join(names, "root").select("class", "component_id")
    return members.join(by_class.withColumn("n0", F.lit(True)), "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None))
        .when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of linked texts one row, that of its smallest doc_id (then class, text hash, hash
    of the row); columns of `docs`. Rows without shingles or without doc_id stay. A doc_id that
    repeats with texts that are not linked keeps one row for each of them that no other row covers."""
    scratch = Scratch(docs.sparkSession)
    table = classes_and_members(docs, scratch)
    members = table.where("kind = 0 and a is not null").select(F.col("a").alias("doc_id"), "n", "class", "text")
    roots = class_roots(members, link_classes(docs, table, scratch))
    first = (
        members.where("n > 0")
        .groupBy("class")
        .agg(F.min(F.struct("doc_id", "class", "text")).alias("first"))
        .join(roots, "class")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select("first.doc_id", F.col("first.text").alias("text_hash"))
    )
    always = members.where("n = 0").select("doc_id", F.col("text").alias("text_hash")).distinct()
    wanted = first.withColumn("one", F.lit(True)).unionByName(always.withColumn("one", F.lit(False)))
    rows = in_struct(docs).select(
        "row", field("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(field("text")).alias("text_hash")
    )
    same = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"))
    kept = (
        rows.join(wanted, ["doc_id", "text_hash"])
        .withColumn("number", F.row_number().over(same))
        .where("number = 1 or not one")
    )
    return from_struct(kept.select("row").unionByName(rows.where("doc_id is null").select("row")), docs)
