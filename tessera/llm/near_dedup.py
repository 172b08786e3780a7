"""Near-duplicate classes of documents by DartMinHash bands, exact checks and connected components.

1. Equal texts become one node. 2. Each node's word shingles get a DartMinHash signature, cut into bands; nodes with an
equal band share a bucket. 3. In each bucket every node is paired with a few centers, so the pairs grow with the rows,
not with a bucket's square, and each pair's similarity is computed from the shingles themselves. 4. Linked nodes form
components. 5. Buckets of which the centers don't cover all pairs, and whose nodes are still in several components, are
compared in blocks inside tasks: all nodes outside a bucket's largest component against all others. Thus every two
nodes with an equal band are either in one component or compared. 6. Before that, very wide buckets are cut into
narrower ones by a further signature of many more bands, with its own centers; two similar nodes then share a narrow
bucket with a chance above 0.999, so the blocks' work doesn't grow with a wide bucket's square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, fresh, joined_by_weight, pinned, shingle_hashes, slices, strings, text_or_empty, weight_sums
from .dartminhash import band_keys, signatures

COORDINATES = 64
BANDS = 16
SIMILARITY = 0.8
BLOCK = 128
WIDE = 20_000  # nodes of a bucket from which it is cut by the further signature
FURTHER_BANDS, FURTHER_ROWS = 48, 8


def element_weights(doc: np.ndarray, hashes: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct shingles of each text and their weights: one each (set), their counts, or 1 + ln of these (log)."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    if weighting == "set":
        return doc[at], hashes[at], None
    counts = np.diff(np.append(at, len(doc))).astype(np.float64)
    return doc[at], hashes[at], counts if weighting == "count" else 1 + np.log(counts)


def node_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def banded(docs: DataFrame, words: int, coordinates: int, bands: int, weighting: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, bands): the text's hash, and its band keys, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "text")
            for a, b in slices(array):
                doc, hashes, weight = element_weights(*shingle_hashes(array.slice(a, b - a), words), weighting)
                signature, some = signatures(doc, hashes, b - a, coordinates, weight)
                keys = band_keys(signature, bands).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("node").slice(a, b - a), lists], names=["doc_id", "node", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("node", node_of(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, node binary, bands array<bigint>")


def shingle_sets(rows: DataFrame, words: int, weighting: str) -> DataFrame:
    """(node, codes, weights) from (node, text): distinct shingles as sorted 32-bit codes, and weights unless all are 1.

    Among a text's n shingles two have one code with a chance of about n * n / 2 ** 33.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = strings(batch, "text")
            for a, b in slices(array):
                doc, hashes, weight = element_weights(*shingle_hashes(array.slice(a, b - a), words), weighting)
                codes = (hashes >> np.uint64(32)).astype("<u4")  # sorted, as the hashes are
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                columns = [
                    batch.column("node").slice(a, b - a),
                    pa.array([codes[s:e].tobytes() for s, e in spans], pa.binary()),
                    pa.array([b"" if weight is None else weight[s:e].astype("<f4").tobytes() for s, e in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "codes", "weights"])

    return rows.mapInArrow(run, "node binary, codes binary, weights binary")


def loaded(codes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(codes, "<u4")
    return found, np.frombuffer(weights, "<f4") if weights else np.ones(len(found), np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the smaller weights over that of the larger ones."""
    _, left, right = np.intersect1d(a[0], b[0], return_indices=True)
    shared = float(np.minimum(a[1][left], b[1][right]).sum())
    union = float(a[1].sum() + b[1].sum()) - shared
    return shared / union if union else 1.0


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is least or more."""
    left = sets.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"), F.col("weights").alias("weights_a"))
    right = sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"), F.col("weights").alias("weights_b"))
    # sizes alone rule many pairs out before the second set is fetched
    joined = pairs.join(left, "a").join(right, "b")
    if least > 0:
        small, large = F.least(F.octet_length("codes_a"), F.octet_length("codes_b")), F.greatest(F.octet_length("codes_a"), F.octet_length("codes_b"))
        joined = joined.where((F.octet_length("weights_a") > 0) | (small >= least * large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("codes_a", "weights_a", "codes_b", "weights_b")]
            good = [similarity(loaded(ca, wa), loaded(cb, wb)) >= least for ca, wa, cb, wb in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "codes_a", "weights_a", "codes_b", "weights_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in the links (a, b): comp is the component's smallest node.

    Each round takes the neighbours' smallest label and then that label's own label; it ends when nothing changes.
    """
    both = pinned(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # a center has many links, and a large component many nodes; neither may bring them all to one task
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"), F.count("*").alias("links"))
    labels = pinned(first.select("node", F.least("node", "comp").alias("comp"), "links"))
    sums = weight_sums(labels, "links")

    def mark(found: DataFrame) -> tuple:
        return tuple(found.agg(F.count("*"), F.sum(F.xxhash64("node", "comp").cast("decimal(38,0)"))).first())

    last = mark(labels)
    while True:
        beside = joined_by_weight(both, labels.select(F.col("node").alias("b"), "comp", "links"), "b", "links", sums)
        near = beside.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        closer = pinned(labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), "links"))
        sizes = closer.groupBy("comp").agg(F.count("*").alias("n"))
        above = pinned(sizes.join(closer.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp"))
        labels = pinned(joined_by_weight(closer, above, "comp", "n").select("node", F.least("comp", "up").alias("comp"), "links"))
        now = mark(labels)
        if now == last:
            return labels.select("node", "comp")
        last = now


def block_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """For one block of a bucket's fringe and one of its members: a link from each fringe node to each other component that it meets."""
    sides = [rows[rows.fringe], rows[~rows.fringe]]
    if any(s.empty for s in sides):
        return pd.DataFrame({"a": [], "b": []})
    sets = [[loaded(c, w) for c, w in zip(s.codes, s.weights, strict=True)] for s in sides]
    sums = [np.array([w.sum() for _, w in s]) for s in sets]
    owners = [np.repeat(np.arange(len(s)), [len(c) for c, _ in s]) for s in sets]
    codes = [np.concatenate([c for c, _ in s]) if s else np.zeros(0, np.uint32) for s in sets]
    weights = [np.concatenate([w for _, w in s]) if s else np.zeros(0, np.float32) for s in sets]
    common = np.intersect1d(codes[0], codes[1])
    shared = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    plain = all((w == 1).all() for w in weights)
    step = 4096 if plain else 256
    for at in range(0, len(common), step):
        some = common[at : at + step]
        grids = []
        for owner, code, weight, members in zip(owners, codes, weights, sets, strict=True):
            place = np.searchsorted(some, code)
            inside = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == code)
            grid = np.zeros((len(members), len(some)), np.float32)
            grid[owner[inside], place[inside]] = weight[inside]
            grids.append(grid)
        if plain:
            shared += grids[0] @ grids[1].T
        else:
            for k, row in enumerate(grids[0]):
                shared[k] += np.minimum(row, grids[1]).sum(axis=1)
    union = sums[0][:, None] + sums[1][None, :] - shared
    comps = [s.comp.tolist() for s in sides]
    good = shared >= np.float32(least) * union - 1e-6 * union
    out: dict[tuple, tuple] = {}
    nodes = [s.node.tolist() for s in sides]
    for i, j in zip(*np.nonzero(good), strict=True):
        if comps[0][i] != comps[1][j] and (nodes[0][i], comps[1][j]) not in out and similarity(sets[0][i], sets[1][j]) >= least:
            out[nodes[0][i], comps[1][j]] = (comps[0][i], comps[1][j])
    return pd.DataFrame(list(set(out.values())), columns=["a", "b"])


def residual_links(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between components, from buckets whose nodes are in several of them.

    members: (key, node) of the buckets with pairs that no center covered.
    """
    named = pinned(members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    buckets = pinned(
        largest.select(
            "key",
            "all",
            F.col("top.comp").alias("top"),
            F.ceil(F.col("all") / block).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("fringes"),
        )
    )
    rows = joined_by_weight(named, buckets, "key", "all").withColumn("fringe", F.col("comp") != F.col("top"))
    here = F.xxhash64("node", "key")
    as_member = rows.select("key", "node", "comp", F.lit(False).alias("fringe"), F.pmod(here, F.col("blocks")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("fringes") - 1)).alias("fb"))
    as_fringe = rows.where("fringe").select("key", "node", "comp", "fringe", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"), F.pmod(here, F.col("fringes")).cast("int").alias("fb"))
    dealt = as_member.unionByName(as_fringe).join(sets, "node")
    return dealt.groupBy("key", "fb", "mb").applyInPandas(lambda rows: block_links(rows, least), "a binary, b binary").distinct()


def bucketed(spread: DataFrame) -> DataFrame:
    """(key, node) rows of buckets of two nodes and more, with the bucket's size and centers."""
    # the smallest and the largest node cover all pairs of three nodes; two more by hash
    centers = [F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")), F.max_by("node", F.xxhash64("node"))]
    buckets = pinned(spread.groupBy("key").agg(F.count("*").alias("n"), *[c.alias(f"c{k}") for k, c in enumerate(centers)]).where("n > 1"))
    return pinned(spread.join(buckets, "key"))


def center_pairs(members: DataFrame) -> DataFrame:
    """Each node of a bucket with the bucket's centers, every pair once."""
    paired = members.select("node", F.explode(F.array_distinct(F.array("c0", "c1", "c2", "c3"))).alias("center")).where("node != center")
    return pinned(paired.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())


def narrowed(members: DataFrame, labels: DataFrame, sets: DataFrame, bands: int = FURTHER_BANDS, rows: int = FURTHER_ROWS) -> DataFrame:
    """(key, node) of narrower buckets: wide ones with several components, cut by a further signature's bands."""
    named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    kept = pinned(named.join(mixed, "key").select("key", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                found = [loaded(c, w) for c, w in zip(some.column("codes").to_pylist(), some.column("weights").to_pylist(), strict=True)]
                doc = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
                codes = np.concatenate([c for c, _ in found]).astype(np.uint64) + np.uint64(1 << 40)
                signature, _ = signatures(doc, codes, len(found), bands * rows, np.concatenate([w for _, w in found]).astype(np.float64))
                keys = band_keys(signature, bands).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "further"])

    further = kept.select("node").distinct().join(sets, "node").select("node", "codes", "weights").mapInArrow(run, "node binary, further array<bigint>")
    return kept.join(further, "node").select(F.explode("further").alias("sub"), "key", "node").select(F.xxhash64("key", "sub").alias("key"), "node")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links (a, b) between nodes or components have joined components."""
    ends = pinned(links)  # read as they are, so that joins on a large component's many links can be split
    for side in ("a", "b"):
        names = labels.select(F.col("node").alias(side), F.col("comp").alias("_comp"))
        ends = ends.join(names, side, "left").withColumn(side, F.coalesce("_comp", side)).drop("_comp")
    names = components(ends.where("a != b").select("a", "b")).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    alone = names.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    sizes = labels.groupBy(F.col("comp").alias("old")).agg(F.count("*").alias("n"))
    renamed = pinned(sizes.join(names, "old", "left").select("old", F.coalesce("new", "old").alias("comp"), "n"))
    merged = joined_by_weight(labels.select("node", F.col("comp").alias("old")), renamed, "old", "n").select("node", "comp")
    return pinned(merged.unionByName(alone))


def node_components(
    docs: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY, coordinates: int = COORDINATES, bands: int = BANDS, weighting: str = "set", block: int = BLOCK, wide: int = WIDE, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, bands) of all rows, and (node, comp) of the nodes with links."""
    prints = pinned(banded(docs, words, coordinates, bands, weighting, id_col, text_col))
    texts = prints.groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first_id"))
    members = bucketed(texts.select("node", F.explode("bands").alias("key")))
    pairs = center_pairs(members)
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(texts.select("node", "first_id"), "node")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("node", node_of(F.col("text")))
    found = rows.join(involved.withColumnRenamed("node", "_node"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("_node")))
    # nodes that are in buckets of four and more may be compared again
    sets = pinned(shingle_sets(found.select("node", "text"), words, weighting))
    if sets.groupBy("node").count().where("count > 1").take(1):  # repeated rows: one set for each text
        sets = pinned(sets.dropDuplicates(["node"]))
    labels = components(checked(pairs, sets, least))
    open_members = members.where(f"n > 3 AND n <= {wide}").select("key", "node")
    large = members.where(f"n > {wide}")
    if large.take(1):
        narrow = bucketed(narrowed(large, labels, sets))
        labels = relabelled(labels, checked(center_pairs(narrow), sets, least))
        open_members = open_members.unionByName(narrow.where("n > 3").select("key", "node"))
    return prints, relabelled(labels, residual_links(open_members, labels, sets, least, block))


def named_nodes(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, bands) of all rows, and (node, comp, first_id, n): each text's component, smallest id and rows."""
    prints, labels = node_components(docs, **options)
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return prints, pinned(nodes.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first_id", "n"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size) for each row of docs; class_id is the smallest doc_id of the row's class.

    Texts whose shingle similarity is 0.8 or more are linked, and classes are the components of the links, equal texts
    included. A null text counts as empty; empty texts are equal, so they form a class. Texts of fewer words than a
    shingle have one shingle. Repeated rows come out as often as they go in. A null id has no say in class_id, which
    is null only for a class without any other. An empty table gives no rows; other columns are ignored.
    """
    prints, named = named_nodes(docs, **options)
    classes = pinned(named.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("nodes")))
    by_node = pinned(joined_by_weight(named.select("node", "comp", "n"), classes, "comp", "nodes").select("node", "class_id", "class_size", "n"))
    return joined_by_weight(prints.select("doc_id", "node"), by_node, "node", "n").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one with the smallest id, and of such the one with the smallest hash of the text.

    A null id comes after all others, so a class without any other keeps a row with a null id. Columns are kept.
    """
    id_, node, keep = fresh(docs, "id", "node", "keep")
    _, named = named_nodes(docs, id_col=id_col, text_col=text_col, **options)
    best = F.min(F.struct(F.col("first_id").isNull().alias("without"), F.col("first_id").alias("id"), F.col("node").alias("node")))
    kept = named.groupBy("comp").agg(best.alias("best")).select(F.col("best.id").alias(id_), F.col("best.node").alias(keep))
    rows = docs.withColumn(node, node_of(text_or_empty(text_col)))
    found = rows.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(node) == F.col(keep)), "left_semi")
    return found.dropDuplicates([id_col, node]).drop(node)
