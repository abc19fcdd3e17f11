"""SimHash near-dedup with vantage-point trees.

A fingerprint has a bit where over half of a text's word-shingle hashes have it;
repeated shingles count each time. Fingerprints that differ in at most
``max_distance`` bits are linked, and linked ones form groups.

1. Fingerprints are made where the rows are (no shuffle, text by text) and stored
   with their ids; equal ones become one point before anything is compared.
2. A vantage-point tree is fitted on a bounded sample of points (``sample`` at most)
   and sent to all tasks. A node holds a pivot and a radius. Every point goes to its
   home leaf. A point outside a radius but within ``max_distance`` of it is sent
   along, as a visitor, to the shards inside whose region its ball reaches; by the
   triangle inequality all other branches can hold no partner. Of two linked points
   in different leaves, one visits the other's home, so no link is lost.
3. Each leaf cuts itself by further pivots in the same way until its parts are small
   enough to compare, and keeps a spanning forest of the links it finds, at most one
   link a point, never all pairs.
4. The forests are joined by large-star and small-star rounds, whose tables are
   written to the shared folder each round.

Leaves hold about ``leaf_points`` points, a few MB with their visitors: the cuts that
a task can make in its memory send no copies over the network. The tree has at most
``max_leaves`` leaves; beyond that the leaves grow and step 3 cuts them further, so it
bounds what is sent to the tasks, not what is found.

Cases: null texts are empty; a text of no words has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; repeated rows have equal
fingerprints and one group; a null id is never the smallest of a group unless all its
ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import hash_sample, id_and_text, one, prepare, schema_of
from runforge.session import materialize

#: Shingles whose bits are counted at once.
COUNTED = 1 << 18


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, COUNTED):
        last = min(k + COUNTED, n)
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in
                           zip(starts[k:last].tolist(), ends[k + shingle - 1:last + shingle - 1].tolist())], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _fp): the fingerprint of each row as a signed long."""
    schema = schema_of(df, id_col, ("_fp", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=schema.names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


# --- vantage points ----------------------------------------------------------------------------

def distance(points: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int64)


def choose_cut(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A pivot and radius that part the points with few of them near the boundary; None if none parts them."""
    best = None
    for pivot in points[rng.integers(0, len(points), size=12)]:
        counts = np.bincount(distance(points, pivot), minlength=65 + reach)
        inside = np.cumsum(counts)
        for radius in range(64):
            a = inside[radius] / len(points)
            if 0.1 <= a <= 0.9:
                near = (inside[radius + reach] - inside[max(radius - reach, 0)]) / len(points)
                # depth gained against points doubled
                worth = -(a * np.log2(a) + (1 - a) * np.log2(1 - a)) / np.log2(1.05 + near)
                if best is None or worth > best[0]:
                    best = worth, int(pivot), radius
    return best and best[1:]


def fit_tree(points: np.ndarray, leaves: int, reach: int) -> np.ndarray:
    """Nodes (pivot, radius, inside, outside); a child below zero is the leaf ``-1 - child``."""
    rng = np.random.default_rng(7)
    nodes: list[list[int]] = []
    waiting, n_leaves = [(points, None, 2)], 0
    least = max(len(points) // max(leaves, 1), 8)
    for part, parent, side in waiting:
        cut = choose_cut(part, reach, rng) if len(part) > least else None
        if cut is None:
            here, n_leaves = -1 - n_leaves, n_leaves + 1
        else:
            here = len(nodes)
            nodes.append([*cut, 0, 0])
            near = distance(part, np.uint64(cut[0])) <= cut[1]
            waiting += [(part[near], here, 2), (part[~near], here, 3)]
        if parent is not None:
            nodes[parent][side] = here
    return np.array(nodes, dtype=object).reshape(-1, 4)


def place(points: np.ndarray, tree: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, visitor) rows: each point's home, and the leaves where it may have partners it must visit."""
    out = []
    waiting = [(0 if len(tree) else -1, np.arange(len(points)), np.zeros(len(points), dtype=bool))]
    while waiting:
        node, who, visits = waiting.pop()
        if not len(who):
            continue
        if node < 0:
            out.append((who, np.full(len(who), -1 - node), visits))
            continue
        pivot, radius, inside, outside = tree[node]
        d = distance(points[who], np.uint64(pivot))
        near = d <= radius
        # a point outside visits the inside; a visitor goes wherever its ball reaches
        to_in = near | (d <= radius + reach)
        to_out = ~near | (visits & (d + reach > radius))
        waiting.append((inside, who[to_in], (visits | ~near)[to_in]))
        waiting.append((outside, who[to_out], (visits | near)[to_out]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(home: np.ndarray, guests: np.ndarray, reach: int, small: int = 2048) -> np.ndarray:
    """Rows (point, root): a spanning forest of the links between home points and from guests to home points."""
    points = np.concatenate([home, guests])
    label = np.arange(len(points))
    rng = np.random.default_rng(11)

    def join(i: int, others: np.ndarray) -> None:
        """Unite the trees of a point and of others; labels are parents, and smaller than their children."""
        told = np.append(others, i)
        top = label[told]
        while (up := label[top]).tobytes() != top.tobytes():
            top = up
        label[np.unique(top)] = label[told] = top.min()

    def compare(own: np.ndarray, came: np.ndarray) -> None:
        for rows, at_home in ((own, True), (came, False)):
            for k in range(0, len(rows), 256):
                some = rows[k:k + 256]
                close = np.bitwise_count(points[some][:, None] ^ points[own][None, :]) <= reach
                if at_home:  # not a point and itself
                    close[np.arange(len(some)), np.arange(k, k + len(some))] = False
                for i in np.flatnonzero(close.any(axis=1)).tolist():
                    join(int(some[i]), own[close[i]])

    waiting = [(np.arange(len(home)), np.arange(len(home), len(points)))]
    while waiting:
        own, came = waiting.pop()
        cut = choose_cut(points[own[rng.integers(0, len(own), size=2048)]], reach, rng) if len(own) > small else None
        if cut is None:
            compare(own, came)
            continue
        # as in the tree: points outside visit the inside, guests go wherever their ball reaches
        d, g = distance(points[own], np.uint64(cut[0])), distance(points[came], np.uint64(cut[0]))
        near = d <= cut[1]
        visitors = own[~near & (d <= cut[1] + reach)]
        if near.all() or not near.any():  # the sample had points on both sides, but they are too few
            compare(own, came)
            continue
        waiting.append((own[near], np.concatenate([visitors, came[g <= cut[1] + reach]])))
        waiting.append((own[~near], came[g + reach > cut[1]]))
    while (up := label[label]).tobytes() != label.tobytes():
        label = up
    linked = np.flatnonzero(label != np.arange(len(points)))
    return np.stack([points[linked], points[label[linked]]], axis=1)


# --- groups -------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v): its component's smallest node. Large-star and small-star rounds."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(low, "u")
        if large:
            moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = (near.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low.select("u", F.col("m").alias("v"))))
        return moved.where("u <> v").distinct()

    edges, before = materialize(links.where("u <> v").distinct(), "links"), None
    while True:
        edges = materialize(star(star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_links(points: DataFrame, max_distance: int, leaf_points: int, sample: int, max_leaves: int) -> DataFrame:
    """Links (u, v) that connect exactly the points (``_fp``, distinct) within ``max_distance``."""
    spark = points.sparkSession
    total = points.count()
    leaves = min(max(total // leaf_points, 1), max_leaves, sample // 16)
    drawn = hash_sample(points.select("_fp"), ["_fp"], sample).toPandas() if leaves > 1 else None
    fitted = fit_tree(drawn["_fp"].to_numpy(dtype=np.int64).view(np.uint64), leaves, max_distance) \
        if drawn is not None else np.zeros((0, 4), dtype=object)
    tree = spark.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column(0)).view(np.uint64)
            who, leaf, visits = place(found, tree.value, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(found[who].view(np.int64)),
                                              pa.array(visits)], names=["leaf", "fp", "visitor"])

    def search(group: pa.Table) -> pa.Table:
        found, visits = np.asarray(one(group.column("fp"))).view(np.uint64), np.asarray(one(group.column("visitor")))
        made = forest(found[~visits], found[visits], max_distance).view(np.int64)
        return pa.table({"u": pa.array(made[:, 0]), "v": pa.array(made[:, 1])})

    return (points.select("_fp").mapInArrow(deal, "leaf long, fp long, visitor boolean")
            .groupBy("leaf").applyInArrow(search, "u long, v long"))


def near_copies(df: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42, leaf_points: int = 65536,
                sample: int = 65536, max_leaves: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; ``fingerprint`` in 16 hex digits."""
    prepare(df.sparkSession)
    rows = materialize(fingerprints(df, shingle, seed, id_col, text_col), "fingerprints")
    points = materialize(rows.groupBy("_fp").agg(F.min(id_col).alias("_first")), "points")
    links = near_links(points, max_distance, leaf_points, sample, max_leaves)
    groups = components(links)
    member = points.join(groups, F.col("_fp") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_fp"))
    first = member.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = member.select("_fp", "_root").join(first, "_root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id",
                     text_col: str = "text", **more) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group, with the columns of ``df``; rows with a null id stay."""
    groups = near_copies(df, shingle, max_distance, id_col=id_col, text_col=text_col, **more)
    lost = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_lost_id")).distinct()
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"))
    return rows.join(lost, F.col("_doc") == F.col("_lost_id"), "left_anti").select("_row.*")
