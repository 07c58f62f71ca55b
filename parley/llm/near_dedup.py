"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

Two permutations give all signature coordinates: ``sigma`` places a shingle on a ring, and
coordinate k is the smallest value that ``pi`` has k steps after a placed shingle (C-MinHash,
Li and Li, 2022). A shingle's values for all coordinates are therefore one slice of ``pi``.

1. Texts with equal shingle sets become one class. A class has a signature of 252 coordinates
   in 36 bands of 7; at a similarity of 0.85 two classes miss each other in all bands once in
   a million. The pipeline's stage links from 0.80 on, with 46 bands of 6 for the same odds.
2. In each band bucket, every class is compared with one hub, the member that the most others
   collide with. Confirmed links form components, which empties the large buckets.
3. Pairs of a bucket that are still in different components are all compared, in square blocks
   of bounded size, by a longer signature; those that may reach the threshold are confirmed.

Only confirmed links count. A link is confirmed on the full sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Powers, as_bytes, gram_hashes, map_batches, mixed, only, word_hashes, written
from parley.llm.components import components

SHINGLE = 5
BANDS, ROWS = 36, 7
#: What the pipeline's stage links at, and bands with one miss in a million there.
STAGE_PERCENT, STAGE_BANDS, STAGE_ROWS = 80, 46, 6
RING = 1 << 22
#: Coordinates of the longer signature, one byte each, and how many of them are read first.
LONG, SHORT = 1024, 128
#: Standard deviations below the threshold at which a signature still counts as possible.
MARGIN = 5.0
#: The column that numbers rows.
ROW = "__row"
#: Classes along one side of a block of comparisons.
BLOCK = 2048
SEED = 5


def linked(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept), one row per row of ``documents`` (doc_id, text).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of 5-word
    shingles (A-Z lower-cased). ``component_id`` is the smallest doc_id reachable, ``kept``
    marks its holder. A null or wordless text has an empty set and no link. A null doc_id is
    passed over when a smaller id is sought: it stays null only where no linked row has an id.
    Rows that repeat a doc_id are documents of their own; those that hold the smallest are kept.
    """
    signed = written(_signed(documents, bands, rows), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    member = components(_links(documents, signed, percent))
    least = classes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(smallest, "root").select("node", "component_id")
    out = only(signed, "doc_id", "n_shingles", "node").join(named, "node", "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept")
    )


def deduplicated(documents: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``documents`` without all but one of each group, all columns kept.

    Each row is a document of its own, also where rows repeat a doc_id or have none. Of a group
    the row with the smallest doc_id stays, of several such rows one; a row without a doc_id
    stays only if no row of its group has one. Wordless texts are in no group and stay.
    """
    numbered = written(documents.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = linked(numbered.select(F.col(ROW).alias("doc_id"), "text"), percent, bands, rows)
    grouped = numbered.select(ROW, "doc_id").join(found.select(F.col("doc_id").alias(ROW), "component_id"), ROW)
    # Groups of one row, nearly all, drop out before the join back.
    first = grouped.groupBy("component_id").agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias("first")
    ).filter("size > 1")
    going = grouped.join(first, "component_id").filter(F.col(ROW) != F.col("first")).select(ROW)
    return numbered.join(going, ROW, "left_anti").select(*[f"`{n}`" for n in documents.columns])


def _shingles(text: bytes | None, powers: Powers) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text.lower() if text else None, powers)  # bytes.lower() touches A-Z alone
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    return np.unique(gram_hashes(words, size) + np.uint64(size))


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """``sigma``, and ``pi`` as rows of ``coordinates`` values that start one step apart."""
    draw = np.random.default_rng(SEED)
    sigma = draw.permutation(RING).astype(np.uint32)
    pi = draw.permutation(RING).astype(np.uint32)
    round_ = np.concatenate([pi, pi[:coordinates]])
    return sigma, np.lib.stride_tricks.sliding_window_view(round_, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    sigma, slices = _permutations(coordinates)
    places = sigma[(shingles & np.uint64(RING - 1)).astype(np.int64)]
    least = np.full(coordinates, RING, np.uint32)
    for start in range(0, len(places), 4096):
        np.minimum(least, slices[places[start : start + 4096]].min(axis=0), out=least)
    return least


def _node(shingles: np.ndarray) -> int:
    """A class: one number for one set."""
    return np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64).item()


def _signed(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, node, keys): the class and the band keys of every document."""

    def sign(batches):
        powers = Powers()
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in batch["text"]:
                shingles = _shingles(text, powers)
                sizes.append(len(shingles))
                nodes.append(_node(shingles) if len(shingles) else None)
                signatures.append(signature(shingles, bands * rows))
            keys = np.array(signatures, np.uint64).reshape(-1, bands, rows)
            total = np.broadcast_to(np.arange(bands, dtype=np.uint64), keys.shape[:2]).copy()
            for row in range(rows):
                total = mixed(total * np.uint64(RING) + keys[:, :, row])
            yield {
                "doc_id": pa.array(batch["doc_id"], pa.int64()),
                "n_shingles": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.int64()),
                "keys": pa.array([k if n else None for k, n in zip(total.astype(np.int64), sizes)], pa.list_(pa.int64())),
            }

    texts = documents.select("doc_id", as_bytes("text").alias("text"))
    return map_batches(texts, sign, "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>")


def _links(documents: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes; every component is connected by them."""
    keys = signed.filter("n_shingles > 0").groupBy("node").agg(F.first("keys").alias("keys"))
    placed = keys.select("node", F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(placed.join(shared, "key"), "buckets")
    # The hub of a bucket is the member that most others collide with: near the middle of a group.
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = buckets.join(weight, "node")
    hub = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    to_hub = (
        buckets.join(hub, "key").filter(F.col("hub.node") != F.col("node"))
        .groupBy("node").agg(F.max("hub").alias("hub"))
        .select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    )
    sets = written(_sets(documents, signed, weight).join(keys, "node"), "sets")
    first = written(_confirmed(to_hub, sets, percent), "confirmed")
    rest = _confirmed(_possible(buckets, components(first), sets, percent), sets, percent)
    return first.union(rest)


def _sets(documents: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of the classes that share a bucket, each from one of its documents."""
    picked = signed.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi")
    lone = signed.filter("doc_id is null and node is not null").select("node").distinct()
    lone = lone.join(nodes, "node", "left_semi").join(picked, "node", "left_anti")
    texts = documents.select("doc_id", as_bytes("text").alias("text"))
    by_id = texts.join(picked.select("doc_id").distinct(), "doc_id", "left_semi")
    without = texts.filter("doc_id is null") if not lone.isEmpty() else None
    chosen = by_id.unionByName(without) if without is not None else by_id

    def sets(batches):
        powers = Powers()
        for batch in batches:
            found = [s for s in (_shingles(text, powers) for text in batch["text"]) if len(s)]
            yield {
                "node": pa.array([_node(s) for s in found], pa.int64()),
                "shingles": pa.array([s.tobytes() for s in found], pa.binary()),
                "sketch": pa.array([signature(s, LONG).astype(np.uint8).tobytes() for s in found], pa.binary()),
            }

    made = map_batches(chosen.select("text"), sets, "node bigint, shingles binary, sketch binary")
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def confirm(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"]):
                one, other = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            yield {n: pa.array([v for v, k in zip(batch[n], keep) if k], pa.int64()) for n in ("a", "b")}

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), confirm, "a bigint, b bigint")


def _possible(buckets: DataFrame, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket, in different components, whose sketches may reach the threshold."""
    labelled = buckets.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_ = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_ = labelled.join(mixed_, "key", "left_semi")
    # A bucket of more than BLOCK members is compared in square blocks; each member meets each block once.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pieces = met.select(
        "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root"
    ).join(sets.select("node", "sketch", "keys"), "node")
    needed = _needed(percent / 100)

    def compare(batches):
        for group in _groups(batches):
            yield _block_pairs(group, needed)

    sorted_ = pieces.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return map_batches(sorted_, compare, "a bigint, b bigint")


def _needed(threshold: float) -> dict[int, int]:
    """Equal coordinates that a linked pair has, but for MARGIN standard deviations."""
    return {n: int(n * threshold - MARGIN * (n * threshold * (1 - threshold)) ** 0.5) for n in (SHORT, LONG)}


def _groups(batches):
    """Rows of one (key, low, high) at a time, from sorted batches; a group has at most two blocks."""
    held: dict[str, list] = {}
    for batch in batches:
        for n, values in batch.items():
            held.setdefault(n, []).extend(values)
        keys = np.stack([np.array(held[n], np.int64) for n in ("key", "low", "high")])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        start = 0
        for end in ends:
            yield {n: values[start:end] for n, values in held.items()}
            start = end
        held = {n: values[start:] for n, values in held.items()}
    if held and held["key"]:
        yield held


def _block_pairs(group: dict, needed: dict[int, int]) -> dict:
    node, root, own = (np.array(group[n], np.int64) for n in ("node", "root", "own"))
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, LONG)
    short = np.ascontiguousarray(sketch[:, :SHORT])
    low, high, band = group["low"][0], group["high"][0], group["band"][0]
    keys = np.array(group["keys"], np.int64)
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    first, second = [], []
    for i in left:
        others = right[right > i] if low == high else right
        others = others[root[others] != root[i]]
        others = others[(short[others] == short[i]).sum(axis=1) >= needed[SHORT]]
        others = others[(sketch[others] == sketch[i]).sum(axis=1) >= needed[LONG]]
        # A pair belongs to the first band that it shares.
        others = others[~(keys[others, :band] == keys[i, :band]).any(axis=1)]
        first += [node[i]] * len(others)
        second += node[others].tolist()
    pairs = np.array([first, second], np.int64)
    return {"a": pa.array(pairs.min(axis=0), pa.int64()), "b": pa.array(pairs.max(axis=0), pa.int64())}
