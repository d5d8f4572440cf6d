"""Near copies by 64-bit fingerprints: BK-trees over shards that share a block of bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import components, map_batches

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once; longer texts are counted piece by piece.
PIECE = 1 << 15
#: Fingerprints in one tree. A shard with more is cut into several trees and every one of its
#: fingerprints is looked up in each of them.
TREE_ROWS = 4096


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is set when it is set in over half of the shingle hashes.

    Only A-Z is lower-cased and only ASCII white space splits words. Fewer words than a shingle give
    one shingle of all of them; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), PIECE):
        spans = zip(starts[at : at + PIECE], stops[at : at + PIECE])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(stops)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def transform():
        def step(batch: pa.RecordBatch) -> list[list]:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            return [batch.column(0), [signed(fingerprint(t or b"", shingle_words)) for t in texts]]

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).cast("string")), transform, f"key {kind}, fp long")


class BKTree:
    """Fingerprints keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
        node = self.root
        while node != value:
            edges = self.children[node]
            distance = (node ^ value).bit_count()
            if distance not in edges:
                edges[distance], self.children[value] = value, {}
            node = edges[distance]

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` bits away. A child over an edge d can only lead to values whose
        distance to the query differs from the node's own by d at most, so other edges are not followed."""
        found, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            todo += [child for edge, child in self.children[node].items() if abs(edge - distance) <= radius]
        return found


class Forest:
    """Union-find over the values of one tree: only links that join two parts are passed on."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, value: int) -> int:
        root = value
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while (up := self.parent[value]) != root:
            self.parent[value], value = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def block_masks(values: int, radius: int) -> list[int]:
    """Masks such that fingerprints within ``radius`` agree under at least one.

    The 64 bits are cut into ``blocks`` runs; ``radius`` differing bits touch at most ``radius`` runs, so
    the others agree. More blocks are used for more fingerprints, until few share a masked value by chance.
    """
    blocks = radius + 1
    while blocks < 3 * radius + 1 and values >> (BITS * (blocks - radius) // blocks) > 2:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (high - low)) - 1) << low for low, high in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(runs, max(1, blocks - radius))]


def tree_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links found in each tree. Rows come sorted by shard, tree and then members before visitors."""
    held, tree, forest = None, BKTree(), Forest()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        found: list[tuple[int, int]] = []
        names = ("mask_no", "masked", "tree_no", "home", "fp")
        for mask_no, masked, tree_no, home, fp in zip(*(batch.column(n).to_pylist() for n in names)):
            if (mask_no, masked, tree_no) != held:
                held, tree, forest = (mask_no, masked, tree_no), BKTree(), Forest()
            value = fp % (1 << BITS)
            found += [(fp, signed(other)) for other in tree.within(value, radius) if forest.join(value, other)]
            if home == 0:
                tree.add(value)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(side), pa.int64()) for side in zip(*found)], schema=schema)


def links(values: DataFrame, radius: int = 2, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    Fingerprints that agree under a mask form a shard; each shard has its own tree and passes on a
    spanning forest of its links, never all pairs. A tree travels to its shard's rows by the shuffle
    and is not broadcast, because the trees grow with the data.
    """
    values = values.select("fp")
    masks = block_masks(values.count(), radius)
    keyed = values.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask_no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("masked")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("mask_no", "masked").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["mask_no", "masked"])
    trees = F.ceil(F.col("n") / F.lit(tree_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    placed = sized.select(
        "mask_no", "masked", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree_no")
    ).select("mask_no", "masked", "tree_no", (F.col("own") != F.col("tree_no")).cast("int").alias("home"), "fp")
    order = ["mask_no", "masked", "tree_no"]
    return placed.repartition(*order).sortWithinPartitions(*order, "home", "fp").mapInArrow(
        lambda batches: tree_links(batches, radius), "a long, b long"
    )


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp`` and ``component_id``.

    Equal fingerprints are one value, so copies are never compared with each other. ``component_id`` is
    the smallest key among the rows reachable over links. Null and empty texts and texts without words
    have fingerprint 0 and link like any other. Rows that repeat a key stay separate rows; a null key
    never becomes a component id unless all keys of the component are null. Other columns are ignored.
    """
    prints = stage(fingerprints(docs, key, text, shingle_words), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(values, radius))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(F.col("key").alias(key), "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
