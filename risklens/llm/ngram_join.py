"""Documents joined by the Jaccard similarity of their word n-gram sets.

A set of size at most M whose partner differs in at most D elements is split by
element hash into m = D + k parts.  Two sets differ in at most D of them, so at least
k parts hold the same elements.  Parts are ordered by the bits of a small parity sketch,
and the D + 1 fullest are the document's keys: if two documents share k of m parts,
those keys have one in common, and sparse parts that many documents share are left
out.  A key hashes all 64 bits of its part's elements, so that unrelated sets do not
share a key by chance, of which there would be more with the square of their number.  M and D belong to a size band; a document joins
the band of its size and the next one.

Sets that share a key are compared by a parity sketch of the whole set (1,024 bits,
two bits or more per element above 512; wider sketches fold into narrower ones by XOR).
With fewer bits, unrelated sets come as near as a band allows.  The
Hamming distance of two sketches is at most the symmetric difference, so a pair further
apart than the band's D is no link.  A task sends a set for a key only if it is further
than D / 4 from the smallest one there, and what meets afterwards is compared with the
bound D + 2 * (D / 4), which by the triangle inequality loses no link.

Sets near by sketch form a candidate family.  Families are verified on
exact sets: a breadth-first walk compares each reached set with all sets not yet
reached, which finds the exact components without going through all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.llm.records import aside, blocks, components, runs, small_join, unpack
from risklens.llm.textvec import U64, Hasher, Texts, mix, slices
from risklens.session import materialize

KEY = np.dtype([("key", "<u8"), ("node", "<u8")])
FLUSH = 1 << 20  # key records that a task compares among themselves before it sends them
BLOCK_SHINGLES = 1 << 21  # a larger family is verified in blocks of about so many elements
BLOCK_SKETCHES = 1 << 13  # sketches of one key that are compared in one block
SKETCH = 16  # 64-bit words of the narrow sketch, which serves for up to 1,024 elements within a task
BAND = U64(0xFFF)  # low bits of a key: its size band


@dataclass(frozen=True)
class JoinRules:
    """Sets of ``words``-word shingles; a link needs 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


def size_bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """First size of every band; a linked partner is in the same band or next to it."""
    edges = [1]
    while edges[-1] < top:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, dtype=np.int64)


def band_reach(percent: int, bands: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of two linked sets that meet in a size band."""
    return 2 * (bands[band + 1] - 1) * (100 - percent) // (100 + percent)


def shingle_sets(texts: Texts, words: int, hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; one shingle of all words if the
    text has fewer than ``words``."""
    starts, ends = texts.words()
    first = texts.split(starts)
    h = hasher.words(texts.data, starts, ends) if len(starts) else np.zeros(0, dtype=U64)
    n = max(len(h) - words + 1, 0)
    rolled = np.full(n, words, dtype=U64)
    for k in range(words):
        rolled = mix(rolled * U64(0x9FB21C651E98DF25) + h[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
            continue
        one = np.full(min(b - a, 1), b - a, dtype=U64)
        for x in h[a:b]:
            one = mix(one * U64(0x9FB21C651E98DF25) + x)
        out.append(one)
    return out


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit identity of each set (0 for an empty one), never negative as a long."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = mix(np.concatenate(sets) ^ U64(0x2545F4914F6CDD1D)) if len(sets) else np.zeros(0, dtype=U64)
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(flat)])
    ends = np.cumsum(sizes)
    node = mix(total[ends] - total[ends - sizes] + sizes.astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(1)
    return np.where(sizes > 0, np.maximum(node, 1), 0).astype(U64)


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """The sketch of ``width`` words, a power of two, of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, width), axis=0)


def whole_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Parity sketches of whole sets: all of ``SKETCH`` words, and each as wide as its
    set needs (at least two bits per element)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    narrow = np.zeros((len(sets), SKETCH), dtype=U64)
    if not sizes.sum():
        return narrow, [row.tobytes() for row in narrow]
    spot = mix(np.concatenate(sets) + U64(0x632BE59BD9B4E019))
    bit = U64(1) << (spot & U64(63))
    word = spot >> U64(6)
    np.bitwise_xor.at(narrow, (np.repeat(np.arange(len(sets)), sizes), (word & U64(SKETCH - 1)).astype(np.int64)), bit)
    bodies = [row.tobytes() for row in narrow]
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes > 32 * SKETCH).tolist():
        width = 1 << (int(sizes[i]) // 32).bit_length()
        own = slice(int(ends[i] - sizes[i]), int(ends[i]))
        wide = np.zeros(width, dtype=U64)
        np.bitwise_xor.at(wide, (word[own] & U64(width - 1)).astype(np.int64), bit[own])
        bodies[i] = wide.tobytes()
    return narrow, bodies


def parity_keys(sets: list[np.ndarray], percent: int, bands: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets for the band of their size (``ahead`` 0) or the next (1), and
    which set each belongs to."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=U64)
    band = np.searchsorted(bands, np.maximum(sizes, 1), side="right") - 1 + ahead
    differ = band_reach(percent, bands, band)
    parts = differ + 1 + -(-(differ + 1) // 4)
    # equal sets have one node, so a band without differences needs no key
    active = (sizes > 0) & (differ > 0)
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = active[owner]
    flat, owner = flat[keep], owner[keep]
    # sets are sorted, and a part is a range of hashes, so parts lie in order
    part = ((flat >> U64(32)) * parts[owner].astype(U64)) >> U64(32)
    content = mix(flat)
    heads = runs(owner, part)
    if not len(heads):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    word = np.bitwise_xor.reduceat(U64(1) << (content & U64(63)), heads)  # 64 parity bits, for the order
    fine = np.bitwise_xor.reduceat(mix(content + U64(1)), heads)  # all bits of the elements
    have, index = owner[heads], part[heads].astype(np.int64)
    bits = np.bitwise_count(word).astype(np.int64)
    # the fullest parts first, then by number; empty parts come last
    order = np.argsort((have << 38) | ((64 - bits) << 31) | index, kind="stable") if index.max(initial=0) < 1 << 31 else np.lexsort((index, -bits, have))
    have, index, word, fine = have[order], index[order], word[order], fine[order]
    first = runs(have)
    place = np.arange(len(have)) - np.repeat(first, np.diff(np.append(first, len(have))))
    chosen = place <= differ[have]
    have, index, word, fine = have[chosen], index[chosen], word[chosen], fine[chosen]
    # sets with fewer filled parts than keys also use empty parts, in order
    counts = np.bincount(have, minlength=len(sets))
    for i in np.flatnonzero(active & (counts < differ + 1)).tolist():
        filled = set(part[owner == i].astype(np.int64).tolist())
        free = [p for p in range(int(parts[i])) if p not in filled][: int(differ[i]) + 1 - int(counts[i])]
        have = np.append(have, np.full(len(free), i))
        index = np.append(index, np.array(free, dtype=np.int64))
        word, fine = (np.append(x, np.zeros(len(free), dtype=U64)) for x in (word, fine))
    place_key = mix((band[have].astype(U64) << U64(40)) + index.astype(U64) + U64(1))
    return (mix(word ^ mix(fine ^ place_key)) & ~BAND) | band[have].astype(U64), have


def near_pivots(records: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For key records of one task: those to send, and the distinct pairs of a key's
    smallest node with each node whose sketch is within ``limit[band]`` of it, which need
    not be sent for that key.  Nodes without a row in ``sketches`` are all sent."""
    records = records[np.lexsort((records["node"], records["key"]))]
    records = records[runs(records["key"], records["node"])]
    heads = runs(records["key"])
    pivot = np.repeat(records["node"][heads], np.diff(np.append(heads, len(records))))
    near = np.zeros(len(records), dtype=bool)
    other = np.flatnonzero((records["node"] != pivot) & np.isin(records["node"], nodes) & np.isin(pivot, nodes))
    for at in np.array_split(other, len(other) // (1 << 16) + 1):
        x, y = np.searchsorted(nodes, records["node"][at]), np.searchsorted(nodes, pivot[at])
        apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
        near[at] = apart <= limit[(records["key"][at] & BAND).astype(np.int64)]
    return records[~near], _distinct(pivot[near], records["node"][near])


def star_pairs(records: np.ndarray) -> np.ndarray:
    """Distinct rows of (band, smallest node of a key, another node of that key)."""
    records = records[np.lexsort((records["node"], records["key"]))]
    records = records[runs(records["key"], records["node"])]
    heads = runs(records["key"])
    pivot = np.repeat(records["node"][heads], np.diff(np.append(heads, len(records))))
    other = records["node"] != pivot
    return _distinct((records["key"] & BAND)[other], pivot[other], records["node"][other])


def _distinct(*columns: np.ndarray) -> np.ndarray:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    return np.stack(columns, axis=1)[runs(*columns)].astype(np.int64)


ROWS = "kind int, doc_id bigint, n bigint, node bigint, other bigint, bucket int, payload binary"


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "other": pa.int64(), "bucket": pa.int32(), "payload": pa.binary()}
    arrays = [pa.array([kind] * n, pa.int32())] + [
        (pa.array(columns[c], t) if not isinstance(columns[c], pa.Array) else columns[c]) if c in columns else pa.nulls(n, t)
        for c, t in types.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *types])


def _signatures(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """Rows of documents with their sketches (kind 0), pairs near by sketch in a task (1),
    key blocks (2)."""
    bands = size_bands(rules.percent)
    limit = band_reach(rules.percent, bands, np.arange(len(bands) - 1)) // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, known, size = Hasher(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, first = np.unique(np.concatenate([n for n, _ in known]), return_index=True)
            kept, pairs = near_pivots(np.concatenate(held), nodes, np.concatenate([k for _, k in known])[first], limit)
            if len(pairs):
                yield _rows(1, node=pairs[:, 0], other=pairs[:, 1])
            bucket, payload = blocks(kept, kept["key"])
            yield _rows(2, bucket=bucket, payload=payload)

        for part in slices(batches, "text"):
            sets = shingle_sets(Texts(part.column("text"), lower=True), rules.words, hasher)
            node, n = node_of(sets), np.array([len(s) for s in sets], dtype=np.int64)
            narrow, bodies = whole_sketches(sets)
            yield _rows(0, doc_id=part.column("doc_id"), n=n, node=node.astype(np.int64), payload=bodies)
            # wider sketches are compared after the shuffle only
            exact = n <= 64 * SKETCH
            known.append((node[exact], narrow[exact]))
            for ahead in (0, 1):
                key, owner = parity_keys(sets, rules.percent, bands, ahead)
                new = np.empty(len(key), dtype=KEY)
                new["key"], new["node"] = key, node[owner]
                held.append(new)
                size += len(new)
            if size >= FLUSH:
                yield from flush()
                held, known, size = [], [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def _meet(rows: DataFrame) -> DataFrame:
    """Stars of all tasks' keys (kind 3: pivot, other node, band in ``n``); other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for b in batches:
            keys = pa.compute.equal(b.column("kind"), 2)
            parts += b.filter(keys).column("payload").to_pylist()
            yield b.filter(pa.compute.invert(keys))
        if parts:
            stars = star_pairs(unpack(parts, KEY))
            yield _rows(3, n=stars[:, 0], node=stars[:, 1], other=stars[:, 2])

    spread = F.coalesce("bucket", F.pmod(F.xxhash64("node", "other", "doc_id"), F.lit(1 << 30)).cast("int"))
    return rows.repartition(spread).mapInArrow(run, ROWS)


def walk_links(sets: list[np.ndarray], label: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (pairs of indices) that span the components of ``sets``.  Sets of equal
    non-negative ``label`` are known to be connected and are not compared."""
    links: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    labels = np.array(label)
    left = np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            same = (labels[left] == labels[x]) & (labels[x] >= 0)
            near = ~same & (100 * np.minimum(sizes[left], sizes[x]) >= percent * np.maximum(sizes[left], sizes[x]))
            reached = same.copy()
            ids = left[near]
            if len(ids):
                flat = np.concatenate([sets[i] for i in ids.tolist()])
                at = np.searchsorted(sets[x], flat)
                hit = sets[x][np.minimum(at, len(sets[x]) - 1)] == flat
                ends = np.cumsum(sizes[ids])
                total = np.concatenate([[0], np.cumsum(hit)])
                common = total[ends] - total[ends - sizes[ids]]
                linked = 100 * common >= percent * (sizes[x] + sizes[ids] - common)
                links += [(x, i) for i in ids[linked].tolist()]
                reached[np.flatnonzero(near)[linked]] = True
            queue += left[reached].tolist()
            left = left[~reached]
    return links


def walk_sketches(sketches: list[np.ndarray], limit: list[int]) -> list[tuple[int, int]]:
    """Pairs within the group's ``limit`` bits that span the components of such pairs."""
    width = min(len(s) for s in sketches)
    table = np.stack([fold(s, width) for s in sketches])
    links: list[tuple[int, int]] = []
    left = np.arange(len(table))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(table[left] ^ table[x]).sum(axis=1, dtype=np.int64) <= limit[0]
            found = left[near].tolist()
            links += [(x, i) for i in found]
            queue += found
            left = left[~near]
    return links


def _verify(members: DataFrame, by: list[str], walk: Callable) -> DataFrame:
    """Links (u, v) that ``walk`` finds inside each group ``by`` of (node, label, body)."""

    def groups(batches: Iterator[pa.RecordBatch]):
        now, held, k = None, [], len(by)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*by, "node", "label", "body"))):
                if row[:k] != now:
                    if held:
                        yield held
                    now, held = row[:k], []
                held.append(row[k:])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            unique = {node: (label, body) for node, label, body in held}
            nodes = list(unique)
            links = walk([np.frombuffer(unique[x][1], dtype=U64) for x in nodes], [unique[x][0] for x in nodes])
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in u]), pa.array([nodes[i] for i in v])], names=["u", "v"])

    return members.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u bigint, v bigint")


def _near(found: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs (u, v) that span the sets near by sketch among those that share a key.  The
    sets of one pivot beyond ``BLOCK_SKETCHES`` are compared block by block."""
    bands = size_bands(rules.percent)
    stars = found.filter("kind = 3").select(F.col("node").alias("pivot"), F.col("n").alias("band"), F.col("other").alias("node"))
    stars = materialize(stars.union(stars.select("pivot", "band", F.col("pivot").alias("node"))).distinct(), "stars")
    met = stars.select("node").distinct()
    sketches = found.filter("kind = 0").select("node", F.col("payload").alias("body")).join(met, "node", "left_semi").dropDuplicates(["node"])
    counts = stars.groupBy("pivot", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SKETCHES).cast("int").alias("blocks"))
    reach = band_reach(rules.percent, bands, np.arange(len(bands) - 1))
    limit = F.element_at(F.lit((reach + 2 * (reach // 4)).tolist()).cast("array<bigint>"), F.col("band").cast("int") + 1)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = stars.join(counts, ["pivot", "band"]).join(sketches, "node").select(
        "pivot", "band", "node", limit.alias("label"), "body", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c")
    )
    pairs = each.select("pivot", "band", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"), "node", "label", "body")
    return _verify(pairs, ["pivot", "band", "low", "high"], walk_sketches)


def _members(docs: DataFrame, family: DataFrame, rules: JoinRules) -> DataFrame:
    """Sets of the families' nodes, read again from one document of each.  Nodes of rows
    without an id are found by their sets, which are computed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text"):
            sets = shingle_sets(Texts(part.column("text"), lower=True), rules.words, hasher)
            ok = node_of(sets).astype(np.int64) == part.column("node").to_numpy()
            rows = part.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("family", "blocks", "node")), pa.array([s.tobytes() for s, k in zip(sets, ok.tolist()) if k], pa.binary())],
                names=["family", "blocks", "node", "body"],
            )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in slices(batches, "text"):
            sets = shingle_sets(Texts(part.column("text"), lower=True), rules.words, hasher)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node_of(sets).astype(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "body"]
            )

    named = family.filter("rep is not null").withColumnRenamed("rep", "_rep")
    joined = small_join(docs, named, F.col("doc_id") == F.col("_rep"), "inner", 40)
    found = joined.select("text", "family", "blocks", "node").mapInArrow(run, "family bigint, blocks int, node bigint, body binary")
    nameless = family.filter("rep is null").select("family", "blocks", "node")
    if nameless.isEmpty():
        return found
    sets = docs.filter("doc_id is null").select("text").mapInArrow(again, "node bigint, body binary")
    return found.unionByName(small_join(sets, nameless, "node", "inner", 40).select("family", "blocks", "node", "body").dropDuplicates(["node"]))


def jaccard_components(df: DataFrame, rules: JoinRules = JoinRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that
    links reach, the document's own included).

    A-Z are lower-cased; words are runs without ASCII white space.  A null or blank
    text has no shingles and no links.  A null id is never the smallest unless all ids of
    the component are null.  Repeated rows are documents with equal sets.  Only
    the two named columns are read.  An empty table gives an empty table.

    Equal sets share a 64-bit hash and are one node from the first task on, and a
    task sends of near copies only the smallest for a key, so a large group of copies or
    near copies is not gathered.  A candidate family beyond ``BLOCK_SHINGLES`` elements is verified in
    blocks that share one member; only families still apart after that are
    compared block by block.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = materialize(_meet(_signatures(docs, rules)), "candidates")
    rows = found.filter("kind = 0").select("doc_id", "n", "node")
    nodes = materialize(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "sets")
    close = found.filter("kind = 1").select(F.col("node").alias("u"), F.col("other").alias("v")).union(_near(found, rules))
    family = components(close)
    sized = nodes.join(family, "node").withColumnRenamed("label", "family")
    weight = sized.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    chosen = materialize(sized.join(weight, "family").select("node", "rep", "family", "blocks"), "families")
    members = materialize(_members(docs, chosen, rules), "members")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a family's smallest node is in every block, so that blocks of one component meet
    inside = members.withColumn("at", F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)))
    by, walk = ["family", "low", "high"], lambda sets, label: walk_links(sets, label, rules.percent)
    links = materialize(_verify(inside.select(
        "family", F.explode("at").alias("low"), F.col("low").alias("high"), "node", F.lit(-1).cast("bigint").alias("label"), "body"
    ), by, walk), "links")
    labels = materialize(components(links), "labels")
    if not members.filter("blocks > 1").isEmpty():
        tagged = members.filter("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = tagged.groupBy("family").agg((F.min("label") != F.max("label")).alias("apart")).filter("apart").select("family")
        each = tagged.join(apart, "family", "left_semi").select(
            "family", "node", "label", "body", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c")
        ).filter("b != c")
        across = _verify(each.select(
            "family", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"), "node", "label", "body"
        ), by, walk)
        links = links.union(materialize(across, "links"))
        labels = materialize(components(links), "labels")
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = named.join(least, "label").select("node", "component_id")
    return rows.join(placed, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def join_query(docs: DataFrame) -> DataFrame:
    """Components of all documents for three-word shingles at 90 percent."""
    return jaccard_components(docs, JoinRules(words=3, percent=90))


def join_stage(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One document of each component, the one with the smallest id; same columns.
    Documents without words stay; of several rows with one id one stays; rows
    without an id cannot be told apart and stay.

    Texts are shuffled only for ids that occur more than once.  All columns pass
    unchanged, whatever their names."""
    plain, names = aside(docs)
    doc_id, own = names["doc_id"], list(names.values())
    part = jaccard_components(docs.filter("doc_id is not null"), rules)
    keep = materialize(
        part.filter("component_id = doc_id").groupBy(F.col("doc_id").alias("kept_id")).agg((F.count(F.lit(1)) > 1).alias("repeated")), "kept"
    )
    same = F.col(doc_id).cast("bigint") == F.col("kept_id")
    once = small_join(plain, keep, same, "inner", 16).filter("not repeated").select(own)
    many = small_join(plain, keep.filter("repeated"), same, "left_semi", 16).dropDuplicates([doc_id])
    return once.unionByName(many).unionByName(plain.filter(F.col(doc_id).isNull())).toDF(*docs.columns)
