"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits are cut into m parts of correlated bits, and part i gets a threshold
t_i with t_1 + .. + t_m = tau - m + 1.  Two fingerprints that differ in at most tau bits then
differ in at most t_i bits of some part i (a part with t_i = -1 is never looked at), so they
share a key: the part without some t_i of its bits.  Parts and thresholds are found by dynamic
programming over estimated candidate counts; rows of a key are compared with each other, and
pairs within tau bits link.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, discard, materialize, small_batches, with_row_key
from .components import components

SEED = 42
BITS = 64
#: Rows of one key that one task compares with each other; larger keys are split into pairs of blocks.
BLOCK = 32_768
#: Text of candidates that one task holds as leaders, in bytes; their sets and index take some five times that.
BLOCK_BYTES = 8 << 20
#: Microseconds for a row of the search, and for a compared pair: the weights of the cost estimate.
ROW_COST, PAIR_COST = 3.0, 0.004
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z in lower case, repeats included; all words if fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1])
    n = max(1, len(words) - size + 1)
    xxh = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist(), strict=True)
    return np.fromiter([xxh(joined[a:b], SEED) for a, b in spans], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Each bit: whether over half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, planes: int = 1) -> DataFrame:
    """doc_id, text_hash and f0, f1, ..: plane 0 is the SimHash itself, others are of remixed hashes."""
    names = [f"f{p}" for p in range(planes)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = np.empty((b.num_rows, planes), np.uint64)
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                hashes = shingle_hashes(text, shingle)
                for p in range(planes):
                    rows[k, p] = majority(hashes if p == 0 else _mix(hashes + np.uint64(p)))
            columns = [pa.array(np.ascontiguousarray(rows[:, p]).view(np.int64)) for p in range(planes)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], names=["doc_id", "text_hash", *names])

    rows = with_row_key(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return rows.mapInArrow(made, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Plan:
    """For each part, its bits and its threshold."""

    parts: tuple[tuple[tuple[int, ...], int], ...]
    cost: float

    def masks(self) -> list[int]:
        """For each key of a fingerprint, the bits that make it."""
        return [sum(1 << b for b in bits if b not in out) for bits, t in self.parts if t >= 0 for out in itertools.combinations(bits, t)]


def _bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j: 4096 sums over all rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fps = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        sums = pa.array([*total.ravel().astype(np.int64), n], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), sums], names=["cell", "n"])

    sums = {r.cell: r.n for r in nodes.select("fp").mapInArrow(made, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return sums.get(BITS * BITS, 0), np.array([sums.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def make_plan(n: int, both: np.ndarray, tau: int) -> Plan:
    """Correlated bits in the same part, thresholds by dynamic programming, the cheapest number of parts.

    The share of pairs that agree on a part is estimated along its bits, each given the one
    before; pairs that differ in k of its bits follow from each bit's odds to differ.
    """
    n = max(n, 1)
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    same = p**2 + (1 - p) ** 2
    p11 = both / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    agree = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2

    best: Plan | None = None
    for m in range(1, tau + 2):
        left, parts = list(range(BITS)), []
        for k in range(m):
            size = len(left) // (m - k)
            bits = [max(left, key=lambda b: corr[b, left].sum())]
            left.remove(bits[0])
            while len(bits) < size:
                bits.append(max(left, key=lambda b: corr[b, bits].mean()))
                left.remove(bits[-1])
            parts.append(bits)
        costs = []
        for bits in parts:
            share = same[bits[0]] * math.prod(agree[a, b] / max(same[a], 1e-9) for a, b in itertools.pairwise(bits))
            odds = [(1 - same[b]) / max(same[b], 1e-9) for b in bits]
            within, term, of = [0.0], [1.0] + [0.0] * tau, {-1: 0.0}
            for o in odds:
                for k in range(tau, 0, -1):
                    term[k] += term[k - 1] * o
            for t in range(min(tau, 3, len(bits)) + 1):
                within.append(within[-1] + term[t])
                of[t] = math.comb(len(bits), t) * n * ROW_COST + n * n / 2 * min(1.0, share * within[-1] * (1 + t)) * PAIR_COST
            costs.append(of)
        # least[s]: the cheapest thresholds of the parts so far that sum to s.
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for of in costs:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, chosen) in least.items():
                for t, c in of.items():
                    if s + t not in following or cost + c < following[s + t][0]:
                        following[s + t] = cost + c, (*chosen, t)
            least = following
        if (found := least.get(tau - m + 1)) and (best is None or found[0] < best.cost):
            best = Plan(tuple((tuple(b), t) for b, t in zip(parts, found[1], strict=True)), found[0])
    return best


def _keys(nodes: DataFrame, plan: Plan, plane: int) -> DataFrame:
    """key, node, fp: a row for each key of each fingerprint."""
    masks = np.array(plan.masks(), np.uint64)
    salt = _mix(np.arange(len(masks), dtype=np.uint64) + np.uint64(1000 * plane + 1))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in b.columns)
            for begin in range(0, len(fps), 4096):
                part = fps[begin : begin + 4096].view(np.uint64)
                key = _mix(_mix((part[:, None] & masks) + salt) ^ salt)
                columns = [key.ravel().view(np.int64), np.repeat(nodes[begin : begin + 4096], len(masks)), np.repeat(part, len(masks)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(made, "key long, node long, fp long")


def _split_hot(keys: DataFrame) -> DataFrame:
    """Keys of over BLOCK rows become one key for each pair of their blocks; no row is left out."""
    hot = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot")
    if hot.isEmpty():
        return keys
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.when(F.col("n").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(F.col("own"), o) * F.col("blocks") + F.greatest(F.col("own"), o)))
    dealt = keys.join(hot, "key", "left").withColumn("blocks", blocks).withColumn("own", own).select("key", "node", "fp", F.explode(cells).alias("cell"))
    return dealt.select(F.when(F.col("cell").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("key"), "node", "fp")


def _stars(nodes: np.ndarray, fps: np.ndarray, ends: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j < ends[i] are compared; of each linked set, edges from its members to one of them."""
    label = np.arange(len(fps))
    pairs: list[np.ndarray] = []

    def join() -> None:
        i, j = np.concatenate(pairs, axis=1)
        pairs.clear()
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                return
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.copyto(label, label[label])

    active, step, held = np.arange(len(fps)), 1, 0
    while len(active := active[ends[active] > active + step]):
        near = active[np.bitwise_count(fps[active] ^ fps[active + step]) <= tau]
        if len(near):
            pairs.append(np.stack([near, near + step]))
            held += len(near)
            if held > 1_000_000:
                join()
                held = 0
        step += 1
    if pairs:
        join()
    while (label[label] != label).any():
        np.copyto(label, label[label])
    moved = np.flatnonzero((label != np.arange(len(label))) & (nodes != nodes[label]))
    return nodes[moved], nodes[label[moved]]


def _compare(keys: DataFrame, tau: int) -> DataFrame:
    """Edges (a, b) that connect what the verified pairs connect, at most one for each row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def done(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            lengths = np.diff(np.append(starts, rows.shape[1]))
            ends = np.repeat(starts + lengths, lengths)
            a, b = _stars(rows[1], rows[2].view(np.uint64), ends, tau)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            size += b.num_rows
            if size >= 100_000:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
                if cut:
                    yield done(np.ascontiguousarray(rows[:, :cut]))
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield done(np.concatenate(held, axis=1))

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(made, "a long, b long")


def links(nodes: DataFrame, tau: int, planes: int = 1) -> DataFrame:
    """Edges between nodes whose fingerprints differ in at most tau bits in some plane.

    nodes: node, f0, f1, ..  The edges connect exactly what all such pairs connect, but a large
    group gives one edge for each row of a key, not one for each pair.
    """
    edges = None
    for p in range(planes):
        plane = nodes.select("node", F.col(f"f{p}").alias("fp"))
        plan = make_plan(*_bit_counts(plane), tau)
        found = _compare(_split_hot(_keys(plane, plan, p)), tau)
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _groups(fps: DataFrame, node: Column, tau: int, planes: int) -> DataFrame:
    """node, component: for every node; component is the smallest node reachable."""
    nodes = fps.groupBy(node.alias("node")).agg(*[F.min(f"f{p}").alias(f"f{p}") for p in range(planes)])
    nodes = materialize(nodes, "nodes")
    found = components(links(nodes, tau, planes))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linked_documents(docs: DataFrame, shingle: int = 3, tau: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    A text without words, null or empty, has fingerprint zero and links like any other.  Rows
    with a null id have a row too; component_id is the smallest id that is not null.  Repeated
    rows and equal ids give a row each; an empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle).select("doc_id", F.col("f0").alias("fp")), "fingerprints")
    groups = materialize(_groups(fps.withColumnRenamed("fp", "f0"), F.col("f0"), tau, 1), "groups")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups.withColumnRenamed("node", "fp"), "fp")
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(smallest, "component").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(named, "fp", "left").select("doc_id", shown.alias("fingerprint"), "component_id")


class _Leaders:
    """Shingle sets of rows that stay, and whether one of them is like a given set.

    Of two sets with Jaccard t or more, the first n - ceil(t n) + 1 of the n hashes of each have
    one in common; only leaders that share one are compared.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.sets: list[np.ndarray] = []
        self.having: dict[int | None, list[int]] = {}

    def _first(self, own: np.ndarray) -> list[int | None]:
        n = len(own)
        return own[: n - math.ceil(self.similarity * n - 1e-9) + 1].tolist() if n else [None]

    def add(self, own: np.ndarray) -> None:
        for h in self._first(own):
            self.having.setdefault(h, []).append(len(self.sets))
        self.sets.append(own)

    def like(self, own: np.ndarray) -> bool:
        seen: set[int] = set()
        for h in self._first(own):
            for k in self.having.get(h, ()):
                if k in seen:
                    continue
                seen.add(k)
                other = self.sets[k]
                common = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - common
                if not union or common / union >= self.similarity:
                    return True
        return False


#: A row that is known to stay, one that stays if no row before it is like it, and one that is only judged.
_LEADS, _OPEN, _JUDGED = 0, 1, 2


def _judge(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, stays: each row against the rows that stay before it in its component and block."""
    keys = ["component", "block"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, _Leaders(similarity)
        for b in small_batches(batches):
            component, block, role, doc_id, text_hash, text = b.columns
            stays = []
            for c, k, r, t in zip(component.to_pylist(), block.to_pylist(), role.to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
                if at != (c, k):
                    at, leaders = (c, k), _Leaders(similarity)
                own = np.unique(shingle_hashes(t, shingle))
                stays.append(r == _LEADS or not leaders.like(own))
                if stays[-1] and r != _JUDGED:
                    leaders.add(own)
            yield pa.RecordBatch.from_arrays([doc_id, text_hash, pa.array(stays, pa.bool_())], names=["doc_id", "text_hash", "stays"])

    rows = rows.select(*keys, "role", "doc_id", "text_hash", "text").repartition(*keys)
    return rows.sortWithinPartitions(*keys, "role", "doc_id", "text_hash").mapInArrow(made, "doc_id long, text_hash long, stays boolean")


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds block: the rows of a component in the order of the ids, cut at every BLOCK_BYTES of text."""
    sizes = rows.select("doc_id", "text_hash", "component", F.octet_length("text").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("component").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(sizes.select("doc_id", "text_hash", F.floor(before / BLOCK_BYTES).cast("long").alias("block")), ["doc_id", "text_hash"])


def _finer(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows with finer sets in place of their components; rows that nothing can be like are left out.

    In an order of all shingles, two sets with Jaccard t or more have one in common among the
    first n - ceil(t n) + 1 of each.  The rarest shingles of a component come first, so a passage
    that many texts share does not bring them together.  Rows that share such a shingle are
    linked to the smallest of them: as many edges as shingles at most, and no pairs.  Rows that
    are like each other are thus in one set, whatever else is in it.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            components_, nodes = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            salts = _mix(components_.view(np.uint64))
            # Texts without words are alike: all of them have the one shingle 0.
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column(2).cast(pa.binary()).to_pylist()]
            sets = [own if len(own) else np.zeros(1, np.uint64) for own in sets]
            sizes = np.array([len(own) for own in sets])
            keys = np.concatenate(sets) ^ np.repeat(salts, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(keys.view(np.int64))], names=["node", "n", "shingle"])

    named = rows.withColumn("node", F.xxhash64("component", "doc_id", "text_hash"))
    each = materialize(named.select("component", "node", "text").mapInArrow(made, "node long, n long, shingle long"), "shingles")
    shared = each.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    common = each.join(shared, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "shingle"))).alias("shared"))
    # Shingles of one row come first and link nothing; what is left of the first ones may link.
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    chosen = common.select("node", F.explode(F.slice("shared", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))["shingle"]).alias("shingle"))
    chosen = materialize(chosen, "chosen")
    least = chosen.groupBy("shingle").agg(F.min("node").alias("b"), F.count("*").alias("rows")).where("rows > 1")
    found = components(chosen.join(least, "shingle").select(F.col("node").alias("a"), "b"))
    finer = materialize(named.drop("component").join(found, "node").drop("node"), "finer")
    discard(each, chosen)
    return finer


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components of at most BLOCK_BYTES of text, and the others, if there are any."""
    sizes = rows.groupBy("component").agg(F.sum(F.octet_length("text")).alias("bytes"))
    large = materialize(sizes.where(F.col("bytes") > BLOCK_BYTES).select("component"), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "component", "left_anti"), rows.join(large, "component", "left_semi")


def _like_an_earlier(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash of the rows (doc_id, text_hash, component, text) that go, as a written table.

    In the order of the ids, a row goes if a row of its component that stays is like it.  A task
    decides a whole component.  One of over BLOCK_BYTES of text is first cut into finer sets, between
    which no two rows are alike (`_finer`).  Of a finer set that is still as large, a round decides
    the first block and then holds the rows of all later blocks against those that stay; rounds
    go on until none is undecided.
    """
    key = ["doc_id", "text_hash"]
    parts: list[DataFrame] = []

    def judged(given: DataFrame) -> DataFrame:
        parts.append(materialize(_judge(given, shingle, similarity), "judged"))
        return parts[-1]

    def at_once(given: DataFrame) -> None:
        judged(given.withColumns({"block": F.lit(0).cast("long"), "role": F.lit(_OPEN)}))

    small, large = _by_size(rows)
    at_once(small)
    rest = None
    if large is not None:
        finer = _finer(large, shingle, similarity)
        small, large = _by_size(finer)
        at_once(small)
        rest = materialize(_blocks(large), "members") if large is not None else None
        discard(finer)
    while rest is not None and not rest.isEmpty():
        placed = rest.join(rest.groupBy("component").agg(F.min("block").alias("first")), "component")
        decided = judged(placed.where("block = first").withColumn("role", F.lit(_OPEN)))
        later = placed.where("block > first").drop("first")
        leaders = rest.join(decided.where("stays").select(*key), key).drop("block")
        leaders = leaders.join(later.select("component", "block").distinct(), "component").withColumn("role", F.lit(_LEADS))
        held = materialize(_judge(leaders.unionByName(later.withColumn("role", F.lit(_JUDGED))), shingle, similarity), "judged")
        parts.append(materialize(held.join(later.select(*key), key, "left_semi"), "judged"))
        older, rest = rest, materialize(later.join(parts[-1].where("stays").select(*key), key), "members")
        discard(older, held)
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.unionByName(part)
    gone = materialize(gone.where("not stays").select(*key), "gone")
    discard(*parts)
    return gone


def keep_one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tau: int = 8, planes: int = 6) -> DataFrame:
    """The rows of docs without near-duplicates; columns and texts stay as they are.

    Of equal texts the row of the smallest id stays.  Rows whose SimHash differs in at most tau
    bits in one of the planes are candidates of each other.  In each connected set of candidates,
    in the order of the ids, a row goes if its set of shingles and that of a row that stays have
    a Jaccard similarity of `similarity` or more.  So every row that goes has a row like it that
    stays, and no two rows of a set that stay are alike.  Of rows equal in id and text one stays;
    rows with a null id stay; texts without words are alike.
    """
    key = ["doc_id", "text_hash"]
    name = "text_hash"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("doc_id", F.col("doc_id").cast("long"))
    fps = materialize(fingerprints(docs, shingle, planes).where("doc_id is not null"), "fingerprints")
    node = F.xxhash64(*[f"f{p}" for p in range(planes)])
    groups = _groups(fps, node, tau, planes)
    distinct = fps.withColumn("node", node).groupBy(*key, "node").agg(F.count("*").alias("copies"))
    # Rows of one text have one node too, so texts that only share a hash stay apart.
    least = distinct.groupBy("text_hash", "node").agg(F.min("doc_id").alias("least"), F.min_by("copies", "doc_id").alias("copies"), F.count("*").alias("rows"))
    copies = distinct.drop("copies").join(least.where("rows > 1"), ["text_hash", "node"]).where("doc_id > least").select(*key)
    members = least.select(F.col("least").alias("doc_id"), "text_hash", "copies", "node").join(groups, "node").select(*key, "copies", "component")
    large = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    grouped = materialize(members.join(large.select("component"), "component", "left_semi"), "grouped")
    # Only texts of rows that have a candidate are moved, to the task that decides their set.
    texts = beside(keyed.select("doc_id", F.col(name).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")), grouped, key, "inner")
    texts = texts.where("copies = 1").unionByName(texts.where("copies > 1").dropDuplicates(key))
    rows = materialize(texts.select(*key, "component", "text"), "texts")
    like = _like_an_earlier(rows, shingle, similarity)
    gone = materialize(copies.unionByName(like), "gone")
    repeated = materialize(distinct.where("copies > 1").select(*key), "repeated")
    discard(rows, grouped, fps, like)

    named = lambda ids: ids.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col(name) == F.col("gone_hash"))
    out = beside(keyed, named(gone), same, "left_anti")
    if not repeated.isEmpty():
        once = beside(out, named(repeated), same, "left_anti")
        out = once.unionByName(beside(out, named(repeated), same, "left_semi").dropDuplicates(["doc_id", name]))
    return out.select(*[F.col(c).cast(t).alias(c) if c == "doc_id" else c for c, t in docs.dtypes])
