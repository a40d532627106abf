"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 bits over word shingles. Two fingerprints at most RADIUS = 4 bits apart, cut into BANDS = 6 bands, agree
on at least KEEP = 2 whole bands. So the shards are leaves of vantage-point trees in the 15 projections onto two bands:
a fingerprint goes down by its Hamming distances to the fixed vantage points of that projection. Neighbours have projected
distance 0 in one of the projections, where the triangle bound |d(x, v) - d(y, v)| <= 0 sends both to the same leaf, so no
shard needs its boundary queried there and no link is lost. (In the full 64 dimensions distances crowd around 32 +- 4, so a
radius of 4 straddles nearly every split.) Inside a shard a vantage-point tree over the full distance, pruned
by the triangle bound with radius 4, finds exact neighbours. A shard gives back a spanning forest of its links, never all pairs.

Near copies at a Jaccard similarity (`similar_documents`, the pipeline's stage) are found by SimHash votes (WIDE_BITS sums over distinct shingles) and
decided by the similarity itself. The votes of two sets at similarity s have a cosine of 2s / (1 + s) or more, so they go down trees of vantage points (`Trees`): in
each tree, which is turned by a rotation of its own, to the nearest of 2 * WIDE_BITS points (the axes and their opposites), and in large tables to a second level.
There are as many trees as leave a pair at s without a common leaf with a chance of MISS (34 for half a million sets at 0.8, 72 for 13 million).
Inside a leaf those whose fingerprints of NEAR_WORDS words (the signs of votes) differ in no more bits than such a pair's (with SLACK standard deviations), and whose sizes allow s, are
linked, by a star for each component of the leaf, never by all pairs; small sets, whose fingerprints are rougher, get more slack. The whole shingle sets of each component of these links then meet, which gives a spanning forest of the
pairs that reach the similarity, never all pairs. A component of more than BLOCK_SHINGLES shingles is dealt in blocks, and each two blocks of it meet in
a task of their own, so that no task holds a whole heavy component.

Equal fingerprints are one row from the start, so exact copies cost nothing. A shard holds 16 bytes a fingerprint.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle; ids may be of any type that can be ordered; repeated rows share their component; rows with a null id link like any other, and
a component of null ids only has a null component_id; an empty table gives an empty result; other columns are ignored. `keep_representatives`
keeps one row of every component: of the rows that repeat its smallest id (or of null ids only) the first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.llm.common import ROW, broadcast_if_small, keyed, materialize, slices, surplus, without_rows
from rosterforge.plans.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 64
RADIUS, BANDS, KEEP = 4, 6, 2
VANTAGE_POINTS = 12
#: Shards up to this size compare neighbours directly; larger ones grow a tree whose leaves are of this size.
LEAF = 64
#: Votes of a wide fingerprint, and the words of their signs by which a leaf's members are compared.
WIDE_BITS, NEAR_WORDS = 512, 3
#: Vantage points of a second level at most, so that a leaf's number has 16 bits.
SECOND_POINTS = 64
#: Chance that a pair shares no leaf; standard deviations by which a link may differ more than expected; error of a cosine of votes that trees allow for.
MISS, SLACK, COSINE_ERROR = 3e-6, 4.5, 0.01
#: Sets of fewer shingles are small; what is added to the share of differing bits for small sets and for others.
SMALL_SET, ROUGHNESS = 20, (0.045, 0.005)
#: Members of a leaf that are compared along their sizes; more grow a tree. More of them on average ask for a second level.
LEAF_ROWS = 512
#: Distinct shingles of one block of a component, 8 bytes each; a task holds two blocks at a time.
BLOCK_SHINGLES = 1 << 19


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1]
    spans = zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(begins))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(found)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, fp long")


def band_masks(bands: int = BANDS, keep: int = KEEP) -> list[int]:
    """One mask for each choice of `keep` of the bands, as unsigned numbers."""
    edges = [round(i * BITS / bands) for i in range(bands + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(single, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage_points(n: int = VANTAGE_POINTS) -> list[int]:
    """Fixed points, from the digests of their numbers."""
    import xxhash

    return [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)]


def leaves(fp: Column) -> Column:
    """The leaf of fp in every projection: a hash of its distances to the vantage points there."""
    points = vantage_points()
    return F.array(*(
        F.xxhash64(F.lit(k), *(F.bit_count(fp.bitwiseXOR(F.lit(_signed(v))).bitwiseAND(F.lit(_signed(mask)))) for v in points))
        for k, mask in enumerate(band_masks())
    ))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    x = np.bitwise_count(a ^ b)
    return x[..., 0] if x.shape[-1] == 1 else x.sum(axis=-1, dtype=np.int64)


class VantageTree:
    """Hamming vantage-point tree that gives each point back once."""

    def __init__(self, fps: np.ndarray, ids: np.ndarray):
        self.left = self.right = None
        if len(fps) > LEAF:
            # The point farthest from the first one: it lies at the rim, and a child's is another one than its parent's.
            self.vantage = fps[int(np.argmax(distance(fps, fps[0])))]
            d = distance(fps, self.vantage)
            self.cut = int(np.median(d))
            if self.cut == d.max():
                self.cut -= 1
            near = d <= self.cut
            if 0 < near.sum() < len(fps):
                self.left, self.right = VantageTree(fps[near], ids[near]), VantageTree(fps[~near], ids[~near])
                self.size = len(fps)
                return
        self.fps, self.ids, self.size = fps, ids, len(fps)

    def take(self, q: np.ndarray, radius: int, out: list) -> int:
        """Remove all points within radius of q and append (fps, ids) of them to out; returns how many."""
        if not self.size:
            return 0
        if self.left is None:
            hit = distance(self.fps, q) <= radius
            n = int(np.count_nonzero(hit))
            if n:
                out.append((self.fps[hit], self.ids[hit]))
                self.fps, self.ids = self.fps[~hit], self.ids[~hit]
        else:
            d, n = int(distance(q, self.vantage)), 0
            if d - radius <= self.cut:
                n += self.left.take(q, radius, out)
            if d + radius > self.cut:
                n += self.right.take(q, radius, out)
        self.size -= n
        return n


def shard_forest(fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A star (smallest id, member) for each component of a shard's links."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps.reshape(len(ids), -1)[order], ids[order]
    tree, centres, members, done = VantageTree(fps, ids), [], [], set()
    for fp, i in zip(fps, ids.tolist(), strict=True):
        if i in done:
            continue
        todo, found = [fp], []
        while todo:
            got: list = []
            tree.take(todo.pop(), radius, got)
            for f, d in got:
                todo.extend(f)
                found.append(d)
        inside = np.concatenate(found) if found else np.zeros(0, dtype=ids.dtype)
        done.update(inside.tolist())
        inside = inside[inside != i]
        centres.append(np.full(len(inside), i, dtype=ids.dtype))
        members.append(inside)
    return np.concatenate(centres), np.concatenate(members)


def _small_links(leaf: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small shards at once; leaf is sorted."""
    a, b, step = [], [], 1
    while step < len(leaf):
        same = leaf[step:] == leaf[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[distance(fps[at], fps[at + step]) <= radius]
        a.append(ids[at])
        b.append(ids[at + step])
        step += 1
    empty = np.zeros(0, dtype=ids.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _by_leaf(shards):
    """shards(columns) of all rows of a leaf together, in a partition that is sorted by its first column, the leaf."""

    def work(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(c.to_numpy() for c in batch.columns)
            if held and held[0][0][0] == now[0][0] == now[0][-1]:
                held.append(now)
                continue
            whole = [np.concatenate(x) for x in zip(*held, now, strict=True)]
            cut = int(np.argmax(whole[0] == whole[0][-1]))  # the last shard may go on in the next batch
            if cut:
                yield from shards(*(x[:cut] for x in whole))
            held = [tuple(x[cut:] for x in whole)]
        if held:
            yield from shards(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def _bounds(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the leaves begin, and how many rows each has."""
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    return starts, np.diff(np.append(starts, len(leaf)))


def _batches(pairs):
    for a, b in pairs:
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def _search(radius: int):
    """Links of the shards of a partition that is sorted by leaf."""

    def shards(leaf, ids, *words):
        fps = np.stack([w.view(np.uint64) for w in words], axis=1)
        starts, sizes = _bounds(leaf)
        small = np.repeat((sizes > 1) & (sizes <= 12), sizes)
        pairs = [_small_links(leaf[small], fps[small], ids[small], radius)] if small.any() else []
        for k in np.flatnonzero(sizes > 12):
            part = slice(starts[k], starts[k] + sizes[k])
            pairs.append(shard_forest(fps[part], ids[part], radius))
        yield from _batches(pairs)

    return _by_leaf(shards)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links of nodes (node long, fp long, both distinct) whose closure is that of all pairs within radius."""
    if radius > BANDS - KEEP:
        raise ValueError(f"{BANDS} bands of which {KEEP} agree find pairs up to radius {BANDS - KEEP}")
    dealt = nodes.select(F.explode(leaves(F.col("fp"))).alias("leaf"), "node", "fp")
    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_search(radius), "a long, b long")


def votes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (set less unset) of distinct shingle hashes on WIDE_BITS bits, and the fingerprint: the majorities of the first NEAR_WORDS words; where half
    of the hashes have a bit, one drawn for the word decides."""
    words = WIDE_BITS // BITS
    ones, drawn, least = np.zeros(WIDE_BITS, dtype=np.int64), np.zeros(words, dtype=np.uint64), np.full(words, np.iinfo(np.uint64).max, dtype=np.uint64)
    offsets = (np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(hashes), 255):  # sums of so many bits fit in a byte
        x = hashes[a : a + 255, None] + offsets
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        order = x * np.uint64(0xD6E8FEB86659FD93)
        first = order.argmin(axis=0), np.arange(words)
        drawn, least = np.where(order[first] < least, x[first], drawn), np.minimum(order[first], least)
    near = 2 * ones + np.unpackbits(drawn.view(np.uint8), bitorder="little") > len(hashes)
    return 2 * ones - len(hashes), np.packbits(near[: NEAR_WORDS * BITS], bitorder="little").view(np.uint64)


def nearest_axis(points: np.ndarray) -> np.ndarray:
    """For each row the number of the nearest of the axes and their opposites."""
    at = np.abs(points).argmax(axis=1)
    return 2 * at + (points[np.arange(len(at)), at] < 0)


def meeting(axes: int, cosine: float, draws: int = 4000) -> float:
    """Chance that two points at this cosine have the same nearest one of these axes and their opposites, as drawn."""
    rng = np.random.default_rng(SEED)
    x, y = (rng.standard_normal((draws, axes), dtype=np.float32) for _ in range(2))
    return float((nearest_axis(x) == nearest_axis(cosine * x + np.sqrt(1 - cosine * cosine) * y)).mean())


class Trees:
    """Vantage-point trees for about `n` sets, of which all but MISS of the pairs at the similarity share a leaf.

    The vantage points of a level are axes and their opposites, so the nearest one is told by the largest coordinate. A rotation is a Hadamard matrix
    behind seeded changes of sign.
    """

    def __init__(self, n: int, similarity: float):
        crowd, self.axes = n / (2 * WIDE_BITS * LEAF_ROWS), 0
        if crowd > 1:
            self.axes = int(min(2 ** np.ceil(np.log2(crowd)), SECOND_POINTS)) // 2
        cosine = max(2 * similarity / (1 + similarity) - COSINE_ERROR, 0.0)
        share = meeting(WIDE_BITS, cosine) * (meeting(self.axes, cosine) if self.axes else 1)
        self.count = int(np.ceil(np.log(MISS) / np.log1p(-share)))
        self.turn = np.ones((1, 1), dtype=np.float32)
        while len(self.turn) < WIDE_BITS:
            self.turn = np.block([[self.turn, self.turn], [self.turn, -self.turn]])
        self.signs = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), size=(self.count, 2, WIDE_BITS))

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each row of votes in each tree, a number of 16 bits."""
        points, out = points.astype(np.float32), np.empty((len(points), self.count), dtype=np.uint16)
        for k, (first, second) in enumerate(self.signs):
            out[:, k] = nearest_axis((points * first) @ self.turn)
            if self.axes:
                out[:, k] = out[:, k] * (2 * self.axes) + nearest_axis((points * second) @ self.turn[:, : self.axes])
        return out

    def fingerprints(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """For each set of hashes its fingerprint of NEAR_WORDS words and behind it its leaves, as bytes."""
        if not sets:
            return []
        sums, near = zip(*map(votes, sets), strict=True)
        return [*np.concatenate([np.stack(near).view(np.uint8), self.leaves(np.stack(sums)).view(np.uint8)], axis=1)]


_TREES: dict[float, Trees] = {}


def wide_fingerprint(hashes: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """Fingerprint and leaves of one set, in the trees of a small table."""
    if similarity not in _TREES:
        _TREES[similarity] = Trees(0, similarity)
    return _TREES[similarity].fingerprints([hashes])[0]


def differing(similarity: float, small: bool) -> float:
    """Share of the bits that differ between the fingerprints of two sets at this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) + ROUGHNESS[not small]


def link_radius(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Differing bits in NEAR_WORDS words up to which sets of these sizes are linked."""
    bits, shares = NEAR_WORDS * BITS, (differing(similarity, True), differing(similarity, False))
    small, large = (int(bits * q + SLACK * np.sqrt(bits * q * (1 - q))) for q in shares)
    return np.where(sizes < SMALL_SET, small, large)


def stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (smallest id, member) for each component of the links between places a and b of ids."""
    label = np.arange(len(ids))
    while True:
        low, now = np.minimum(label[a], label[b]), label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(now, at, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    least = ids.copy()
    np.minimum.at(least, label, ids)
    centres = least[label]
    inner = centres != ids
    return centres[inner], ids[inner]


def _links_by_size(leaf: np.ndarray, ids: np.ndarray, sizes: np.ndarray, fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links inside leaves whose sizes ascend: each set meets those behind it whose size allows the similarity."""
    at, step, a, b = np.arange(len(leaf)), 1, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while True:
        at = at[: np.searchsorted(at, len(leaf) - step)]
        at = at[(leaf[at + step] == leaf[at]) & (sizes[at] + 1e-6 >= similarity * sizes[at + step])]  # no set farther on fits where this one doesn't
        if not len(at):
            return stars(np.concatenate(a), np.concatenate(b), ids)
        near = at[distance(fps[at], fps[at + step]) <= link_radius(sizes[at], similarity)]
        a.append(near)
        b.append(near + step)
        step += 1


def candidate_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of nodes (node, size, bits: their wide fingerprint) whose closure holds all but MISS of the pairs at the similarity; at most one a node and tree."""
    words, most = [f"f{k}" for k in range(NEAR_WORDS)], (1 << 31) - 1

    def deal(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            ids, sizes = batch.column(0).to_numpy(), np.minimum(batch.column(1).to_numpy(), most)
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            fps, leaf = (np.ascontiguousarray(x) for x in (bits[:, : 8 * NEAR_WORDS], bits[:, 8 * NEAR_WORDS :]))
            fps, leaf = fps.view(np.int64), leaf.view(np.uint16).astype(np.int64).T
            leaf += np.arange(len(leaf), dtype=np.int64)[:, None] << 16
            at = np.tile(np.arange(len(ids)), len(leaf))
            place = (leaf << 31 | sizes).ravel()
            yield pa.RecordBatch.from_pydict({"place": place, "node": ids[at], **{w: fps[at, j] for j, w in enumerate(words)}})

    def shards(leaf, ids, sizes, *found):
        fps = np.stack([w.view(np.uint64) for w in found], axis=1)
        starts, rows = _bounds(leaf)
        some = np.repeat((rows > 1) & (rows <= LEAF_ROWS), rows)
        pairs = [_links_by_size(leaf[some], ids[some], sizes[some], fps[some], similarity)]
        for k in np.flatnonzero(rows > LEAF_ROWS):
            part = slice(starts[k], starts[k] + rows[k])
            pairs.append(shard_forest(fps[part], ids[part], int(link_radius(sizes[part], similarity).max())))
        yield from _batches(pairs)

    def search(batches):
        def split():
            for batch in slices(batches, 2048):
                place = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(place >> 31), batch.column(1), pa.array(place & most), *batch.columns[2:]], names=["leaf", "node", "size", *words])

        return _by_leaf(shards)(split())

    columns = ", ".join(f"{c} long" for c in ("place", "node", *words))
    # A smaller set than this is similar enough to equal sets only.
    dealt = nodes.where(F.col("size") * (1 - similarity) >= similarity - 1e-6).select("node", "size", "bits").mapInArrow(deal, columns)
    return dealt.repartition(F.shiftright("place", 31)).sortWithinPartitions("place").mapInArrow(search, "a long, b long")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """ROW, doc_id, text, key (digest of the set of shingles), size (shingles in it), bits (their wide fingerprint)."""
    rows = docs.select(ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trees = Trees(rows.count(), similarity)

    def work(batches):
        import xxhash

        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in (ROW, "doc_id", "text")}, "key": pa.array(keys.view(np.int64)),
                "size": pa.array([len(x) for x in sets], type=pa.int64()), "bits": pa.array([b.tobytes() for b in trees.fingerprints(sets)], type=pa.binary()),
            })

    schema = T.StructType([*rows.schema, T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bits", T.BinaryType())])
    return rows.mapInArrow(work, schema)


def similarity_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Positions (a, b) of a spanning forest of the pairs of sets whose Jaccard similarity is at least `similarity`; sets hold distinct values."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return ([0], [1]) if both / (len(sets[0]) + len(sets[1]) - both) >= similarity else ([], [])
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    alive = np.ones(len(sets), dtype=bool)

    def index(members):
        """Owners of each value, by value, and where each value's owners begin."""
        own = np.repeat(members, sizes[members])
        held = np.concatenate([values[starts[m] : starts[m + 1]] for m in members])
        return own[np.argsort(held, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(held, minlength=values.max() + 1))])

    indexed = len(sets)
    owners, begins = index(np.arange(indexed, dtype=np.int32))
    a, b = [], []
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first], todo = False, [first]
        while todo and alive.any():
            left = np.flatnonzero(alive)
            if 2 * len(left) < indexed:  # the index follows the sets that are left, so that it costs little to ask it again
                indexed = len(left)
                owners, begins = index(left.astype(np.int32))
            q = todo.pop()
            mine = values[starts[q] : starts[q + 1]]
            both = np.bincount(np.concatenate([owners[begins[v] : begins[v + 1]] for v in mine]), minlength=len(sets))
            hits = left[both[left] / (sizes[q] + sizes[left] - both[left]) >= similarity]
            alive[hits] = False
            todo.extend(hits.tolist())
            a.extend([q] * len(hits))
            b.extend(hits.tolist())
    return a, b


def similar_pairs(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: keys of a forest of the pairs of nodes that are in one component of candidate_links and reach the similarity.

    nodes: node (their key), size, bits; texts: key, text.
    """
    linked = connected_components(candidate_links(nodes, similarity))
    found = materialize(nodes.select(F.col("node").alias("key"), "size").join(broadcast_if_small(linked.withColumnRenamed("node", "key")), "key"))
    groups = materialize(found.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks")))
    members = materialize(found.select("key", "component").join(broadcast_if_small(groups), "component"))
    needed = materialize(members.select("key").distinct())
    # Any of the texts of a key: all have the same shingles.
    rows = texts.join(broadcast_if_small(needed), "key", "left_semi").dropDuplicates(["key"]).select("key", "text")

    def read(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "shingles": pa.array(sets, type=pa.binary())})

    def search(batches):
        part, keys, sets = None, [], []

        def found():
            a, b = similarity_forest(sets, similarity)
            return pa.RecordBatch.from_pydict({k: pa.array([keys[i] for i in at], type=pa.int64()) for k, at in (("a", a), ("b", b))})

        for batch in slices(batches):
            for now, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part:
                    if len(keys) > 1:
                        yield found()
                    part, keys, sets = now, [], []
                keys.append(key)
                sets.append(np.frombuffer(data, dtype=np.uint64))
        if len(keys) > 1:
            yield found()

    read_sets = materialize(rows.mapInArrow(read, "key long, shingles binary"))
    own, others = F.expr("pmod(key, blocks)"), F.expr("sequence(0L, blocks - 1)")
    met = members.withColumn("own", own).withColumn("other", F.explode(F.filter(others, lambda x: (x != F.col("own")) | (F.col("blocks") == 1))))
    met = met.select("key", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("part"))
    dealt = met.join(read_sets, "key").select("part", "key", "shingles").repartition("part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    found = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(found.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")))
    named = _smallest_ids(nodes, connected_components(links(nodes.select("node", F.col("node").alias("fp")), radius)))
    return found.withColumnRenamed("fp", "node").join(broadcast_if_small(named), "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _smallest_ids(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """node, component_id: the smallest id (nodes: node, least) in the component of a node; grouped: node, component of linked nodes."""
    inside = nodes.join(broadcast_if_small(materialize(grouped)), "node").select("node", "component", "least")
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    merged = inside.join(broadcast_if_small(materialize(least)), "component").select("node", "component_id", F.lit(True).alias("linked"))
    named = nodes.join(broadcast_if_small(materialize(merged)), "node", "left")
    return materialize(named.select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over pairs whose distinct shingles have this Jaccard similarity or more).

    Documents without words are one component.
    """
    return _similar_rows(keyed(docs), id_col, text_col, shingle, similarity).select("doc_id", "component_id")


def _similar_rows(rows: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """ROW, doc_id, component (a number of it), component_id of rows that have ROW."""
    found = materialize(shingle_sets(rows, id_col, text_col, shingle, similarity))
    nodes = materialize(found.groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("least"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits")))
    grouped = materialize(connected_components(similar_pairs(nodes, found.select("key", "text"), shingle, similarity)))
    named = _smallest_ids(nodes.select("node", "least"), grouped)
    named = named.join(broadcast_if_small(grouped), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "component_id")
    return found.select(ROW, "doc_id", F.col("key").alias("node")).join(broadcast_if_small(materialize(named)), "node").drop("node")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row of each component of similar documents, that of the smallest id, with all its columns."""
    rows = keyed(docs)
    marked = materialize(_similar_rows(rows, id_col, text_col, shingle, similarity).withColumn("first", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    gone = marked.where("NOT first").select(ROW).unionByName(surplus(marked.where("first"), "component"))
    return without_rows(rows, gone).select(*docs.columns)
