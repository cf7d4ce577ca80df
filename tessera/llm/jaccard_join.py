"""Exact n-gram Jaccard join in metric space.

The Jaccard distance d = 1 - |x & y| / |x | y| of shingle sets is a metric; two texts link when d <= eps.

1. Sets that are equal are one point. Of each set, only shingles found in other sets too can be shared; a set with too
   few of them is further than eps from everything and ends here. This is decided exactly: every shingle's number of
   sets is counted, dealt by hash ranges as packed arrays.
2. Pivots and regions. Of the rarest shingles of a set, floor(n / 4) + 1 at eps = 1/4 must include one of any linked
   set's. All points with such a shingle in common form a cell around their least point, the pivot; cells with one
   pivot are one region. A point at a border lies in several cells and is replicated to all their regions, so two
   linked points meet in at least one region.
3. A region too large for one task is divided again, by distance: points of it become pivots, every point is assigned
   to its nearest one (Voronoi), if that is nearer than NEAR, and is replicated to the cells of other pivots where the
   triangle inequality leaves it a partner. With linked x of cell p and y at home elsewhere, d(y, p) <= d(x, p) + eps
   < NEAR + eps, and d(y, p) <= d(y, home) + 2 eps. Points within eps of a pivot are linked through it and are not
   compared with each other. Points far from all pivots are a region of their own, for which that is repeated with
   other pivots ROUNDS times. What is too large even then is dealt into blocks, and each pair of blocks is one task.
4. In a task distances to a pivot and the windows that the triangle inequality leaves are used once more: points become
   pivots in turn, until those not yet compared with everything are known to be connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import arrow_text
from .components import components
from .words import shingle_set, windows, word_hashes
from .workspace import bound_batches, fields, release_memory, scratch, table, without, written

SHINGLE = 5
#: Similarity of linked sets at least, as (up, down): 100 * shared >= 75 * union.
SIMILAR = (3, 4)
#: Shingles counted together in one task, shingles and sets packed together, and points of a region that one task joins.
RANGE_SHINGLES, PACK_SHINGLES, PACK_SETS, REGION_POINTS = 1 << 20, 2 << 20, 60_000, 4_000
#: Bytes of shingles that count as one more point, so that long texts don't make a task large.
POINT_BYTES = 8_000
#: Pivots of a region that is divided, about; points nearer than NEAR to one belong to its cell; rounds of dividing.
PIVOTS, NEAR, ROUNDS = 32, 0.5, 2
#: Roles in a cell: linked to its pivot, at home but not linked, at home elsewhere.
BALL, HOME, VISITOR = 0, 1, 2


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = arrow_text.flat(column)
    for a, b in arrow_text.slices(offsets):
        hashes, before = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        runs = windows(hashes, size)
        for k in range(b - a):
            yield shingle_set(hashes, runs, int(before[k]), int(before[k + 1]), size)


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def set_keys(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, set): the size and a 128-bit name of each text's shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names = [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                names.append(set_key(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary())], names=["key", "n_shingles", "set"])

    kind = documents.schema[key].dataType.simpleString()
    return fields(documents, key=key, text=text).mapInArrow(run, f"key {kind}, n_shingles bigint, set binary")


MANY = 65535
_PACKED = "part int, home bigint, roster boolean, a binary, b binary, c binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    names = ["part", "home", "roster", "a", "b", "c"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _pack_shingles(documents: DataFrame, text: str, size: int, bits: int) -> DataFrame:
    """Shingles as packed arrays by hash range: a = 48 bits of each hash, b = its set's place in the home. A home is a
    run of sets of one task, told by the task's number; its roster has the sets' names and sizes. Equal sets of a home
    are one. A shingle that several sets of a home have leaves the home once, marked MANY and with their number in c;
    which sets have it stays in the roster's c. So a range gets at most one entry of a shingle from a home, however
    common the shingle is."""

    def packed(sets: dict[bytes, np.ndarray], home: int) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in sets.values()])
        every = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        runs = np.diff(np.r_[heads, len(every)])
        many = runs > 1
        own = np.where(many, MANY, owner[heads]).astype(np.uint16)
        times = np.minimum(runs, 65535).astype(np.uint16)
        low = (every[heads] << np.uint64(bits)) >> np.uint64(16)
        bounds = np.searchsorted(every[heads] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = []
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            x = slice(bounds[p], bounds[p + 1])
            rows.append((p, home, False, _to_six(low[x]), own[x].tobytes(), times[x][many[x]].tobytes()))
        held = np.repeat(many, runs)
        repeats = every[held].tobytes() + owner[held].tobytes()
        spread = ((home >> 32) * 2654435761 + home) % (1 << bits)  # rosters travel with the ranges, evenly
        rows.append((spread, home, True, b"".join(sets), lengths.astype("<i8").tobytes(), repeats))
        return _packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, sets, n = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), size):
                name = set_key(s)
                if name is not None and name not in sets:
                    sets[name] = s
                    n += len(s)
                    if n >= PACK_SHINGLES or len(sets) >= PACK_SETS:
                        yield packed(sets, home)
                        home, sets, n = home + 1, {}, 0
        if sets:
            yield packed(sets, home)
            sets = {}
        release_memory()

    return documents.select(text).mapInArrow(run, _PACKED)


def _to_six(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _six(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _shared(group: pa.Table) -> pa.Table:
    """One range's shingles -> those found in two sets or more, per home, with c = the number of sets."""
    every = group.to_pylist()
    rows = [r for r in every if not r["roster"]]
    out = [(r["part"], r["home"], True, r["a"], r["b"], r["c"]) for r in every if r["roster"]]
    if rows:
        low = np.concatenate([_six(r["a"]) for r in rows])
        owner = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in rows])
        place = np.repeat(np.arange(len(rows)), [len(r["b"]) // 2 for r in rows])
        times = np.ones(len(low), np.int64)
        times[owner == MANY] = np.concatenate([np.frombuffer(r["c"], np.uint16) for r in rows])
        order = np.argsort(low)
        ordered = low[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        runs = np.diff(np.r_[heads, len(ordered)])
        found = np.minimum(np.repeat(np.add.reduceat(times[order], heads), runs), 65535).astype(np.uint16)
        keep = found >= 2
        order, found, ordered = order[keep], found[keep], ordered[keep]
        by_home = np.argsort(place[order], kind="stable")
        order, found, ordered = order[by_home], found[by_home], ordered[by_home]
        bounds = np.searchsorted(place[order], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                out.append((r["part"], r["home"], False, _to_six(ordered[a:b]), owner[order[a:b]].tobytes(), found[a:b].tobytes()))
    return pa.Table.from_batches([_packed(out)])


def _light(work: Callable[[pa.Table], pa.Table], group: pa.Table) -> pa.Table:
    """Work on a large group, after which the worker's freed memory is given back."""
    large, out = group.nbytes > 4 << 20, work(group)
    if large:
        release_memory()
    return out


_POINTS = "home bigint, set binary, n bigint, ids binary, border array<bigint>, load bigint"


def _identity(low: np.ndarray, part: int | np.ndarray, bits: int) -> np.ndarray:
    """The 64 bits (or as many as are known) of shingles of a range."""
    part = np.asarray(part).astype(np.uint64)
    return low | part << np.uint64(48) if bits <= 16 else low >> np.uint64(bits - 16) | part << np.uint64(64 - bits)


def _points(group: pa.Table, bits: int) -> pa.Table:
    """One home -> its points: sets that may link, with their shared shingles and the rarest ones that decide."""
    roster, rows = None, []
    for r in group.to_pylist():
        if r["roster"]:
            roster = r
        elif r["a"]:
            rows.append(r)
    names, sizes, ids, borders = [], [], [], []
    if rows and roster is not None:
        n = np.frombuffer(roster["b"], "<i8")
        shingle = np.concatenate([_identity(_six(r["a"]), r["part"], bits) for r in rows])
        owner = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in rows])
        found = np.concatenate([np.frombuffer(r["c"], np.uint16) for r in rows])
        many = owner == MANY
        if many.any():  # the sets behind these are in the roster, by whole hashes
            n_held = len(roster["c"]) // 10
            whole = np.frombuffer(roster["c"], np.uint64, n_held)
            held = _identity((whole << np.uint64(bits)) >> np.uint64(16), whole >> np.uint64(64 - bits), bits)
            names_of, times_of = shingle[many], found[many]
            by_name = np.argsort(names_of)
            times_held = times_of[by_name][np.searchsorted(names_of[by_name], held)]
            shingle = np.concatenate([shingle[~many], held])
            owner = np.concatenate([owner[~many], np.frombuffer(roster["c"], np.uint16, n_held, 8 * n_held)])
            found = np.concatenate([found[~many], times_held])
        order = np.lexsort((shingle, found, owner))
        shingle, owner = shingle[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(n) + 1))
        for k in range(len(n)):
            own = shingle[bounds[k] : bounds[k + 1]]
            reach = int(n[k]) - least_overlap(int(n[k])) + 1 - (int(n[k]) - len(own))
            if reach > 0:
                names.append(roster["a"][16 * k : 16 * k + 16])
                sizes.append(int(n[k]))
                ids.append(np.sort(own).tobytes())
                borders.append(own[:reach].view(np.int64))
    border = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum([len(b) for b in borders])]), pa.int32()),
        pa.array(np.concatenate(borders) if borders else np.empty(0, np.int64)),
    )
    home = pa.array([group.column("home")[0].as_py()] * len(names), pa.int64())
    load = pa.array([1 + len(x) // POINT_BYTES for x in ids], pa.int64())
    arrays = [home, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), border, load]
    return pa.Table.from_arrays(arrays, names=["home", "set", "n", "ids", "border", "load"])


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with a linked one at least."""
    up, down = SIMILAR
    return -(-n * up // down)


def links_to(shared: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
    up, down = SIMILAR
    return shared * down >= (n + others - shared) * up


EPS = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9


class Region:
    """Points in memory: joins them exactly, but for pairs that are connected through others."""

    def __init__(self, sets: list[bytes], sizes: np.ndarray, ids: list[bytes]):
        self.sets, self.n = sets, sizes
        found = [np.frombuffer(x, np.uint64) for x in ids]
        self.bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        self.every = np.concatenate(found) if found else np.empty(0, np.uint64)
        order = np.argsort(self.every, kind="stable")
        ordered = self.every[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        self.names, self.starts = ordered[heads], np.r_[heads, len(ordered)]
        self.holders = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(self.bounds))[order]

    def shared(self, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Shingles that a sorted set has in common with each of these points."""
        lengths = self.bounds[rows + 1] - self.bounds[rows]
        heads = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(heads, lengths) + np.repeat(self.bounds[rows], lengths)
        if not len(at) or not len(own):
            return np.zeros(len(rows), np.int64)
        x = self.every[at]
        place = np.searchsorted(own, x)
        place[place == len(own)] = 0
        hits = np.concatenate([[0], np.cumsum(own[place] == x)])
        return hits[heads + lengths] - hits[heads]

    def ids(self, k: int) -> np.ndarray:
        return self.every[self.bounds[k] : self.bounds[k + 1]]

    def candidates(self, k: int) -> np.ndarray:
        """The points that have one of those shingles of which any point linked to the k-th one must have one: the
        fewest that suffice, taken from those that the fewest points have."""
        own = np.searchsorted(self.names, self.ids(k))
        holders = self.starts[own + 1] - self.starts[own]
        reach = len(own) - least_overlap(int(self.n[k])) + 1
        if reach <= 0:
            return np.empty(0, np.int64)
        rare = own[np.argsort(holders, kind="stable")[:reach]]
        return np.unique(np.concatenate([self.holders[self.starts[i] : self.starts[i + 1]] for i in rare.tolist()])).astype(np.int64)

    def distances(self, own: np.ndarray, n: int) -> np.ndarray:
        """The distance of every point to a set."""
        at = np.searchsorted(self.names, own)
        there = at < len(self.names)
        there[there] = self.names[at[there]] == own[there]
        at = at[there]
        holders = [self.holders[self.starts[i] : self.starts[i + 1]] for i in at.tolist()]
        shared = np.bincount(np.concatenate(holders), minlength=len(self.n)) if holders else np.zeros(len(self.n), np.int64)
        return 1 - shared / (self.n + n - shared)

    def join(self, linked: np.ndarray | None = None, key: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links (row, row) that connect all points which any chain of links connects. Points that are ``linked`` are
        known to be connected; only pairs with a ``key`` point matter."""
        label = np.arange(len(self.sets))
        if linked is not None and linked.any():
            label[linked] = np.flatnonzero(linked)[0]
        open_ = np.ones(len(self.sets), bool)
        links: list[tuple[int, int]] = []
        if len(self.sets) < 2:
            return links
        first = self.distances(self.ids(0), int(self.n[0]))
        first[0] = 0
        names, counts = np.unique(label, return_counts=True)
        left = dict(zip(names.tolist(), counts.tolist(), strict=True))
        turn = np.argsort(-counts[np.searchsorted(names, label)], kind="stable")[::-1]  # points of small components first
        for pivot in turn.tolist():
            if len(left) == 1:
                return links
            open_[pivot] = False
            own = int(label[pivot])
            left[own] -= 1
            if not left[own]:
                del left[own]
            rows = self.candidates(pivot)
            rows = rows[open_[rows] & (label[rows] != own)]
            if key is not None and not key[pivot]:
                rows = rows[key[rows]]
            # the window of the triangle inequality, and sizes that allow a link
            small, large = np.minimum(self.n[rows], self.n[pivot]), np.maximum(self.n[rows], self.n[pivot])
            rows = rows[(np.abs(first[rows] - first[pivot]) <= EPS) & (small * SIMILAR[1] >= large * SIMILAR[0])]
            if not len(rows):
                continue
            hits = rows[links_to(self.shared(self.ids(pivot), rows), self.n[pivot], self.n[rows])]
            names, places = np.unique(label[hits], return_index=True)
            links += [(pivot, k) for k in hits[places].tolist()]
            for name in names.tolist():
                label[label == name] = own
                left[own] = left.get(own, 0) + left.pop(name)
        return links


def _join_task(group: pa.Table) -> pa.Table:
    """The points of one task -> links. In a task of two blocks only pairs with a point of the key role matter."""
    group = group.sort_by("set")
    sets, role, key = group.column("set").to_pylist(), group.column("role").to_numpy(), group.column("key_role")[0].as_py()
    region = Region(sets, group.column("n").to_numpy(), group.column("ids").to_pylist())
    links = region.join(group.column("linked").to_numpy(zero_copy_only=False), role != VISITOR if key is None else role == key)
    return pa.table({"a": pa.array([sets[i] for i, _ in links], pa.binary()), "b": pa.array([sets[k] for _, k in links], pa.binary())})


def _load() -> Column:
    """What a point weighs in a task: one, and one more for every POINT_BYTES."""
    return F.lit(1) + F.floor(F.octet_length("ids") / POINT_BYTES)


_CELLS = "region bigint, cell bigint, pivot binary, role int, linked boolean, set binary, n bigint, ids binary"


def _assign(group: pa.Table) -> pa.Table:
    """Some points of a region and all its pivots -> the points once for each cell that they belong to or visit; those far
    from all pivots once, without a cell."""
    group = group.sort_by("set")
    chosen = group.column("is_pivot").to_numpy(zero_copy_only=False)
    pivots, points = group.filter(pa.array(chosen)), group.filter(pa.array(~chosen))
    sets, sizes, ids = points.column("set").to_pylist(), points.column("n").to_numpy(), points.column("ids").to_pylist()
    out = {name: [] for name in ("pivot", "cell", "role", "linked", "row")}
    if sets:
        region = Region(sets, sizes, ids)
        names, n_of = pivots.column("set").to_pylist(), pivots.column("n").to_pylist()
        # ids lack the shingles that no other set has, so a pivot can seem far from itself: it goes by its name
        far = np.full((max(1, len(names)), len(sets)), np.inf)
        for p, (name, n, x) in enumerate(zip(names, n_of, pivots.column("ids").to_pylist(), strict=True)):
            far[p] = np.where([s == name for s in sets], 0.0, region.distances(np.frombuffer(x, np.uint64), n))
        home, nearest = far.argmin(axis=0), far.min(axis=0)
        is_pivot = np.isin(np.array(sets, object), np.array(names, object))
        for k, s in enumerate(sets):
            if nearest[k] >= NEAR:
                visits = np.flatnonzero(far[:, k] <= NEAR + EPS)
                out["pivot"].append(None)
                out["cell"].append(None)
                out["role"].append(HOME)
                out["linked"].append(False)
                out["row"].append(k)
            else:
                visits = np.flatnonzero(far[:, k] <= min(NEAR, nearest[k] + EPS) + EPS)
            for p in visits.tolist():
                linked = bool(far[p, k] <= EPS)
                if p == home[k] and nearest[k] < NEAR:
                    role = BALL if linked else HOME
                else:
                    role = VISITOR
                # a pivot has been compared with everything: it stays for its links' sake elsewhere only
                if not (is_pivot[k] and names[p] == s):
                    out["pivot"].append(names[p])
                    out["cell"].append(int.from_bytes(names[p][:8], "little", signed=True))
                    out["role"].append(role)
                    out["linked"].append(linked)
                    out["row"].append(k)
    rows = np.array(out["row"], np.int64)
    found = points.select(["region", "set", "n", "ids"]).take(pa.array(rows))
    columns = {"region": found.column("region"), "cell": pa.array(out["cell"], pa.int64()), "pivot": pa.array(out["pivot"], pa.binary())}
    columns |= {"role": pa.array(out["role"], pa.int32()), "linked": pa.array(out["linked"], pa.bool_())}
    return pa.table(columns | {c: found.column(c) for c in ("set", "n", "ids")})


def _single(points: DataFrame, cell: Column, role: Column, linked: Column) -> DataFrame:
    """Regions or cells that are one task each."""
    zero, none = F.lit(0), F.lit(None).cast("int")
    return points.select("region", cell.alias("cell"), zero.alias("i"), zero.alias("j"), zero.alias("kind"), none.alias("key_role"), role.alias("role"), linked.alias("linked"), "set", "n", "ids")


def _blocks(points: DataFrame) -> DataFrame:
    """Points (region, cell, role, linked, set, n, ids, ball_blocks, other_blocks) of what is too large for a task, once
    for each pair of blocks that must be compared: those of a ball with those of other points, and the latter with each
    other."""
    name = lambda n: F.pmod(F.xxhash64("set", F.lit(7)), n).cast("int")
    ball, mine = F.col("role") == BALL, F.when(F.col("role") == BALL, name(F.col("ball_blocks"))).otherwise(name(F.col("other_blocks")))
    rows = points.withColumn("own", mine)
    none = F.array().cast("array<struct<i:int,j:int,kind:int,key_role:int>>")
    task = lambda i, j, kind, key: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(key).cast("int").alias("key_role"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    own = F.col("own")
    with_others = F.transform(upto("other_blocks"), lambda j: task(own, j, 1, BALL))
    with_ball = F.transform(upto("ball_blocks"), lambda i: task(i, own, 1, BALL))
    among = F.transform(upto("other_blocks"), lambda j: task(F.least(own, j), F.greatest(own, j), 2, HOME))
    tasks = F.when(ball, with_others).otherwise(F.concat(with_ball, among))
    rows = rows.withColumn("task", F.explode(F.coalesce(tasks, none)))
    return rows.select("region", "cell", "task.i", "task.j", "task.kind", "task.key_role", "role", "linked", "set", "n", "ids")


def _divided(points: DataFrame, large: DataFrame, region_points: int, turn: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Points of large regions (region, set, n, ids) and their loads (region, load, points) -> (links to pivots, tasks, points far
    from all pivots)."""
    name = F.xxhash64("set", F.lit(turn))
    salts = F.ceil(F.col("load") / region_points).cast("int")
    rows = points.join(large, "region").withColumn("salts", salts)
    share = F.lit(float(PIVOTS)) / F.col("points")
    pivots = rows.where(F.pmod(name, F.lit(1 << 30)) < share * (1 << 30))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("set", F.lit(11)), F.col("salts")).cast("int"))
    columns = ["region", "salt", "set", "n", "ids"]
    both = dealt.select(*columns, F.lit(False).alias("is_pivot")).unionByName(pivots.select(*columns, F.lit(True).alias("is_pivot")))
    found = written(both.groupBy("region", "salt").applyInArrow(lambda t: _assign(t), _CELLS), "cells")
    links = found.where("linked").select(F.col("pivot").alias("a"), F.col("set").alias("b"))
    cells = found.where("cell is not null")
    of = lambda when: F.coalesce(F.sum(F.when(when, _load())), F.lit(0))
    role = F.col("role")
    sums = cells.groupBy("region", "cell").agg(of(role == BALL).alias("ball"), of(role != BALL).alias("others"), of(role != VISITOR).alias("home"))
    half = max(1, region_points // 2)
    blocks = {n: F.ceil(F.col(c) / half).cast("bigint") for n, c in (("ball_blocks", "ball"), ("other_blocks", "others"))}
    sums = written(sums.where("others > 0 and home > 0").withColumns(blocks), "cell_sizes")
    fits = F.col("ball") + F.col("others") <= region_points
    one = cells.join(sums.where(fits).select("region", "cell"), ["region", "cell"])
    many = cells.join(sums.where(~fits).select("region", "cell", "ball_blocks", "other_blocks"), ["region", "cell"])
    tasks = [_single(one, F.col("cell"), role, F.col("linked")), _blocks(many)]
    return links, tasks, found.where("cell is null").select("region", "set", "n", "ids")


def similar_sets(documents: DataFrame, total: int, text: str = "text", size: int = SHINGLE, region_points: int = REGION_POINTS) -> DataFrame:
    """Links (a, b) between names of different sets, enough to connect all that chains of links connect."""
    bits = min(24, max(3, math.ceil(math.log2(max(1, total) / RANGE_SHINGLES))))
    packed = _pack_shingles(documents, text, size, bits)
    shared = packed.groupBy("part").applyInArrow(lambda t: _light(_shared, t), _PACKED)
    points = written(shared.groupBy("home").applyInArrow(lambda t: _light(lambda x: _points(x, bits), t), _POINTS), "points")
    # cells and regions go by 64-bit names of points: should two points ever share one, a region has both of them
    point = F.xxhash64("set").alias("point")
    cells = points.select(point, F.explode("border").alias("shingle"))
    spans = cells.groupBy("shingle").agg(F.min("point").alias("region"), F.max("point").alias("last"))
    spans = written(spans.where("region < last").select("shingle", "region"), "cells")
    # a plain join of two exchanges: AQE splits a cell that a common shingle makes large
    members = cells.join(spans, "shingle").select("region", "point").distinct()
    # a set that several homes have is taken from one of them
    chosen = points.groupBy("set").agg(F.min("home").alias("home"), F.min("load").alias("load")).withColumn("point", F.xxhash64("set"))
    members = written(members.join(chosen, "point").select("region", "set", "home", "load"), "members")
    placed = members.drop("load").join(points.select("set", "home", "n", "ids"), ["set", "home"]).select("region", "set", "n", "ids")
    home, no = F.lit(HOME), F.lit(False)
    whole = F.lit(None).cast("bigint")
    load = members.groupBy("region").agg(F.sum("load").alias("load"), F.count("*").alias("points"))
    large = written(load.where(F.col("load") > region_points), "large")
    if not large.limit(1).count():
        return _links(_single(placed, whole, home, no))
    links, rest = [], written(placed.join(large, "region", "left_semi"), "large_points")
    tasks = [_single(placed.join(large, "region", "left_anti"), whole, home, no)]
    for turn in range(ROUNDS):
        to_pivots, cells, far = _divided(rest, large, region_points, turn)
        links.append(to_pivots)
        tasks += cells
        rest = far.withColumn("region", F.xxhash64("region", F.lit(turn)))
        load = written(rest.groupBy("region").agg(F.sum(_load()).alias("load"), F.count("*").alias("points")), "rest_sizes")
        large = load.where(F.col("load") > region_points)
        tasks.append(_single(rest.join(load.where(F.col("load") <= region_points), "region", "left_semi"), whole, home, no))
        rest = rest.join(large, "region", "left_semi")
        if not large.limit(1).count():
            break
    else:
        half = max(1, region_points // 2)
        many = rest.join(large.select("region", F.ceil(F.col("load") / half).cast("bigint").alias("other_blocks")), "region")
        tasks.append(_blocks(many.withColumns({"cell": whole, "role": home, "linked": no, "ball_blocks": F.lit(0).cast("bigint")})))
    return reduce(DataFrame.unionByName, [_links(reduce(DataFrame.unionByName, tasks)), *links])


def _links(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("region", "cell", "i", "j", "kind").applyInArrow(lambda t: _join_task(t), "a binary, b binary")


def jaccard_components(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, region_points: int = REGION_POINTS
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id.

    Words are runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased; a set has a text's distinct shingles of
    ``size`` words, the whole sequence where it is shorter, nothing for a null or empty text. Two texts link when
    100 * shared >= 75 * union. ``component_id`` is the least key that links reach, its own included; a text without
    shingles is alone. A null key never names a component while another is there. Repeated rows are kept.

    Texts are read twice and never shuffled. Equal sets meet as one row per task and set, so large groups of copies
    are counted before they move. Shingles are compared by 64-bit hashes, points by 51 of those bits in small tables and by
    all of them in large ones. Very long texts count for more than one point, so tasks stay bounded by bytes.
    """
    found = _grouped(documents, key, text, size, region_points)
    return found.select(F.col("key").alias(key), "n_shingles", "component_id")


def _components_of_sets(rows: DataFrame, documents: DataFrame, text: str, size: int, region_points: int) -> DataFrame:
    """Rows (key, n_shingles, set) -> (set, component_id, first), where first is true of one set of each component."""
    # nodes are sets, in order of their least key with nulls last: the least node of a component has its least key
    least = F.min("key").alias("least")
    classes = rows.where("set is not null").groupBy("set").agg(least).select("set", F.struct(F.isnull("least").alias("none"), "least", "set").alias("node"))
    classes = written(classes, "classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    with scratch(documents.sparkSession):
        named = written(similar_sets(documents, total, text, size, region_points), "set_links", keep=True)
    ends = named.join(classes.select(F.col("set").alias("a"), F.col("node").alias("x")), "a")
    ends = ends.join(classes.select(F.col("set").alias("b"), F.col("node").alias("y")), "b")
    found = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = found.select(F.col("node.set").alias("set"), F.col("component").alias("first"))
    least = classes.join(found, "set", "left").select("set", F.coalesce("first", "node").alias("first"))
    return least.select("set", F.col("first.least").alias("component_id"), (F.col("first.set") == F.col("set")).alias("first"))


def _grouped(documents: DataFrame, key: str, text: str, size: int, region_points: int) -> DataFrame:
    """(key, n_shingles, set, component_id, stays): stays is true of rows without shingles, and of those with the least
    key and, under that key, the least set of their component, which are repeated rows where they are several."""
    rows = written(set_keys(documents, key, text, size), "sets")
    with scratch(documents.sparkSession):
        least = written(_components_of_sets(rows, documents, text, size, region_points), "component_of_set", keep=True)
    joined = rows.join(least, "set", "left")
    stays = F.isnull("set") | (F.col("first") & F.col("key").eqNullSafe(F.col("component_id")))
    return joined.select("key", "n_shingles", "set", F.coalesce("component_id", "key").alias("component_id"), stays.alias("stays"))


def one_per_group(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, region_points: int = REGION_POINTS) -> DataFrame:
    """The row with the least key of every group, nulls last, with all columns. Of rows that repeat the key in one group
    one stays; a text without shingles is alone in its group, and all its rows stay.

    Rows go by key where all rows of a key go. Only those keys of which some rows stay and some go, as null or a
    repeated one may, have their rows numbered, written and told apart by their sets.
    """
    with scratch(documents.sparkSession):
        found = written(_grouped(documents, key, text, size, region_points), "groups", keep=True)
    kinds = found.groupBy("key", "set", "stays").agg(F.count("*").alias("n"))
    left = F.when(F.isnull("set"), F.col("n")).when(F.col("stays"), F.lit(1)).otherwise(F.lit(0))
    keys = written(kinds.groupBy("key").agg(F.sum("n").alias("n"), F.sum(left).alias("left")), "keys")
    gone, mixed = keys.where("left = 0").select("key"), keys.where("left > 0 and left < n").select("key")
    if not mixed.limit(1).count():
        return without(documents, key, gone)
    kept = without(documents, key, gone.unionByName(mixed))
    there = mixed.where("key is not null").select(F.col("key").alias("__mixed"))
    some = documents.join(there, documents[key] == there["__mixed"], "left_semi")
    if mixed.where("key is null").limit(1).count():
        some = some.unionByName(documents.where(documents[key].isNull()))
    some = written(_with_sets(some, text, size).withColumn("__row", F.monotonically_increasing_id()), "some")
    stay = found.where("stays and set is not null").select(F.col("key").alias("__key"), F.col("set").alias("__first")).distinct()
    rows = some.where("__set is not null").select(some[key].alias("__own"), "__set", "__row")
    first = rows.join(stay, (F.col("__set") == F.col("__first")) & F.col("__own").eqNullSafe(F.col("__key"))).groupBy("__set").agg(F.min("__row").alias("__row"))
    some = without(some, "__row", rows.select("__row").join(first.select("__row"), "__row", "left_anti"))
    return kept.unionByName(some.drop("__set", "__row"))


def _with_sets(documents: DataFrame, text: str, size: int) -> DataFrame:
    """All columns and __set, the name of each text's shingle set."""
    at = documents.columns.index(text)
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([set_key(s) for s in shingle_sets(batch.column(at), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "__set"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("__set", BinaryType())]))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
