"""Near duplicates of embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors are one class.  A tree of centres over a bounded sample deals the classes into
groups: at each level a class goes to its nearest centre, down to a leaf of about `group`
classes.  Two leaves whose covering balls are further apart than the threshold's chord
are never compared.  Each group builds a cover tree, nested levels whose radii halve; the
trees of two groups are walked together, level by level, and a pair of nodes is dropped where
the distance of its centres is over the sum of both covering radii and that chord, and
taken whole where that distance and both radii together are within the chord.  What
remains are leaves, whose cosine is taken.

Centres are compared many at a time in single precision, with a margin over its rounding, and
what passes again in double precision.  A pair of groups sends back, for each class, a
count of links and one link to the least class that it reaches there; never all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, components, local_forest, save, task_id

#: Most classes that the tree of centres is made from, most bytes of a group's vectors in
#: double precision, fewest groups that a table is dealt into (if it has as many classes).
CENTRE_SAMPLE, GROUP_BYTES, LEAST_GROUPS = 4096, 8 << 20, 4
#: Largest radius of a level (two balls of radius 1 are never far enough apart to be told
#: from each other on a sphere), smallest, most vectors of a leaf, and radius of a leaf of several.
MOST_RADIUS, LEAST_RADIUS, LEAF, SNUG = 1 / 2, 1 / 64, 4, 1 / 4
#: Rounding allowed for in bounds; closer cosines than this to the threshold are taken anew.
SLACK = 1e-7
#: Centres of a tile, numbers that are held at once for pairs, and links.
TILE, HELD, LINKS = (256, 2048), 1 << 21, 1 << 19


def chord(cosine: np.ndarray | float) -> np.ndarray | float:
    """Distance of unit vectors of this cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def even(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two each, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = even(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def net(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(heads, owner): rows of x that are over r from each other, the first row one of them,
    and for each row a head within r of it."""
    owner, heads = np.full(len(x), -1), []
    rest, least = np.arange(len(x)), np.float32(1 - r * r / 2)
    while len(rest):
        block = rest[:256]
        near = x[block] @ x[block].T >= least
        free, own = np.ones(len(block), bool), []
        for i in range(len(block)):
            if free[i]:
                own.append(i)
                free &= ~near[i]
        c = x[rest] @ x[block[own]].T
        best = c.argmax(1)
        ok = c[np.arange(len(rest)), best] >= least
        best[own], ok[own] = np.arange(len(own)), True
        owner[rest[ok]] = best[ok] + len(heads)
        heads += block[own].tolist()
        rest = rest[~ok]
    return np.array(heads, np.int64), owner


class CoverTree:
    """Nested nets over unit vectors, radii halving from MOST_RADIUS; node 0 is the root.

    centre, radius (the farthest member), the range lo:hi of `order` that holds a node's members,
    and its children as a range of node numbers, empty in a leaf: a vector alone, at most
    LEAF vectors within SNUG of its centre, or any number within LEAST_RADIUS."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        y = x.astype(np.float32)
        self.order = np.arange(n)
        made = [(np.zeros(1, np.int64), np.full(1, float(chord((x @ x[0]).min())) if n else 0.0), np.zeros(1, np.int64), np.full(1, n))]
        kid_lo, kid_hi = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        count, todo = 1, [(0, 0, 0, n, made[0][1][0], MOST_RADIUS)]
        spans = {}
        while todo:
            node, centre, lo, hi, far, r = todo.pop()
            if hi - lo == 1 or far <= (SNUG if hi - lo <= LEAF else LEAST_RADIUS):
                continue
            while r >= far:  # levels that would only repeat the node
                r /= 2
            members = self.order[lo:hi]
            members = np.concatenate([[centre], members[members != centre]])  # nesting: a node's centre heads its own child
            heads, owner = net(y[members], r)
            turn = np.argsort(owner, kind="stable")
            self.order[lo:hi] = members[turn]
            owner = owner[turn]
            starts = np.searchsorted(owner, np.arange(len(heads)))
            centres = members[heads]
            radii = np.maximum.reduceat(chord((x[self.order[lo:hi]] * x[centres[owner]]).sum(1)), starts)
            sizes = np.diff(np.append(starts, hi - lo))
            radii[sizes == 1] = 0.0
            first = count
            count += len(heads)
            spans[node] = (first, count)
            made.append((centres, radii, lo + starts, lo + starts + sizes))
            todo += [(first + i, centres[i], lo + starts[i], lo + starts[i] + sizes[i], radii[i], r / 2) for i in np.flatnonzero(sizes > 1).tolist()]
        self.centre, self.radius, self.lo, self.hi = (np.concatenate(z) for z in zip(*made, strict=True))
        self.kid_lo, self.kid_hi = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for node, (a, b) in spans.items():
            self.kid_lo[node], self.kid_hi[node] = a, b
        self.bind(x)

    def bind(self, x: np.ndarray) -> CoverTree:
        self.x, self.y = x, x.astype(np.float32)
        return self

    def __getstate__(self) -> dict:
        """The tree without its vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "y")}


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all values of the ranges lo:hi."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def _cosines_at(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def dual_pairs(p: CoverTree, q: CoverTree, raw_p: np.ndarray, raw_q: np.ndarray, threshold: float, same: bool, whole: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in p, j in q) of cosine >= threshold; with `same` (one tree) each pair once.

    `raw_p`, `raw_q`: the vectors whose cosine counts where it is close to the threshold.
    `whole` is called with pairs of nodes (a, b) all of whose members link, in place of
    their pairs; with `same`, a = b stands for the pairs inside a node."""
    if not len(p.x) or not len(q.x):
        return
    reach = float(chord(threshold))
    margin = np.float32(4e-7 * (p.x.shape[1] + 4))  # over the rounding of a product in single precision
    held = max(1024, HELD // p.x.shape[1])

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that the covering radii neither keep apart nor hold together."""
        d = chord(_dots(p.x[p.centre[a]], q.x[q.centre[b]]))
        radii = p.radius[a] + q.radius[b]
        ok = d <= radii + reach + SLACK
        if whole is not None:
            every = np.where((a == b) & same, 2 * p.radius[a], d + radii) < reach - SLACK
            if every.any():
                whole(a[every], b[every])
                ok &= ~every
        return a[ok], b[ok]

    def tiles(a: np.ndarray, b: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs of all of a and b, by products of matrices; `both`: of one set, each pair once."""
        a, b = a[np.argsort(p.radius[a], kind="stable")], b[np.argsort(q.radius[b], kind="stable")]  # tiles of like radii
        for at in range(0, len(b), TILE[1]):
            some = b[at : at + TILE[1]]
            cy = q.y[q.centre[some]].T
            wide = float(q.radius[some].max()) + reach + SLACK
            for lo in range(0, min(len(a), at + TILE[1]) if both else len(a), TILE[0]):
                part = a[lo : lo + TILE[0]]
                bound = np.minimum(p.radius[part] + wide, 2.0)
                c = p.y[p.centre[part]] @ cy
                i, j = np.divmod(np.flatnonzero(c >= (1 - bound * bound / 2).astype(np.float32)[:, None] - margin), len(some))
                if both:
                    ok = lo + i <= at + j
                    i, j = i[ok], j[ok]
                for k in range(0, len(i), held):
                    yield close(part[i[k : k + held]], some[j[k : k + held]])

    def lists(a: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs below each pair of nodes."""
        ends = np.cumsum((a_hi - a_lo) * (b_hi - b_lo))
        for part in np.split(np.arange(len(a)), np.searchsorted(ends, np.arange(held, ends[-1], held))) if len(a) else []:
            which, x = _ranges(a_lo[part], a_hi[part])
            again, y = _ranges(b_lo[part][which], b_hi[part][which])
            x, which = x[again], which[again]
            if same:
                ok = (a[part][which] != b[part][which]) | (x <= y)
                x, y = x[ok], y[ok]
            yield close(x, y)

    def settle(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The links between leaves."""
        n = (p.hi - p.lo)[a] * (q.hi - q.lo)[b]
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, held):
            at = np.arange(lo, min(lo + held, int(ends[-1])))
            which = np.searchsorted(ends, at, "right")
            x, y = a[which], b[which]
            s, t = np.divmod(at - (ends - n)[which], (q.hi - q.lo)[y])
            i, j = p.order[p.lo[x] + s], q.order[q.lo[y] + t]
            if same:
                ok = (x != y) | (i < j)
                i, j = i[ok], j[ok]
            c = _dots(p.x[i], q.x[j])
            keep = c >= threshold
            edge = np.abs(c - threshold) <= SLACK
            keep[edge] = _cosines_at(raw_p[i[edge]], raw_q[j[edge]]) >= threshold
            if keep.any():
                yield (np.minimum(i, j)[keep], np.maximum(i, j)[keep]) if same else (i[keep], j[keep])

    root = np.zeros(1, np.int64)
    front = [iter([(root, root)])]  # depth first, so that few pairs are held
    while front:
        a, b = next(front[-1], (None, None))
        if a is None:
            front.pop()
            continue
        la, lb = p.kid_lo[a] == p.kid_hi[a], q.kid_lo[b] == q.kid_hi[b]
        yield from settle(a[la & lb], b[la & lb])
        a, b, la, lb = (z[~(la & lb)] for z in (a, b, la, lb))
        # both ends are opened, but for leaves, and for the much smaller ball of two
        open_a, open_b = ~la & (lb | (2 * p.radius[a] >= q.radius[b])), ~lb & (la | (2 * q.radius[b] >= p.radius[a]))
        a_lo, a_hi = np.where(open_a, p.kid_lo[a], a), np.where(open_a, p.kid_hi[a], a + 1)
        b_lo, b_hi = np.where(open_b, q.kid_lo[b], b), np.where(open_b, q.kid_hi[b], b + 1)
        large = (a_hi - a_lo) * (b_hi - b_lo) > held
        front += [tiles(np.arange(a_lo[k], a_hi[k]), np.arange(b_lo[k], b_hi[k]), same and a[k] == b[k]) for k in np.flatnonzero(large)]
        front.append(lists(*(z[~large] for z in (a, a_lo, a_hi, b, b_lo, b_hi))))


class Found:
    """Links of two groups (vectors, nodes, copies, tree): a count for each class, and a forest."""

    def __init__(self, p: tuple, q: tuple, same: bool):
        self.p, self.q, self.same = p, q, same
        self.n_p, self.n_q = np.zeros(len(p[1]), np.int64), np.zeros(len(q[1]), np.int64)
        # counts of whole nodes, by place in a tree's order
        self.at_p, self.at_q = np.zeros(len(p[1]) + 1, np.int64), np.zeros(len(q[1]) + 1, np.int64)
        self.sum_p, self.sum_q = (np.concatenate([[0], np.cumsum(z[2][z[3].order])]) for z in (p, q))
        self.a, self.b, self.held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.n_p, i, self.q[2][j])
        np.add.at(self.n_p if self.same else self.n_q, j, self.p[2][i])
        self.link(self.p[1][i], self.q[1][j])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > LINKS:
            a, b = local_forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.held = [a], [b], 0

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        tp, tq = self.p[3], self.q[3]
        at_q = self.at_p if self.same else self.at_q
        n_a, n_b = self.sum_p[tp.hi[a]] - self.sum_p[tp.lo[a]], self.sum_q[tq.hi[b]] - self.sum_q[tq.lo[b]]
        np.add.at(self.at_p, tp.lo[a], n_b)
        np.add.at(self.at_p, tp.hi[a], -n_b)
        other = (a != b) if self.same else np.ones(len(a), bool)
        np.add.at(at_q, tq.lo[b[other]], n_a[other])
        np.add.at(at_q, tq.hi[b[other]], -n_a[other])
        _, at = _ranges(tp.lo[a[~other]], tp.hi[a[~other]])  # a node with itself: not a class with itself
        np.add.at(self.n_p, tp.order[at], -self.p[2][tp.order[at]])
        first_a, first_b = self.p[1][tp.order[tp.lo[a]]], self.q[1][tq.order[tq.lo[b]]]
        self.link(first_a, first_b)
        for nodes, tree, side, first in ((a, tp, self.p[1], first_a), (b, tq, self.q[1], first_b)):
            _, one = np.unique(nodes, return_index=True)
            which, at = _ranges(tree.lo[nodes[one]], tree.hi[nodes[one]])
            self.link(first[one][which], side[tree.order[at]])

    def result(self) -> tuple[np.ndarray, np.ndarray, list]:
        """(node, links, least node reached, None if it is the least) of the classes that have links."""
        self.n_p[self.p[3].order] += np.cumsum(self.at_p)[:-1]
        self.n_q[self.q[3].order] += np.cumsum(self.at_q)[:-1]
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        v, top = local_forest(a[a != b], b[a != b])
        counts = self.n_p if self.same else np.concatenate([self.n_p, self.n_q])
        nodes = self.p[1] if self.same else np.concatenate([self.p[1], self.q[1]])
        up = dict(zip(v.tolist(), top.tolist(), strict=True))
        hit = np.flatnonzero(counts)
        return nodes[hit], counts[hit], [up.get(x) for x in nodes[hit].tolist()]


class Centres:
    """A tree of centres over a sample: leaves number the groups, centre[g] is a group's."""

    def __init__(self, sample: np.ndarray, group: float):
        """`group`: about how many of the sample make up a group."""
        self.kids: list[tuple[np.ndarray, list[int]]] = []  # centres of a node's children, and their places: a node, or -1 - group
        self.centre: list[np.ndarray] = []
        self.root = self._node(sample, sample[0], group)

    def _node(self, own: np.ndarray, centre: np.ndarray, group: float) -> int:
        want = int(min(np.ceil(len(own) / group), len(own), 64))
        c = own[:want]
        c = c[np.sort(np.unique(c, axis=0, return_index=True)[1])]
        if want < 2 or len(c) < 2:
            self.centre.append(centre)
            return -len(self.centre)
        at = len(self.kids)
        self.kids.append((c, []))
        near = (own @ c.T).argmax(1)
        if (near == near[0]).all():  # all as near to one centre: not to be split
            self.kids.pop()
            self.centre.append(centre)
            return -len(self.centre)
        self.kids[at][1].extend(self._node(own[near == k], c[k], group) for k in range(len(c)))
        return at

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The group of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            c, places = self.kids[node]
            near = (x[rows] @ c.T).argmax(1)
            todo += [(places[k], rows[near == k]) for k in np.unique(near)]
        return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", group: int | None = None) -> DataFrame:
    """One row for each row of `vectors`: vec_id, n_links (other rows of cosine >= threshold),
    component_id (smallest id reachable by links, itself included).

    Vectors that are null, empty, zero, hold null or non-finite components, or differ in
    length from another link with nothing they can't be compared with; any other vector
    counts, however large or small its norm.  Repeated rows count as vectors of their own; other
    columns are ignored, whatever their names; an empty table gives none.  `group`: about
    how many classes make up a group (else GROUP_BYTES of them).
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    form = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            lists = b.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(form) + np.dtype(form).type(0)  # no negative zeros
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            ok = (size > 0) & (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            raw, width = x.tobytes(), np.dtype(form).itemsize
            blobs = [raw[(e - s) * width : e * width] if k else None for e, s, k in zip(ends.tolist(), size.tolist(), ok.tolist(), strict=True)]
            uid = (task_id() << 40) + n + np.arange(b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(uid), pa.array(blobs, pa.binary())], names=["vec_id", "uid", "vec"])

    rows = save(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(read, f"vec_id {kind}, uid long, vec binary"), "vectors").df
    classes = save(rows.where("vec is not null").groupBy("vec").agg(F.min("uid").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes").df
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    def units(blobs: list[bytes]) -> np.ndarray:
        return unit_rows(np.frombuffer(b"".join(blobs), form).astype(np.float64).reshape(len(blobs), -1))

    sample = [bytes(r["vec"]) for r in classes.orderBy(F.xxhash64("vec"), "node").limit(CENTRE_SAMPLE).select("vec").collect()]
    trees: dict[int, tuple[int, Centres]] = {}  # by bytes of a vector: number of its first group, centres
    groups = 0
    for size in sorted({len(v) for v in sample}):
        most = group or max(1, min(GROUP_BYTES * np.dtype(form).itemsize // (8 * size), -(-n // LEAST_GROUPS)))
        trees[size] = groups, Centres(units([v for v in sample if len(v) == size]), most * len(sample) / n)
        groups += len(trees[size][1].centre)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A class's group and its distance from the group's centre."""
        for b in batches:
            blobs = b.column(0).to_pylist()
            size = np.array([len(v) for v in blobs])
            g, far = np.zeros(len(blobs), np.int64), np.full(len(blobs), 2.0)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                if s not in trees:  # a length that the sample missed: one group, compared with itself
                    g[at] = groups + s
                    continue
                first, tree = trees[s]
                x = units([blobs[i] for i in at])
                own = tree.deal(x)
                g[at], far[at] = first + own, chord((x * np.stack(tree.centre)[own]).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g), pa.array(far)], names=["vec", "node", "copies", "least", "g", "far"])

    dealt = save(classes.mapInArrow(deal, f"vec binary, node long, copies long, least {kind}, g long, far double"), "dealt")
    # a row for each leaf of the centres' tree (at most CENTRE_SAMPLE) and each length that the sample missed
    facts = {r["g"]: (r["n"], r["far"], r["size"]) for r in dealt.df.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(F.octet_length("vec")).alias("size")).collect()}
    parts, base, at = {}, {}, 0
    for g in sorted(facts):
        count, _, size = facts[g]
        most = 2 * (group or max(1, min(GROUP_BYTES * np.dtype(form).itemsize // (8 * size), -(-n // LEAST_GROUPS))))
        base[g], parts[g] = at, -(-count // most)  # a leaf that turned out larger is dealt by hash
        at += parts[g]
    total = at
    reach = float(chord(threshold)) + 2 * SLACK
    partners: dict[int, list[int]] = {}
    for size, (first, tree) in trees.items():
        own = [g for g in range(first, first + len(tree.centre)) if g in facts]
        c = np.stack([tree.centre[g - first] for g in own]) if own else np.zeros((0, 1))
        far = np.array([facts[g][1] for g in own])
        for k, g in enumerate(own):
            partners[g] = [own[i] for i in np.flatnonzero(chord(c @ c[k]) <= far + far[k] + reach)]

    def plant(part: object, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """A group as one row for each pair of groups that it is in."""
        g, own = t.column("g")[0].as_py(), int(part)
        blobs = t.column("vec").to_pylist()
        blob = pickle.dumps((b"".join(blobs), t.column("node").to_numpy(), t.column("copies").to_numpy(), CoverTree(units(blobs))))
        for o in [base[d] + k for d in partners.get(g, [g]) for k in range(parts[d])]:
            yield pa.RecordBatch.from_arrays([pa.array([min(own, o) * total + max(own, o)], pa.int64()), pa.array([own], pa.int64()), pa.array([blob], pa.binary())], names=["pair", "side", "blob"])

    def loaded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
        raw, node, copies, tree = pickle.loads(blob)
        x = even(np.frombuffer(raw, form).astype(np.float64).reshape(len(node), -1))
        return x, node, copies, tree.bind(unit_rows(x))

    def walk(pair: object, t: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = sorted(zip(t.column("side").to_pylist(), t.column("blob").to_pylist(), strict=True))
        same = sides[0][0] == sides[-1][0]
        p = loaded(sides[0][1])
        q = p if same else loaded(sides[-1][1])
        found = Found(p, q, same)
        for i, j in dual_pairs(p[3], q[3], p[0], q[0], threshold, same, found.whole):
            found.add(i, j)
        nodes, counts, up = found.result()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts), pa.array(up, pa.int64())], names=["node", "links", "up"])

    places = F.broadcast(spark.createDataFrame([(g, base[g], parts[g]) for g in facts], "g long, base long, parts long"))
    grouped = dealt.df.join(places, "g").select("vec", "node", "copies", "g", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("part"))
    planted = grouped.repartition("part").sortWithinPartitions("part").mapInArrow(by_group(grouped.columns, "part", plant), "pair long, side long, blob binary")
    found = save(planted.repartition("pair").sortWithinPartitions("pair").mapInArrow(by_group(["pair", "side", "blob"], "pair", walk), "node long, links long, up long"), "links").df
    dealt.drop()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("up is not null").select(F.col("node").alias("a"), F.col("up").alias("b")), "vectors")
    least = joined.join(classes.select("node", "least"), "node")
    heads = least.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = least.join(heads, "component").select("node", "component_id")
    per_class = classes.join(links, "node", "left").join(reached, "node", "left").select("vec", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(per_class, "vec", "left")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
