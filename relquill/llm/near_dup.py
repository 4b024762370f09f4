"""Near-duplicate documents: SuperMinHash signatures, banding, full-set verification, union-find grouping.

Plan, and what each step moves:

1. One pass over the texts makes a slim row per document: set size, set fingerprint, band keys, sketch.
2. Equal sets collapse to their smallest id by a map-side combined aggregate, so thousands of copies
   count once from here on.
3. Every band bucket's smallest id is its pivot (an aggregate, no bucket is gathered). Members pair with
   pivots only; of its pairs a member first tries the most alike, and the others only where that leaves
   the two in different groups.
4. Likely pairs are confirmed on full shingle sets, made again from the texts of those documents alone. Members
   stream past their pivot's set, so a task holds one pivot and one batch, whatever the group's size.
5. Buckets that still hold two groups are compared in blocks of bounded bytes, pairs of blocks in separate tasks, on
   whole sets, which put out the links that join groups and no other pairs. So no link is lost to the pivots, and no
   bucket is ever in one task.
6. Links become groups by local union-find in each partition; what is left of them is merged in one task while it is
   few (a fixed number), else by star contraction between partitions.

Hot keys (bands, pivots, sets, hubs) are those with at least 1/20,000 of the rows: so at most 20,000, whatever the size of
the data, which is why their slim side may be broadcast, and their rows stay where they are.
Bands have as many rows as keep the chance to miss a pair at the threshold under 5 in a million (at 80 %: 24 bands of 4).

Edge cases: texts that are null or hold no word have no shingles and link with nothing; rows sharing an
id share a group; rows with a null id keep a null group and are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relquill.llm import _bytes
from relquill.llm._shared import BROADCAST_IDS, drop_stage, read_table, prepare, stage

SLOTS = 96
#: Signature likeness below which a pair cannot reach the threshold: six standard deviations under 0.8.
MARGIN = 6.0
#: Rows, and bytes of sets, that a side of a block comparison holds.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: A key is hot with this many rows at least, and with 1/HOT_KEYS of all rows at least: there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 1024, 20_000
#: The same floor for links, whose rows are 16 bytes.
HUB_ROWS = 1_000_000
#: Links, after the local union-find, that one task merges (16 bytes each); more are contracted between partitions.
LINKS_AT_ONCE = 200_000

_SIG = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.ShortType())),
    ]
)


def band_rows(percent: int) -> int:
    """Signature slots in a band: the most with which a pair at the threshold misses every band 5 times in a million at most."""
    s = percent / 100
    return next((r for r in (12, 8, 6, 4, 3, 2) if (1 - s**r) ** (SLOTS // r) <= 5e-6), 1)


def shingle_hashes(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (64-bit hash, text index), sorted by text and hash."""
    buf, start, end, owner = _bytes.words(parts, lower=True)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _bytes.span_hashes(buf, start, end)
    count = np.bincount(owner, minlength=len(parts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    with np.errstate(over="ignore"):
        acc = h.copy()
        for k in range(1, min(size, len(h))):
            acc[: len(h) - k] = _bytes.mix(acc[: len(h) - k] * np.uint64(0xD1342543DE82EF95) + h[k:])
    left = first[owner] + count[owner] - np.arange(len(h))  # words from here to the text's end
    whole = left >= size
    out, who = acc[whole], owner[whole]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for j, d in enumerate(few):  # the whole word sequence is the one shingle
                x = np.uint64(count[d])
                for w in h[first[d] : first[d] + count[d]]:
                    x = _bytes.mix(np.array([x * np.uint64(0xD1342543DE82EF95) + w], np.uint64))[0]
                extra[j] = x
        out, who = np.concatenate([out, extra]), np.concatenate([who, few])
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    cut = np.flatnonzero(np.diff(who)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(out)]]), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[new], who[new]


def superminhash(h: np.ndarray, who: np.ndarray, docs: int, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """SuperMinHash of each set: (ranks, element hashes at them), both docs x slots.

    Element e offers slot p_j the rank j + r_j, with p a random permutation that its own hash seeds
    (Fisher-Yates, one swap a round) and r_j in [0, 1). Round j can only better slots whose rank is above
    j, so a set stops as soon as its largest rank is at most j; large sets end after a round or two.
    """
    best = np.full(docs * slots, np.inf)
    at = np.zeros(docs * slots, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, docs, 64):  # bounds the permutations held
            a, b = np.searchsorted(who, [lo, lo + 64])
            e, d = h[a:b], who[a:b] - lo
            n_docs = min(64, docs - lo)
            view, seen = best[lo * slots : (lo + n_docs) * slots], at[lo * slots : (lo + n_docs) * slots]
            perm = np.empty((0, slots), np.uint8 if slots <= 256 else np.uint16)
            live = np.ones(n_docs, bool)
            for j in range(slots):
                if j:
                    top = view.reshape(n_docs, slots).max(axis=1)
                    live &= top > j
                keep = live[d]
                if not keep.all():
                    e, d = e[keep], d[keep]
                    perm = perm[keep] if j > 1 else perm
                if not len(e):
                    break
                if j == 1:  # round 0 needs the first pick alone
                    perm = np.broadcast_to(np.arange(slots, dtype=perm.dtype), (len(e), slots)).copy()
                    z = _bytes.mix(e + np.uint64(0x9E3779B97F4A7C15))
                    k = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                    perm[np.arange(len(e)), k] = 0
                    perm[:, 0] = k
                z = _bytes.mix(e + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
                r = (z >> np.uint64(32)).astype(np.float64) / 4294967296.0 + j
                k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
                if j == 0:
                    p = k
                else:
                    row = np.arange(len(e))
                    p = perm[row, k].astype(np.int64)
                    perm[row, k] = perm[:, j]
                    perm[:, j] = p
                cell = d * slots + p
                better = r < view[cell]
                if better.any():
                    cell, r, x = cell[better], r[better], e[better]
                    np.minimum.at(view, cell, r)
                    won = view[cell] == r
                    seen[cell[won]] = x[won]
    return best.reshape(docs, slots), at.reshape(docs, slots)


def signatures(texts: list, size: int, rows: int = 4) -> tuple[list, list, list, list]:
    n_out, fp_out, band_out, sketch_out = [], [], [], []
    for _, parts in _bytes.runs(texts):
        h, who = shingle_hashes(parts, size)
        n = np.bincount(who, minlength=len(parts)) if len(who) else np.zeros(len(parts), np.int64)
        _, at = superminhash(h, who, len(parts))
        with np.errstate(over="ignore"):
            band = np.zeros((len(parts), SLOTS // rows), np.uint64) + np.arange(SLOTS // rows, dtype=np.uint64)
            for k in range(rows):
                band = _bytes.mix(band * np.uint64(0xD1342543DE82EF95) + at[:, k::rows])
            sketch = (_bytes.mix(at) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            bound = np.searchsorted(who, np.arange(len(parts) + 1))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(_bytes.mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 0xABCDEF0123)]
            marks = [c[bound[1:]] - c[bound[:-1]] for c in sums]
        for i in range(len(parts)):
            n_out.append(int(n[i]))
            if n[i]:
                fp_out.append(f"{int(n[i]):x}-{int(marks[0][i]):016x}{int(marks[1][i]):016x}")
                band_out.append(band[i].view(np.int64))
                sketch_out.append(sketch[i])
            else:
                fp_out.append(None)
                band_out.append(None)
                sketch_out.append(None)
    return n_out, fp_out, band_out, sketch_out


def _signature_udf(size: int, rows: int):
    @F.pandas_udf(_SIG)
    def made(texts: pd.Series) -> pd.DataFrame:
        n, fp, band, sketch = signatures(texts.tolist(), size, rows)
        return pd.DataFrame({"n": pd.Series(n, dtype="int64"), "fp": fp, "bands": band, "sketch": sketch})

    return made


def _set_udf(size: int):
    """The sets as sorted 64-bit hashes, 8 bytes a shingle."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        out: list = []
        for _, parts in _bytes.runs(texts.tolist()):
            h, who = shingle_hashes(parts, size)
            bound = np.searchsorted(who, np.arange(len(parts) + 1))
            out += [h[bound[i] : bound[i + 1]].astype("<u8").tobytes() for i in range(len(parts))]
        return pd.Series(out)

    return made


def _hot_from(rows: int, floor: int = HOT_ROWS) -> int:
    """The number of rows from which on a key is hot in a table of ``rows``."""
    return max(floor, -(-rows // HOT_KEYS))


def _join_split(left: DataFrame, right: DataFrame, key: str, hot: str) -> DataFrame:
    """``left`` with the one row of ``right`` for its key. Rows of keys that are ``hot`` (a condition on ``right`` that
    holds for ``HOT_KEYS`` rows at most) are joined in place, by broadcast; the others by shuffle."""
    few = right.where(hot)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(f"NOT ({hot})"), key)
    return left.join(F.broadcast(few), key).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hub: int = HUB_ROWS, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(node, root) of every node in ``edges``, root the smallest node reachable.

    Each partition first reduces its links to a forest by union-find. Forests of ``at_once`` links or fewer are merged in the
    same way by one task, as plans and tasks of many steps would cost the driver more than the links. Else large-star and small-star steps,
    each an aggregate and a join on the node, run until a step changes nothing (a number of steps
    logarithmic in the longest chain). The driver sees one checksum a step. A node with ``hub`` links or more is joined in place.
    """

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while (p := parent.get(x, x)) != root:
                parent[x] = root
                x = p
            return root

        for frame in batches:
            for x, y in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                parent.setdefault(x, x), parent.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        items = [(x, find(x)) for x in list(parent)]
        items = [(x, r) for x, r in items if x != r]
        for i in range(0, len(items), 50_000):
            yield pd.DataFrame(items[i : i + 50_000], columns=["u", "v"]).astype("int64")

    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = stage(links.mapInPandas(forest, "u long, v long"), "links")
    mark, n = None, now.count()
    if n <= at_once:
        out = stage(now.coalesce(1).mapInPandas(forest, "u long, v long"), "links")
        drop_stage(now)
        return out.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def attached(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.join(low, "u") if n < hub else _join_split(rows, low, "u", f"c >= {_hot_from(2 * n, hub)}")

    for _ in range(rounds):
        # large star: every neighbour above the node goes to the smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = attached(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below the node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = attached(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        sums = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_stage(now)
        now, n = after, sums[0]
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError(f"links were not contracted after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _likely(pairs: DataFrame, reps: DataFrame, hubs: DataFrame, floor: float, percent: int) -> DataFrame:
    """Pairs whose sketches agree in at least ``floor`` of the slots and whose sizes allow a link; adds ``like``.

    ``hubs`` (b, salts) are the pivots of hot buckets.
    """
    slim = reps.select("rep", "n", "sketch")
    a = slim.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = slim.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")).join(F.broadcast(hubs), "b", "left")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    out = _join_split(pairs.join(a, "a"), b, "b", "salts IS NOT NULL").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return out.select("a", "b", (same / F.lit(float(SLOTS))).alias("like")).where(F.col("like") >= floor)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    shared = int((y[at] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, docs: DataFrame, hubs: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) that are linked by their full shingle sets.

    Sets are sent to their pivots' cells: rows of a cell arrive sorted, the pivot first, and stream past it. A pivot in
    ``hubs`` (b, salts) has several cells.
    """
    salted = pairs.select("a", "b").join(F.broadcast(hubs), "b", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    member = salted.select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("part"))
    pivot = salted.groupBy("b").agg(F.max("salts").alias("salts"))
    pivot = pivot.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"), F.lit(0).alias("part"))
    cells = stage(member.unionByName(pivot), "cells")
    sets = _sets_of(docs, cells, size)
    placed = sets.repartition("b", "salt").sortWithinPartitions("b", "salt", "part").select("id", "b", "salt", "part", "s")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, pivots = None, []
        for frame in batches:
            out = []
            for i, b, salt, part, s in zip(*(frame[c].tolist() for c in ("id", "b", "salt", "part", "s")), strict=True):
                if cell != (b, salt):
                    cell, pivots = (b, salt), []
                x = np.frombuffer(s, "<u8")
                if part == 0:  # rows that share an id may be more than one set
                    pivots.append(x)
                elif any(_linked(x, y, percent) for y in pivots):
                    out.append((i, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    out = stage(placed.mapInPandas(check, "a long, b long"), "linked")
    drop_stage(cells)
    return out


def _sets_of(docs: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """``cells`` (with an id) beside the shingle set ``s`` of the id's text."""
    small = cells.count() <= BROADCAST_IDS
    cells = F.broadcast(cells) if small else cells.hint("merge")
    ids = cells.select("id").distinct()
    texts = docs.join(F.broadcast(ids) if small else ids.hint("merge"), "id", "left_semi")
    return texts.select("id", _set_udf(size)("text").alias("s")).join(cells, "id")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by products of membership matrices over slices of the elements."""
    owner_l = np.repeat(np.arange(len(left)), [len(x) for x in left])
    owner_r = np.repeat(np.arange(len(right)), [len(x) for x in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)
    at_l, at_r = np.searchsorted(both, flat_l), np.searchsorted(both, flat_r)
    in_l = (at_l < len(both)) & (both[np.minimum(at_l, len(both) - 1)] == flat_l) if len(both) else np.zeros(len(flat_l), bool)
    in_r = (at_r < len(both)) & (both[np.minimum(at_r, len(both) - 1)] == flat_r) if len(both) else np.zeros(len(flat_r), bool)
    owner_l, at_l, owner_r, at_r = owner_l[in_l], at_l[in_l], owner_r[in_r], at_r[in_r]
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    owner_l, at_l, owner_r, at_r = owner_l[order_l], at_l[order_l], owner_r[order_r], at_r[order_r]
    for lo in range(0, len(both), 4096):
        hi = min(len(both), lo + 4096)
        a, b = np.searchsorted(at_l, [lo, hi])
        c, d = np.searchsorted(at_r, [lo, hi])
        x = np.zeros((len(left), hi - lo), np.float32)
        y = np.zeros((len(right), hi - lo), np.float32)
        x[owner_l[a:b], at_l[a:b] - lo] = 1
        y[owner_r[c:d], at_r[c:d] - lo] = 1
        out += x @ y.T
    return out


def links_between(frame: pd.DataFrame, floor: float, percent: int) -> list[tuple[int, int]]:
    """Links between groups among the rows of a bucket that meet in one task, as a forest over the groups.

    Rows with ``visits`` are compared with those without. A pair belongs to the first band that it shares, so that no
    other bucket repeats it.
    """
    visits = frame["visits"].to_numpy(bool)
    left, right = frame[visits], frame[~visits]
    if not len(left) or not len(right):
        return []
    sl, sr = np.stack(left["sketch"].to_list()), np.stack(right["sketch"].to_list())
    il, ir = left["rep"].to_numpy(), right["rep"].to_numpy()
    gl, gr = left["root"].to_numpy(), right["root"].to_numpy()
    nl, nr = left["n"].to_numpy(), right["n"].to_numpy()
    minor = right["minor"].to_numpy(bool)
    band = int(frame["band"].iloc[0])
    bl, br = (np.stack(x["bands"].to_list())[:, :band] for x in (left, right))
    may = np.zeros((len(left), len(right)), bool)
    for i in range(len(left)):
        ok = (gr != gl[i]) & (100 * np.minimum(nr, nl[i]) >= percent * np.maximum(nr, nl[i])) & (~minor | (ir < il[i]))
        if ok.any():
            good = (sr[ok] == sl[i]).mean(axis=1) >= floor
            if band:
                good &= ~(br[ok] == bl[i]).any(axis=1)
            ok[ok] = good
            may[i] = ok
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return []
    sets_l = [np.frombuffer(x, "<u8") for x in left["s"].to_numpy()[rows]]
    sets_r = [np.frombuffer(x, "<u8") for x in right["s"].to_numpy()[cols]]
    shared = _shared_counts(sets_l, sets_r)
    total = nl[rows][:, None] + nr[cols][None, :]
    linked = may[np.ix_(rows, cols)] & (100 * shared >= percent * (total - shared))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            x = p
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(gl[rows[i]])), find(int(gr[cols[j]]))
        if x != y:
            a, b = int(il[rows[i]]), int(ir[cols[j]])
            out.append((max(a, b), min(a, b)))
            parent[max(x, y)] = min(x, y)
    return out


def _across_blocks(reps: DataFrame, members: DataFrame, docs: DataFrame, floor: float, percent: int, size: int, most: int) -> DataFrame:
    """Links across groups inside the buckets of ``members`` (key, band, rep, root, n).

    A bucket's largest group needs no comparison within itself: its rows and the rest stay in blocks of
    the bucket, and only the rest visit all blocks, themselves in blocks; each pair of blocks is a task. Blocks are as
    many as keep a side to ``BLOCK`` rows and ``BLOCK_BYTES`` of sets. Buckets of ``most`` rows or more are hot.
    """
    groups = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"))
    main = groups.groupBy("key").agg(
        F.max_by(F.struct("root", "c", "size"), F.struct("c", (-F.col("root")).alias("r"))).alias("main"), F.sum("c").alias("k"), F.sum("size").alias("size")
    )

    def blocks(rows, size):
        return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK)), F.ceil(size * 8 / F.lit(BLOCK_BYTES))).cast("int")

    main = main.select(
        "key", "k", F.col("main.root").alias("main"), blocks(F.col("k"), F.col("size")).alias("homes"),
        blocks(F.col("k") - F.col("main.c"), F.col("size") - F.col("main.size")).alias("guests"),
    )
    rows = _join_split(members, main, "key", f"k >= {most}").withColumn("minor", F.col("root") != F.col("main"))
    home, guest = F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("guests")).cast("int")
    stay = rows.select("key", "band", "rep", "root", "minor", F.lit(False).alias("visits"), home.alias("h"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("g"))
    visit = rows.where("minor").select("key", "band", "rep", "root", "minor", F.lit(True).alias("visits"), F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("h"), guest.alias("g"))
    need = stage(members.select(F.col("rep").alias("id")).distinct(), "need")
    sets = _sets_of(docs, need, size).select(F.col("id").alias("rep"), "s")
    placed = stay.unionByName(visit).join(reps.select("rep", "n", "bands", "sketch").join(sets, "rep"), "rep")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_between(frame, floor, percent), columns=["a", "b"]).astype("int64")

    return placed.groupBy("key", "h", "g").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: the id, n_shingles, component_id, kept. Links need 100 * shared >= percent * union."""
    spark = docs.sparkSession
    prepare(spark)
    floor = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / SLOTS) ** 0.5
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = stage(slim.select("id", _signature_udf(size, band_rows(percent))("text").alias("s")).select("id", "s.*"), "signatures")
    usable = sig.where("id IS NOT NULL AND n > 0")
    grouped = usable.groupBy("fp").agg(F.min(F.struct("id", "n", "bands", "sketch")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = stage(grouped.select("fp", F.col("r.id").alias("rep"), "r.n", "r.bands", "r.sketch", "copies"), "reps")
    total = reps.agg(F.count(F.lit(1)), F.sum("copies"), F.sum(F.size("bands"))).first()
    most = _hot_from(total[2] or 0)

    bands = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = stage(bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1"), "buckets")
    members = stage(_join_split(bands, buckets, "key", f"k >= {most}"), "members")
    # a document is in one bucket a band, so a pivot of no hot bucket has few pairs
    hubs = stage(buckets.where(f"k >= {most}").groupBy(F.col("pivot").alias("b")).agg(F.ceil(F.max("k") / F.lit(most)).alias("salts")), "hubs")
    pairs = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = stage(_likely(pairs, reps, hubs, floor, percent), "likely")
    best = likely.groupBy("a").agg(F.min(F.struct((-F.col("like")).alias("u"), F.col("b").alias("b"))).alias("x")).select("a", F.col("x.b").alias("b"))
    shared_ids = usable.groupBy("id").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).where("f0 <> f1").select("id")
    links = _confirmed(best, slim, hubs, percent, size)
    own = _shared_id_links(usable, reps, shared_ids)
    groups = connected_components(links.unionByName(own))

    def rooted(frame: DataFrame, col: str, out: str) -> DataFrame:
        g = groups.select(F.col("node").alias(col), F.col("root").alias(out + "_r"))
        return frame.join(g, col, "left").withColumn(out, F.coalesce(F.col(out + "_r"), F.col(col))).drop(out + "_r")

    def merged(more: DataFrame) -> DataFrame:
        return connected_components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # the other pairs with pivots, where the best one left the two apart
    rest = rooted(rooted(likely.select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    rest = stage(rest.join(best, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        groups = merged(_confirmed(rest, slim, hubs, percent, size))
    # what buckets with several groups still hide
    marked = stage(rooted(members.where("k > 2").select("key", "band", "rep", "n"), "rep", "root"), "marked")
    mixed = marked.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("k")).where("r0 <> r1").select("key", "k")
    inside = stage(_join_split(marked, mixed, "key", f"k >= {most}").drop("k"), "inside")
    if not inside.isEmpty():
        hidden = stage(_across_blocks(reps, inside, slim, floor, percent, size, most), "hidden")
        if not hidden.isEmpty():
            groups = merged(hidden)

    by_set = rooted(reps.select("fp", "rep", "copies"), "rep", "component_id").select("fp", "component_id", "copies")
    found = _join_split(sig.where("fp IS NOT NULL AND id IS NOT NULL").select("id", "n", "fp"), by_set, "fp", f"copies >= {_hot_from(total[1] or 0)}")
    # rows without words meet nobody; the copies of a null id are in no group
    alone = sig.where("fp IS NULL").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    nameless = sig.where("fp IS NOT NULL AND id IS NULL").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    out = found.select("id", "n", "component_id").unionByName(alone).unionByName(nameless)
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _shared_id_links(usable: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id; none in a table whose ids are unique."""
    rows = usable.select("id", "fp").join(ids, "id", "left_semi").join(reps.select("fp", "rep"), "fp")
    low = rows.groupBy("id").agg(F.min("rep").alias("b"))
    return rows.join(low, "id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on 2-word shingles, as the query's contract sets them."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, 0.8), with all its columns.

    Of rows that share an id, which are a group, the one of the smallest hash stays. Rows with a null id stay. Texts are shuffled only
    where ids repeat or the list of kept ids is too long to be broadcast.
    """
    found = near_duplicates(docs)
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = stage(kept.select(F.col("doc_id").alias("kept_id"), "rows"), "kept")
    once = kept.where("rows = 1")
    once = F.broadcast(once) if kept.count() <= BROADCAST_IDS else once
    out = docs.join(once, docs["doc_id"].cast("long") == once["kept_id"], "left_semi")
    again = kept.where("rows > 1")
    if not again.isEmpty():
        twins = docs.join(again, docs["doc_id"].cast("long") == again["kept_id"], "left_semi")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = twins.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("one"))
        out = out.unionByName(one.select("one.*"))
    return out.unionByName(docs.where("doc_id IS NULL"))
