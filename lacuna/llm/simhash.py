"""SimHash near-duplicates over vantage-point trees.

Each text gets a fingerprint of 64 bits a word (word k: XXH64 of its shingles with seed 42 + k; a bit is 1 if set in
over half of the hashes). The query counts a shingle as often as it occurs, the filter once a text. Distinct fingerprints
are searched for pairs within max_bits in vantage-point shards: for max_bits of 3 the 64 bits are halved, since two
fingerprints that differ in at most 3 bits differ in at most 1 in one of the halves, and each half has its own tree with
radius 1, where triangle bounds prune well; wider radii search one tree over all bits. A shard of more than CELL
fingerprints is cut into cells, CELL members against CELL visitors, so no task grows with a shard. A cell joins its pairs
in memory and gives out a star for each local component, never all pairs; distributed star rounds then connect the cells.
Trees are fitted to a bounded sample of the distinct fingerprints; all fingerprints are routed.

The filter's radius (26 of 128 bits) is so wide that trees prune nothing, so its shards come from the shingle sets instead:
sets meet in the shards of their rarest shingles, where their fingerprints are compared. Two sets of the wanted similarity
always have one of these shingles in common (prefix_sizes), so no pair is left out, whatever order they are taken in; unlike
texts seldom share a rare one, so the search grows with the texts and their near copies, not with all pairs.

Cases: null and blank texts have fingerprint 0, linked like any other; fewer words than a shingle: the whole sequence is
one; repeated rows link; null ids are no candidates for component_id (a component of null ids only has a null one);
an empty table gives an empty result; other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, fresh, materialize
from lacuna.llm.components import connected_components
from lacuna.llm.vptree import Links, VPTree, distances, link_leaf

SEED = 42
#: Distinct fingerprints aimed at in a leaf; levels of a tree, at most (leaves beyond are larger and cut into cells); distinct fingerprints
#: that a tree is fitted to: so many for each leaf, and so many at least.
LEAF_AIM, MAX_DEPTH, LEAF_SAMPLE, LEAST_SAMPLE = 4_000, 14, 16, 20_000
#: Members and visitors of a cell, about.
CELL = 4_096
#: Common shingles that are told apart from the others, at most; the part of the texts (one in so many) that they are counted in, and how often.
MOST_COMMON, COUNTED, OFTEN = 16_384, 16, 8
#: Bands of a sketch (band_keys; the filter's shards no longer depend on them), and the share of pairs just at the wanted similarity that may have none in common, at most.
BANDS, MISSED = 20, 1e-4
#: Rows of a shard up to which its pairs are taken together with those of other shards.
LITTLE = 64
_CHUNK, _SKETCHED = 50_000, 2_048


def shingle_bounds(text: str | None, words: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words joined by spaces, and where each shingle starts and stops in it; a short text is one shingle."""
    parts = (text or "").encode().lower().split()  # ASCII only, as bytes
    if not parts:
        return b"", [], []
    width = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - width + 1].tolist()
    return b" ".join(parts), starts, (ends[width - 1 :] - 1).tolist()


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> tuple[list[int], int]:
    """(one unsigned 64-bit integer a lane, number of shingles)."""
    joined, starts, stops = shingle_bounds(text, words)
    if not starts:
        return [0] * lanes, 0
    out = []
    for lane in range(lanes):
        digest, seed, counts = xxhash.xxh64_intdigest, SEED + lane, np.zeros(64, np.int64)
        for at in range(0, len(starts), _CHUNK):
            hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0]))
    return out, len(starts)


def shingle_hashes(joined: bytes, starts: list[int], stops: list[int], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def band_rows(similarity: float) -> int:
    """Least hashes that make a band: sets of similarity s have one equal band with chance 1 - (1 - s**rows)**BANDS."""
    return max(1, min(16, math.floor(math.log(1 - MISSED ** (1 / BANDS)) / math.log(min(similarity, 0.99)))))


@cache
def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What hashes are xored with and multiplied by for each of n orders of them."""
    flip, factor = np.random.default_rng(SEED).integers(0, 1 << 64, (2, n), np.uint64)
    return flip, factor | np.uint64(1)


def band_keys(found: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of a set of hashes."""
    flip, factor = _orders(BANDS * rows)
    least = np.full(BANDS * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _SKETCHED):
        np.minimum(least, ((found[at : at + _SKETCHED, None] ^ flip) * factor).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, rows))], np.uint64)


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """(as the smaller of a pair, as any): so many of a set's n shingles, the first in an order that all sets share, meet each set so similar.

    Of sets a and b, a not larger, the overlap o is at least 2s / (1 + s) of a and s of b. The first |a| - o + 1 and |b| - o + 1
    shingles have one in common: else the set whose such part ends first would have all o common ones in its last o - 1.
    """
    least = lambda share: math.ceil(share * n - 1e-9 * n)
    return (n - least(2 * similarity / (1 + similarity)) + 1, n - least(similarity) + 1) if n else (0, 0)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; rank of each by rising frequency, from 1) of common shingles, counted in a part of the texts. They only order shingles: those that aren't seen cost time, no pair."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text")
    counted = shingle_sets(part, words).select(F.explode("shingle_set").alias("shingle")).groupBy("shingle").count()
    found = counted.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toPandas()
    hashes = found["shingle"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(hashes)
    return hashes[at], (len(found) - np.arange(len(found)))[at]


def rarest(found: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n of sorted hashes: those that aren't common by their value, then the common ones by frequency."""
    hashes, ranks = common
    if not len(hashes) or not len(found):
        return found[:n]
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return found[np.argsort(np.where(hashes[at] == found, ranks[at], 0), kind="stable")[:n]]


def set_fingerprint(text: str | None, words: int = 5, lanes: int = 2) -> tuple[list[int], int, int]:
    """(one unsigned 64-bit integer a lane, number of distinct shingles, hash of their set); repeats count for nothing."""
    return _hashed_set(text, words, lanes)[:3]


def _hashed_set(text: str | None, words: int, lanes: int) -> tuple[list[int], int, int, np.ndarray]:
    joined, starts, stops = shingle_bounds(text, words)
    found, first = np.unique(shingle_hashes(joined, starts, stops, SEED), return_index=True)
    if not len(found):
        return [0] * lanes, 0, 0, found
    starts, stops = ([bounds[i] for i in first.tolist()] for bounds in (starts, stops))
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(starts), _CHUNK):
            hashes = shingle_hashes(joined, starts[at : at + _CHUNK], stops[at : at + _CHUNK], SEED + lane) if lane else found[at : at + _CHUNK]
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0]))
    return out, len(starts), xxhash.xxh64_intdigest(found.tobytes(), SEED), found


def set_fingerprints(docs: DataFrame, words: int, lanes: int, keep: tuple[str, ...], similarity: float) -> DataFrame:
    """The kept columns with f0 .. and shingles as set_fingerprint has them, fid: the hash of the shingle set, rare: the shingles that meet all sets so similar, homes: so many first ones meet the larger."""
    names = [f"f{k}" for k in range(lanes)]
    kept, common = [docs.schema[c] for c in keep], common_shingles(docs, words)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, sizes, homes, rare = [], [], [], []
            for text in batch.column("text").to_pylist():
                prints, n, fid, found = _hashed_set(text, words, lanes)
                own, most = prefix_sizes(n, similarity)
                bits.append([*prints, fid]), sizes.append(n), homes.append(own), rare.append(rarest(found, most, common).view(np.int64))
            bits = np.array(bits, np.uint64).reshape(-1, lanes + 1).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(bits[:, k]) for k in range(lanes + 1)), pa.array(sizes, pa.int64()), pa.array(homes, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], [*keep, *names, "fid", "shingles", "homes", "rare"])

        return step

    return arrow_map(docs.select(*keep, "text"), make, ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in kept), *(f"{n} long" for n in names), "fid long, shingles long, homes long, rare array<long>"]))


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with f0 .. (signed 64-bit integers of the lanes) and shingles."""
    names = [f"f{k}" for k in range(lanes)]
    kept = [docs.schema[c] for c in keep]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(t, words, lanes) for t in batch.column(text_col).to_pylist()]
            bits = np.array([f for f, _ in found], np.uint64).reshape(-1, lanes).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(bits[:, k]) for k in range(lanes)), pa.array([n for _, n in found], pa.int64())], [*keep, *names, "shingles"])

        return step

    return arrow_map(docs.select(*keep, text_col), make, ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in kept), *(f"{n} long" for n in names), "shingles long"]))


def _trees(lanes: int, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """(mask, radius within the mask) of each tree that together miss no pair."""
    if lanes == 1 and max_bits < 4:
        halves = np.array([[0xFFFFFFFF], [0xFFFFFFFF00000000]], np.uint64)
        return [(h, max_bits // 2) for h in halves]
    return [(np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64), max_bits)]


def link_fingerprints(distinct: DataFrame, n: int, lanes: int, max_bits: int) -> DataFrame:
    """u, v: edges (ids of distinct fingerprints) whose components are those of all pairs within max_bits.

    distinct: fid, f0 .., shingles; n: its rows.
    """
    names = [f"f{k}" for k in range(lanes)]
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / LEAF_AIM))))
    if max_bits > 3:
        depth = min(depth, 3)  # wide balls overlap most shards; deeper trees would only copy the queries
    size = max(LEAST_SAMPLE, LEAF_SAMPLE << depth)
    sample = distinct.orderBy(F.xxhash64(*names)).select(*names).limit(size).toPandas().to_numpy(np.int64).reshape(-1, lanes).view(np.uint64)
    trees = [(mask, radius, VPTree(np.unique(sample & mask, axis=0), depth)) for mask, radius in _trees(lanes, max_bits)]

    def route():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            points = np.stack([np.asarray(batch.column(c)) for c in names], 1).astype(np.int64).view(np.uint64)
            fid, sizes = np.asarray(batch.column("fid")), np.asarray(batch.column("shingles"))
            rows, shards, homes = [], [], []
            for t, (mask, radius, tree) in enumerate(trees):
                row, leaf, home = tree.route(points & mask, radius)
                rows.append(row), shards.append(leaf * len(trees) + t), homes.append(home)
            row = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards).astype(np.int64)), pa.array(np.concatenate(homes)), pa.array(fid[row]), pa.array(sizes[row]), *(pa.array(points[row, k].view(np.int64)) for k in range(lanes))], ["shard", "home", "fid", "shingles", *names])

        return step

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        mask, radius, _ = trees[int(key[0]) % len(trees)]
        points = np.ascontiguousarray(group[names].to_numpy(np.int64)).view(np.uint64)
        fid, member, visitor = group["fid"].to_numpy(), group["member"].to_numpy(bool), group["visitor"].to_numpy(bool)
        links, at = Links(len(group)), np.arange(len(group))
        link_leaf(points[member], points[visitor], (radius, max_bits), links, at[member], at[visitor], mask)
        roots = links.roots()
        far = roots != at
        return pd.DataFrame({"u": fid[far], "v": fid[roots[far]]})

    schema = ", ".join(["shard long, home boolean, fid long, shingles long", *(f"{c} long" for c in names)])
    visits = materialize(arrow_map(distinct.select("fid", "shingles", *names), route, schema), "visits")
    # Comparing costs much more than the rows' bytes tell, so the number of tasks follows the rows, not their bytes.
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (CELL // 2))
    return in_cells(visits).repartition(tasks, "shard", "cell").groupBy("shard", "cell").applyInPandas(link, "u long, v long")


def link_sketched(distinct: DataFrame, n: int, lanes: int, max_bits: int, size_ratio: float) -> DataFrame:
    """u, v: as link_fingerprints, of the pairs that meet by a rare shingle, differ in max_bits at most and whose counts differ by no more than the factor.

    distinct: fid, f0 .., shingles, homes, rare; n: its rows.
    """
    names = [f"f{k}" for k in range(lanes)]

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["shard", "cell"])
        points = np.ascontiguousarray(group[names].to_numpy(np.int64)).view(np.uint64)
        fid, member, visitor, sizes = group["fid"].to_numpy(), group["member"].to_numpy(bool), group["visitor"].to_numpy(bool), group["shingles"].to_numpy()
        alike = lambda a, b: np.minimum(sizes[a], sizes[b]) >= size_ratio * np.maximum(sizes[a], sizes[b])
        run = group.groupby(["shard", "cell"], sort=False).ngroup().to_numpy()
        starts, length = np.flatnonzero(np.diff(run, prepend=-1)), np.bincount(run)
        links, at, little = Links(len(group)), np.arange(len(group)), length[run] <= LITTLE
        for step in range(1, length[length <= LITTLE].max(initial=1)):
            a, b = at[:-step], at[step:]
            ok = (run[a] == run[b]) & little[a] & (member[a] & visitor[b] | member[b] & visitor[a])
            a, b = a[ok], b[ok]
            ok = (distances(points[a], points[b]) <= max_bits) & alike(a, b)
            links.join(a[ok], b[ok])
        for k in np.flatnonzero(length > LITTLE):
            own = at[starts[k] : starts[k] + length[k]]
            here, come = own[member[own]], own[visitor[own]]
            link_leaf(points[here], points[come], (max_bits, max_bits), links, here, come, np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64), alike)
        roots = links.roots()
        far = roots != at
        return pd.DataFrame({"u": fid[far], "v": fid[roots[far]]})

    # Tasks follow the rows; the small shards are dealt out to them in lots, as there are many more than tasks.
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (CELL // 2))
    met = in_cells(sketched(distinct, lanes), alone=False).join(distinct.select("fid", "shingles", *names), "fid")
    return met.withColumn("lot", F.pmod(F.xxhash64("shard", "cell"), F.lit(tasks))).repartition(tasks, "lot").groupBy("lot").applyInPandas(link, "u long, v long")


def sketched(distinct: DataFrame, lanes: int) -> DataFrame:
    """shard, home, fid: the visits of sets to the shards of their rarest shingles, at home where they may be the smaller of a pair."""
    visits = distinct.select("fid", "homes", F.posexplode("rare").alias("at", "shard"))
    return visits.select("shard", (F.col("at") < F.col("homes")).alias("home"), "fid")


def in_cells(visits: DataFrame, alone: bool = True) -> DataFrame:
    """visits (shard, home, fid ..) with cell, member and visitor for home: each home row meets each row of its shard in one cell.

    alone: whether shards of a single row, or without a home row, are kept.

    A shard of up to CELL home rows and CELL rows is one cell. Others are a grid: a home row is a member of a row of cells,
    and any row a visitor of a column, both by a hash of fid. Only shards, counted with partial sums, are joined.
    """
    parts = lambda n: F.ceil(n / CELL).cast("int")
    sizes = visits.groupBy("shard").agg(parts(F.count_if("home")).alias("down"), parts(F.count("*")).alias("across"), F.count("*").alias("rows")).where("across > 1" if alone else "rows > 1 and down > 0").drop("rows")
    row, column = F.pmod(F.xxhash64("fid"), "down").cast("int"), F.pmod(F.xxhash64("fid", F.lit(1)), "across").cast("int")
    cell = lambda at, member, visitor: F.struct(at.alias("cell"), member.alias("member"), visitor.alias("visitor"))
    counted = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.when(F.col("home"), F.transform(counted(F.col("across")), lambda j: cell(row * F.col("across") + j, F.lit(True), F.lit(False))))
    as_visitor = F.when(F.col("down") > 0, F.transform(counted(F.col("down")), lambda i: cell(i * F.col("across") + column, F.lit(False), F.lit(True))))
    none = F.array().cast("array<struct<cell:int,member:boolean,visitor:boolean>>")
    cells = F.when(F.coalesce("across", F.lit(1)) == 1, F.array(cell(F.lit(0), F.col("home"), F.lit(True)))).otherwise(F.concat(F.coalesce(as_member, none), F.coalesce(as_visitor, none)))
    spread = visits.join(sizes, "shard", "left" if alone else "inner").withColumn("x", F.explode(cells))
    return spread.select("x.*", *(c for c in visits.columns if c != "home"))


def simhash_components(prints: DataFrame, lanes: int, max_bits: int, size_ratio: float | None = None) -> DataFrame:
    """fid, root for the distinct fid of prints (materialized; fid, f0 .., shingles) that have a partner.

    fid: the fingerprint itself, or a hash of the shingle set that it was made from. With size_ratio prints have homes and rare
    too, by which all sets of that similarity meet; others are partners only where they meet.
    """
    firsts = [f"f{k}" for k in range(lanes)] + (["homes", "rare"] if size_ratio else [])
    distinct = prints.select("fid", *firsts, "shingles").groupBy("fid").agg(*(F.first(c).alias(c) for c in firsts), F.min("shingles").alias("shingles"))
    distinct = materialize(distinct, "prints")
    edges = link_sketched(distinct, distinct.count(), lanes, max_bits, size_ratio) if size_ratio else link_fingerprints(distinct, distinct.count(), lanes, max_bits)
    return connected_components(edges).withColumnRenamed("node", "fid")


def simhash_query(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the least doc_id reachable)."""
    prints = materialize(fingerprints(docs, words).drop("shingles").withColumn("shingles", F.lit(0).cast("long")), "docprints")
    roots = simhash_components(prints.withColumn("fid", F.col("f0")), 1, max_bits)
    least = prints.groupBy(F.col("f0").alias("fid")).agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fid", "left").withColumn("root", F.coalesce("root", "fid"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(of_root, "root").select(F.col("fid").alias("f0"), "component_id")
    return prints.join(labels, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def centres(groups: DataFrame, lanes: int) -> DataFrame:
    """root, centre: the member of each candidate component that differs least from the majority of its members, bit by bit."""
    bit = lambda k, j: F.sum(F.shiftright(f"f{k}", j).bitwiseAND(F.lit(1)))
    votes = groups.groupBy("root").agg(F.count("*").alias("n"), *(bit(k, j).alias(f"v{k}_{j}") for k in range(lanes) for j in range(64)))
    lane = lambda k: sum((F.when(2 * F.col(f"v{k}_{j}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0)) for j in range(64)), F.lit(0).cast("long"))
    major = materialize(votes.select("root", *(lane(k).alias(f"m{k}") for k in range(lanes))), "majorities")
    off = sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"m{k}"))) for k in range(lanes)), F.lit(0))
    return groups.join(major, "root").groupBy("root").agg(F.min_by("fid", F.struct(off, "fid")).alias("centre"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """The columns of texts but text, and the distinct shingles of it, as hashes."""
    kept = [f for f in texts.schema if f.name != "text"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = []
            for text in batch.column("text").to_pylist():
                joined, starts, stops = shingle_bounds(text, words)
                sets.append(np.unique(shingle_hashes(joined, starts, stops, SEED)).view(np.int64))
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sets, pa.list_(pa.int64()))], [*(f.name for f in kept), "shingle_set"])

        return step

    return arrow_map(texts, make, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "shingle_set array<long>"]))


def _similar(a: str, b: str, least: float):
    """Whether the Jaccard similarity of two set columns is at least so much."""
    both = F.size(F.array_intersect(a, b))
    return both >= least * (F.size(a) + F.size(b) - both)


def verified_components(members: DataFrame, lanes: int, max_bits: int, similarity: float) -> DataFrame:
    """fid, root: the components of the candidate pairs whose sets have at least this similarity.

    members: fid, root (of its candidate component), centre, f0 .., shingles, shingle_set. Each member is compared with the
    centre c of its component first, so copies of one text cost one comparison each. A pair a, b with a member unlike the
    centre is compared in two cases, which between them lose no pair: the two share a shingle that c lacks; or they don't,
    and then their sets have at most min(|a & c|, |b & c|) shingles in common, which must suffice for the similarity.
    """
    names = [f"f{k}" for k in range(lanes)]
    centre = members.where("fid = centre").select("root", F.col("shingle_set").alias("centre_set"))
    shared = F.size(F.array_intersect("shingle_set", "centre_set"))
    met = members.join(centre, "root").select("fid", "root", "centre", *names, "shingles", F.size("shingle_set").alias("size"), shared.alias("of_centre"), F.array_except("shingle_set", "centre_set").alias("own"), (F.size("centre_set") - shared).alias("lacks"))
    small = materialize(met.withColumn("near", F.col("of_centre") >= similarity * (F.col("size") + F.col("lacks"))), "members")

    def between(x: DataFrame, y: DataFrame, keys: list[str], more=None) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        bits = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in names), F.lit(0))
        meet = (F.least("a.shingles", "b.shingles") >= similarity * F.greatest("a.shingles", "b.shingles")) & (bits <= max_bits) & (F.col("b.near") | (F.col("a.fid") < F.col("b.fid")))
        for key in keys:
            meet = meet & (F.col(f"a.{key}") == F.col(f"b.{key}"))
        return a.join(b, meet if more is None else meet & more).select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("other"), F.when(F.col("b.near"), F.col("b.centre")).otherwise(F.col("b.fid")).alias("v"))

    rest = small.where("fid <> centre")
    thin = rest.drop("own").where(F.col("of_centre") >= similarity * F.col("size"))
    common = F.least("a.of_centre", "b.of_centre")
    within = between(thin.where("not near"), thin, ["root"], common >= similarity * (F.col("a.size") + F.col("b.size") - common))
    spread = rest.withColumn("shingle", F.explode("own")).drop("own")
    outside = between(spread.where("not near"), spread, ["root", "shingle"])
    pairs = materialize(within.union(outside).distinct(), "pairs")
    sets = members.select("fid", "shingle_set")
    others = sets.select(F.col("fid").alias("other"), F.col("shingle_set").alias("other_set"))
    edges = pairs.join(sets, "fid").join(others, "other").where(_similar("shingle_set", "other_set", similarity)).select(F.col("fid").alias("u"), "v")
    joined = connected_components(edges)
    first = small.select("fid", F.when(F.col("near"), F.col("centre")).otherwise(F.col("fid")).alias("node"))
    return first.join(joined.withColumnRenamed("root", "top"), "node", "left").select("fid", F.coalesce("top", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 2, max_bits: int = 26, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the least id stays (null ids last, then by a hash of the row).

    Fingerprints propose pairs, the shingle sets decide: texts link if the Jaccard similarity of their five-word shingles
    is 0.8 or more. Fingerprints and counts are of distinct shingles too, so the ratio of counts bounds the similarity.
    Such sets have vectors at cosine 8/9 or more, and so differ in 128 * acos(8/9) / pi = 19.4 bits expected at most
    (deviation 4); 26 bits miss about one in twenty of those that stand at 0.8 itself, and fewer above; unrelated texts
    differ in 64 (deviation 5.7). Only fingerprints whose sets share one of their rarest shingles are compared, as all sets of
    0.8 do, so that search misses none. Only texts with one shingle set (by its 64-bit hash) are alike without a check.
    """
    row = fresh(docs, "lacuna_row")
    named = F.concat_ws(":", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).cast("string"), F.col(id_col).cast("string"))
    marked = docs.withColumn(row, named)  # one key without nulls, so that joins and windows on it share one shuffle
    source = marked.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    prints = materialize(set_fingerprints(source, words, lanes, ("doc_id", "row"), similarity), "docprints")
    roots = simhash_components(prints, lanes, max_bits, similarity)
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    best = materialize(prints.groupBy("fid").agg(F.min(rank).alias("rank"), *(F.first(f"f{k}").alias(f"f{k}") for k in range(lanes)), F.first("shingles").alias("shingles")), "best")
    groups = materialize(best.join(roots, "fid"), "groups")
    chosen = groups.join(centres(groups, lanes), "root").select("fid", "root", "centre", *(f"f{k}" for k in range(lanes)), "shingles", F.col("rank.row").alias("row"))
    texts = source.select("row", "text").join(chosen, "row").dropDuplicates(["row"]).drop("row")
    roots = verified_components(materialize(shingle_sets(texts, words), "sets"), lanes, max_bits, similarity)
    stay = best.join(roots, "fid", "left").groupBy(F.coalesce("root", "fid").alias("root")).agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    first = Window.partitionBy(row).orderBy(F.lit(0))  # identical rows only
    turn = fresh(marked, "lacuna_turn")
    return marked.join(stay, row, "semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).select(*(f"`{c}`" for c in docs.columns))
