"""Near-duplicate documents: MinHash candidates, links confirmed on full shingle sets, connected components.

1. Texts with the same words in the same order form one class; all later work is on classes.
2. A class gets a one-permutation MinHash of BINS bins. An empty bin takes the value of the full bin that comes first in
   its own fixed random order (optimal densification). BANDS bands of ROWS bins are hashed to bucket keys. At a
   similarity of 0.75 a pair misses all buckets with odds of 4 in a million.
3. A bucket of more than SMALL members is searched by ROUNDS stars: a centre is paired with members of other components, and a
   member meets one centre a round, so a round has as many pairs as members at most. Components are updated after each round; a
   bucket with one component left is done. That settles groups of copies of any size. In a smaller bucket, all pairs of components that are still apart in the
   last round are confirmed on full sets.
4. What is still open holds texts that share much without being similar, or groups that no star links. It is compared in full:
   classes that open buckets connect are dealt to tiles, and a task counts the shared shingles of all pairs of two tiles that
   have a bucket in common. So every pair that shares a bucket is tested, or lies in one component already. A task returns a
   forest over the components that its pairs join, so a group where all are linked gives a row a component, not a row a pair.

Nothing but counters reaches the driver. Each round ends in written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import LOWER, UPPER, Scratch, packed, unpacked

SHINGLE = 5
SIMILAR_PERCENT = 75
BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
ROUNDS = 2
#: Members of a bucket up to which all pairs are tested at once: at most SMALL / 2 pairs a member.
SMALL = 16
#: Members and shingles of a tile, about, in the full comparison of groups.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Pairs of a shingle up to which they are counted one by one; beyond, by a product of matrices.
FEW_PAIRS = 4096
#: Word hashes kept by a Python worker; the store starts anew when full.
KEEP_WORDS = 300_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
#: The order in which an empty bin looks at the others.
_ORDER = np.argsort(_RANDOM.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)
_SALT = _RANDOM.integers(1, 2**63, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) | _U(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(ws: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle of all."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    k = min(SHINGLE, len(ws))
    x = np.full(len(ws) - k + 1, k, np.uint64)
    for i in range(k):
        x = x * _FACTOR + h[i : len(ws) - k + 1 + i]
    return np.unique(_mixed(x))


def band_keys(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a set of shingle hashes."""
    low = _U(32)
    placed = np.sort((((s >> low) % _U(BINS)) << low) | (s & _U(0xFFFFFFFF)))
    bins = (placed >> low).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    full, values = bins[first], np.zeros(BINS, np.uint64)
    values[full] = placed[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        values[empty] = values[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    with np.errstate(over="ignore"):
        return _mixed((_mixed(values).reshape(BANDS, ROWS) * _SALT).sum(axis=1, dtype=np.uint64))


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.empty(0, np.uint64), *rows])))


def _fingerprints(with_sets: bool):
    """Batches of (k..., text) to (k..., hi, lo, n_shingles, bands or set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids, n, rows = [], [], []
            for t in batch.column(batch.num_columns - 1):
                ws = (t.as_py() or "").encode().translate(_LOWER).split()
                ids.append(xxhash.xxh3_128_intdigest(b" ".join(ws)))
                s = shingles(ws, hashes)
                n.append(len(s))
                rows.append(s if with_sets else band_keys(s) if len(s) else s)
            halves = [_longs(np.array([x >> 64 * i & (2**64 - 1) for x in ids], np.uint64)) for i in (1, 0)]
            columns = dict(zip(batch.schema.names[:-1], batch.columns[:-1], strict=True))
            yield pa.RecordBatch.from_pydict(
                columns | {"hi": halves[0], "lo": halves[1], "n_shingles": pa.array(n, pa.int64()), "hashes": _lists(rows)}
            )

    return run


def _components(scratch: Scratch, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) for all linked nodes: the old labels joined along the new links (a, b). Smallest label wins."""
    ends = links
    if labels is not None:
        for side in ("a", "b"):
            ends = ends.join(
                labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left"
            ).withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    ends = ends.where("a <> b").distinct()
    edges = scratch.save(ends.select("a", "b").union(ends.select("b", "a")).distinct(), "edges")
    now = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        # Smallest label among the neighbours, then the label of that label.
        near = edges.join(
            now.select(F.col("node").alias("b"), "label"), "b"
        ).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = scratch.save(step, "labels")
        old, now = now, step.drop("was")
        now.scratch_path = step.scratch_path
        scratch.drop(old)
        if step.where("was <> label").isEmpty():
            break
    scratch.drop(edges)
    if labels is None:
        return now
    renamed = now.select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = labels.join(renamed, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    joined = scratch.save(moved.union(now.join(labels, "node", "left_anti").select("node", "label")), "labels")
    scratch.drop(now)
    scratch.drop(labels)
    return joined


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = {side: sets.select(F.col("node").alias(side), F.col("hashes").alias(f"s{side}")) for side in ("a", "b")}
    both = pairs.select("a", "b").join(of["b"], "b").join(of["a"], "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _pairs(stars: DataFrame, percent: int, meshes: bool) -> DataFrame:
    """Candidate pairs (a, b) of this round whose sizes allow the similarity; on demand with all pairs of small buckets.

    A member meets one centre a round, that of its largest bucket, however many buckets it shares with a group.
    """
    fit = F.lit(100) * F.least("size", "other_size") >= F.lit(percent) * F.greatest("size", "other_size")
    large = stars.where((F.col("n") > SMALL) & (F.col("comp") != F.col("centre_comp")))
    large = large.select("node", "size", "n", "key", F.col("centre").alias("other"), F.col("centre_size").alias("other_size")).where(fit)
    star = large.groupBy("node").agg(F.max(F.struct("n", "key", "other")).alias("m")).select("node", F.col("m.other").alias("other"))
    pairs = star
    if meshes:
        small = stars.where(F.col("n") <= SMALL).select("key", "node", "size", "comp")
        other = small.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("comp").alias("other_comp"))
        pairs = pairs.union(small.join(other, "key").where("node < other and comp <> other_comp").where(fit).select("node", "other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _search(scratch: Scratch, buckets: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """ROUNDS rounds over buckets (key, node, size): (buckets that stay open, labels)."""
    labels = None
    for turn in range(ROUNDS):
        members = buckets.withColumn("comp", F.col("node")) if labels is None else buckets.join(labels, "node", "left").select(
            "key", "node", "size", F.coalesce("label", "node").alias("comp")
        )
        # A component sends the same centre to all its buckets, so that a text meets it in one pair, however many they share.
        draw = F.xxhash64("node", F.lit(turn))
        parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min(F.struct(draw.alias("draw"), "node", "size")).alias("m"))
        # A member of the largest component, which most others belong to.
        centres = parts.groupBy("key").agg(
            F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "m.draw", "comp", "m.node", "m.size")).alias("c")
        ).where("parts > 1")
        centres = scratch.save(
            centres.select(
                "key", "n", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.comp").alias("centre_comp")
            ),
            "centres",
        )
        stars = scratch.save(members.join(centres, "key"), "stars")
        pairs = scratch.save(_pairs(stars, percent, turn == ROUNDS - 1), "pairs")
        links = scratch.save(_similar(pairs, sets, percent), "links")
        scratch.drop(pairs)
        buckets = stars.where(F.col("n") > SMALL).select("key", "node", "size") if turn == ROUNDS - 1 else stars.select("key", "node", "size")
        if not links.isEmpty():
            labels = _components(scratch, labels, links)
    return buckets, labels


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of shared values of each set of ``a`` with each one of ``b``."""
    total = np.zeros(len(a) * len(b), np.int64)
    (va, ra), (vb, rb) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b))
    both = np.intersect1d(va, vb)
    columns = []
    for v, r in ((va, ra), (vb, rb)):
        at = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        keep = both[at] == v if len(both) else np.zeros(len(v), bool)
        order = np.argsort(at[keep], kind="stable")
        columns.append((at[keep][order], r[keep][order]))
    (ca, ra), (cb, rb) = columns
    few = np.bincount(ca, minlength=len(both)) * np.bincount(cb, minlength=len(both)) <= FEW_PAIRS
    # Shingles of many pairs: slices of a product of 0-1 matrices, whose sums stay exact in float32.
    many = np.flatnonzero(~few)
    for start in range(0, len(many), TILE):
        part = many[start : start + TILE]
        m = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            at = np.minimum(np.searchsorted(part, c), len(part) - 1)
            hit = part[at] == c
            x = np.zeros((n, len(part)), np.float32)
            x[r[hit], at[hit]] = 1.0
            m.append(x)
        total += (m[0] @ m[1].T).astype(np.int64).ravel()
    # The others: each row of a with the rows of b that have the shingle.
    ra, ca, rb, cb = ra[few[ca]], ca[few[ca]], rb[few[cb]], cb[few[cb]]
    first, last = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    step = 1 << 11
    for start in range(0, len(ca), step):
        f, n, r = first[start : start + step], (last - first)[start : start + step], ra[start : start + step]
        at = np.arange(n.sum()) + np.repeat(f - np.cumsum(n) + n, n)
        np.add.at(total, np.repeat(r, n) * len(b) + rb[at], 1)
    return total.reshape(len(a), len(b))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the links (a, b) join: those of each end to the smallest one it reaches."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for side in (x, y):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
    other = label != np.arange(len(ends))
    return ends[label[other]], ends[other]


def _compare_tiles(percent: int):
    """All rows of two tiles, or of one, to links (a, b) that join the different components of all similar pairs."""

    def run(table: pa.Table) -> pa.Table:
        comp, right = (table[c].to_numpy() for c in ("comp", "right"))
        sets = [np.asarray(h.values) for h in table["hashes"]]
        one = right.all() or not right.any()
        i = np.arange(len(comp)) if one else np.flatnonzero(~right)
        j = i if one else np.flatnonzero(right)
        shared, size = _shared_counts([sets[k] for k in i], [sets[k] for k in j]), np.array([len(s) for s in sets])
        hit = (100 * shared >= percent * (size[i][:, None] + size[j][None, :] - shared)) & (comp[i][:, None] != comp[j][None, :])
        x, y = np.nonzero(hit)
        a, b = _forest(comp[i[x]], comp[j[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compare(scratch: Scratch, buckets: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame | None:
    """Labels after a test of all pairs of different components that share a bucket."""
    members = buckets.select("key", "node", "size")
    members = members.withColumn("comp", F.col("node")) if labels is None else members.join(labels, "node", "left").select(
        "key", "node", "size", F.coalesce("label", "node").alias("comp")
    )
    members = scratch.save(members, "open")
    heads = members.groupBy("key").agg(
        F.min("node").alias("head"), F.min("comp").alias("c"), F.max("comp").alias("d")
    ).where("c <> d").select("key", "head")
    # A node stands for itself by the smallest head of its buckets. Few nodes are that, so the graph of groups is one of these few,
    # however many members and buckets there are.
    first = F.min("head").over(Window.partitionBy("node")).alias("first")
    open_keys = scratch.save(members.join(heads, "key").select("key", "node", first), "open")
    if open_keys.isEmpty():
        return labels
    firsts = scratch.save(open_keys.select("key", "first").distinct(), "firsts")
    least = firsts.groupBy("key").agg(F.min("first").alias("a"))
    ends = firsts.join(least, "key").select("a", F.col("first").alias("b")).where("a <> b")
    groups = _components(scratch, None, ends).select(F.col("node").alias("first"), F.col("label").alias("group"))
    nodes = members.groupBy("node").agg(F.min("size").alias("size"), F.min("comp").alias("comp")).join(
        open_keys.groupBy("node").agg(F.min("key").alias("place"), F.min("first").alias("first")), "node"
    )
    nodes = nodes.join(groups, "first", "left").withColumn("group", F.coalesce("group", "first")).drop("first")
    nodes = scratch.save(nodes, "members")
    # A component that fills tiles of its own is not compared with itself; the small ones share tiles. Nodes of one bucket come
    # to one tile, as far as it holds them, so that few pairs of tiles have a bucket in common.
    own = nodes.groupBy("group", "comp").agg(F.count("*").alias("n")).where(F.col("n") >= TILE).select(
        "group", "comp", F.col("comp").alias("own")
    )
    nodes = nodes.join(own, ["group", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    nodes = scratch.save(nodes, "members")
    need = F.ceil(F.greatest(F.sum("n") / TILE, F.sum("s") / TILE_SHINGLES))
    places = scratch.save(nodes.groupBy("group", "own", "place").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "places")
    parts = places.groupBy("group", "own", "place").agg(need.alias("parts"))
    tiles = places.groupBy("group", "own").agg(need.alias("tiles"))
    nodes = nodes.join(parts, ["group", "own", "place"]).join(tiles, ["group", "own"])
    spread = F.when(
        F.col("parts") > 1, F.xxhash64("place", F.pmod(F.xxhash64("node"), "parts"))
    ).otherwise(F.pmod(F.xxhash64("place"), "tiles"))
    nodes = scratch.save(nodes.select("node", "comp", "own", F.xxhash64("group", "own", spread).alias("tile")), "tiled")
    met = scratch.save(open_keys.join(nodes.select("node", "own", "tile"), "node").select("key", "own", "tile").distinct(), "met")
    other = met.select("key", F.col("own").alias("other"), F.col("tile").alias("to"))
    pairs = met.join(other, "key").where("tile <= to and not (own = other and own <> -1)").select("tile", "to").distinct()
    pairs = scratch.save(pairs.withColumn("pair", F.monotonically_increasing_id()), "tile_pairs")
    sides = pairs.select("pair", "tile", F.lit(False).alias("right")).union(
        pairs.where("tile <> to").select("pair", F.col("to").alias("tile"), F.lit(True).alias("right"))
    )
    rows = nodes.join(sides, "tile").select("pair", "right", "node", "comp").join(sets, "node")
    links = rows.groupBy("pair").applyInArrow(_compare_tiles(percent), "a long, b long")
    links = scratch.save(links.where("a <> b").distinct(), "links")
    return labels if links.isEmpty() else _components(scratch, labels, links)


def _groups(docs: DataFrame, doc_id: str, text: str, percent: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """(scratch, rows, classes): rows have doc_id, _x (hash of the text), hi, lo, n_shingles; classes hi, lo, label."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_x"), F.col(text).alias("_text"))
    schema = f"doc_id {kind}, _x long, hi long, lo long, n_shingles long, hashes array<long>"
    rows = scratch.save(source.mapInArrow(_fingerprints(False), schema), "rows")
    classes = rows.where("n_shingles > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.any_value("hashes").alias("hashes")
    )
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = classes.select("node", F.col("n").alias("size"), F.explode("hashes").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = scratch.save(shared, "shared")
    buckets = scratch.save(members.join(shared, "key", "left_semi").select("key", "node", "size"), "buckets")
    scratch.drop(shared)
    nodes = scratch.save(buckets.select("node").distinct(), "nodes")
    wanted = classes.join(nodes, "node", "left_semi").select("node", "hi", "lo", "n", "first_id")
    ids = wanted.select(F.col("first_id").alias("_wanted")).distinct()
    again = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("_text").mapInArrow(
        _fingerprints(True), "hi long, lo long, n_shingles long, hashes array<long>"
    )
    again = again.groupBy("hi", "lo").agg(F.any_value("hashes").alias("hashes"))
    sets = scratch.save(again.join(wanted.select("node", "hi", "lo"), ["hi", "lo"]).select("node", "hashes"), "sets")

    rest, labels = _search(scratch, buckets, sets, percent)
    labels = _compare(scratch, rest, sets, labels, percent)
    labelled = classes.select("hi", "lo", "first_id", "node")
    labelled = labelled.withColumn("label", F.col("node")) if labels is None else labelled.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    return scratch, rows.drop("hashes"), scratch.save(labelled, "labelled")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept.

    Words are split at ASCII white space, A-Z lower-cased. Null, empty and blank texts have no shingle and are linked with
    nothing. Texts of fewer than five words are one shingle. Repeated rows give repeated results. A null doc_id is no
    candidate for the smallest one; a component of null ids only has a null component_id and is kept. An empty table
    gives an empty table. Other columns of the input play no part.
    """
    scratch, rows, classes = _groups(docs, doc_id, text, percent)
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("smallest"))
    classes = scratch.save(classes.join(smallest, "label").select("hi", "lo", "smallest"), "components")
    out = rows.join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILAR_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component: that of the smallest (doc_id, text hash).

    Rows without a shingle all stay, but for repeats of the same doc_id and text.
    """
    scratch, rows, classes = _groups(docs, doc_id, text, percent)
    out = rows.join(classes.select("hi", "lo", "label"), ["hi", "lo"], "left")
    best = out.where("n_shingles > 0").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_x")).alias("m")
    ).select("m.doc_id", "m._x")
    keep = best.union(out.where("n_shingles = 0").select("doc_id", "_x")).distinct()
    keep = scratch.save(keep.select(F.col("doc_id").alias("_id"), F.col("_x").alias("_kx")), "keep")
    d = docs.select(packed(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("x"))

    def once(part: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose keys are kept, each once. Join and window have one partitioning, so texts are shuffled once."""
        same = F.col("x") == F.col("_kx")
        found = part.join(kept, same & (F.col("id") == F.col("_id")) if "id" in keys else same, "left_semi")
        again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        return found.withColumn("again", again).where("again = 1").select(*unpacked("row", docs.columns))

    return once(
        d.where("id is not null"), keep.where("_id is not null"), ["x", "id"]
    ).union(once(d.where("id is null"), keep.where("_id is null"), ["x"]))
