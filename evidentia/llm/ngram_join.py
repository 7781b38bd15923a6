"""N-gram Jaccard join: exact near-duplicate classes of whole texts in the Jaccard metric space of their word shingles.

A document is the set of its distinct word 5-grams, A-Z folded; with fewer words, the whole sequence is its one shingle. Two documents link when
their Jaccard distance is at most r = 1 - threshold. Only links between different sets are looked for: equal sets are one class from the start.

1. *Prefix stage.* Distances to document pivots are 1 for nearly all texts, so that windows of the triangle inequality would replicate every document to
   every region. Documents are therefore first dealt by shingles. One total order of all shingles (rare ones first, then by hash) is fixed. A pair within
   the distance has its first common shingle among the first n - ceil(2t / (1 + t) n) + 1 shingles of the smaller set, its core, and among the first
   n - ceil(t n) + 1 of the larger, its boundary. So a shingle's region holds the documents with it in core or boundary, and regions without a core vanish.
   In small regions, pairs are counted and dropped unless what they share there can still lead to a link. Regions that share their smallest document are
   merged into a cell, to which a set is sent once.
2. *Voronoi regions.* Cells over a bound of documents or shingles are parted around document pivots, measured exactly and across tasks. What is in reach
   of a pivot is united with it. A document at distance d from its nearest pivot can link only to those between d - r and d + r from that pivot; if all of
   them are united with it, it is settled and goes. Every other document belongs to the region of its nearest pivot, at d, and is replicated to those of
   all pivots within d + 2 r, but for regions whose own documents are all nearer to their pivot by more than r: of two documents in reach of each other,
   both are then in each one's region. Documents that share nothing with any pivot, at distance 1 from all, have a region of their own, with all that
   are at least 1 - r from every pivot.
3. *Recursion.* Regions are cells again, until they are within the bound. Where regions hold nearly all of their cell, as the distances in it leave
   nothing to part, the cell is joined block against block instead.
4. *Exact join.* Within a cell every document in turn is the pivot: its distances are measured and what is in reach is united, unless the same window
   shows that all it could link to are united with it already.
5. Links are contracted to connected components; the smallest doc_id names one.

Rare-first order needs document frequencies: those of pivot candidates are counted over all documents, and the frequent ones go to all executors as a
bitmap of fixed size. Two shingles that share a bit are both late in the order, which costs time, not links.

Sets are of 62-bit hashes, classes of 128-bit fingerprints. A class is named by one row of the table of fingerprints, so that ids may repeat with other
texts.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, bitmap, in_bitmap, map_batches, materialise, mix, tune, word_slices
from .components import connected_components

#: Documents that may have a pivot candidate before it is late in the order.
FREQUENT = 32
#: Documents of a region whose pairs are counted; larger regions become cells at once.
SMALL = 48
#: Documents and shingles of a cell that one task joins; larger cells are parted around so many pivots at a time.
CELL, CELL_SHINGLES, PIVOTS = 1024, 1 << 20, 8
#: Steps in which a window tells distances apart.
STEPS = 100
_MASK = U((1 << 62) - 1)
_KEY = ["id", "fp1", "fp2"]


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int):
    """Yield each row's sorted distinct shingles, as 62-bit hashes."""
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, U)
    for k in range(size):
        rolled = mix(rolled * U(0x9E3779B97F4A7C15) + words[k : k + n])
    rolled &= _MASK
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            short = np.full(1, b - a, U)
            for word in words[a:b]:
                short = mix(short * U(0xC2B2AE3D27D4EB4F) + word)
            yield short & _MASK
        else:
            yield rolled[:0]


def _needed(n, part: Fraction):
    """ceil(part * n)."""
    return -(-n * part.numerator // part.denominator)


def _documents(batch: pa.RecordBatch, size: int):
    for first, words, at in word_slices(batch.column(1), fold=True):
        for k, own in enumerate(shingle_sets(words, at, size)):
            yield first + k, own


def _candidates(size: int, part: Fraction):
    """(token, n): pivot candidates of the order by hash, an eighth more than needed, with the documents of a batch that have them."""

    def run(batches):
        for batch in batches:
            own = [s[: (p := len(s) - _needed(len(s), part) + 1) + p // 8] for _, s in _documents(batch, size) if len(s)]
            tokens, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return run


def _core(part: Fraction) -> Fraction:
    """Of the smaller of two sets within reach, at least this part is common."""
    return 2 * part / (1 + part)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return (int(np.add.reduce(mix(s ^ U(0xA0761D6478BD642F)))), int(np.add.reduce(mix(s ^ U(0xE7037ED1A0B428DB))))) if len(s) else (0, 0)


def _pivots(size: int, part: Fraction, late):
    """(id, n, fp1, fp2, core, last, pivots) of each document: its first shingles in the order, and the places of the last of its core and of them."""
    core = _core(part)

    def run(batches):
        for batch in batches:
            n, fps, inner, last, kept = [], [], [], [], []
            for _, s in _documents(batch, size):
                n.append(len(s))
                fps.append(_fingerprint(s))
                if len(s):
                    behind = in_bitmap(late.value, s.view(np.int64))
                    p, c = len(s) - _needed(len(s), part) + 1, len(s) - _needed(len(s), core) + 1
                    front = len(s) - int(np.count_nonzero(behind))
                    s = np.concatenate([s[~behind], s[behind]])[:p]
                    inner.append(int(s[c - 1]) | (int(c > front) << 62))
                    last.append(int(s[-1]) | (int(p > front) << 62))
                else:
                    inner.append(0)
                    last.append(0)
                kept.append(s)
            fps = np.array(fps, U).reshape(-1, 2).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U), *kept]).view(np.int64)))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(inner, pa.int64()), pa.array(last, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fp1", "fp2", "core", "last", "pivots"])

    return run


def _sets(size: int, wanted):
    """(id, fp1, fp2, shingles) of the documents that the bitmap of ids lets through, once a batch."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(0).fill_null(-1).to_numpy())))
            ids, rows, seen = batch.column(0).to_pylist(), [], set()
            for k, s in _documents(batch, size):
                key = (ids[k], *_fingerprint(s))
                if key not in seen:
                    seen.add(key)
                    rows.append((*key, s.tobytes()))
            fps = np.array([r[1:3] for r in rows], U).reshape(-1, 2).view(np.int64)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "shingles"])

    return run


def join_cell(ids: list[int], sets: list[np.ndarray], part: Fraction) -> list[tuple[int, int]]:
    """Links, exact, that connect the documents of one cell as all its links would: at most one fewer than its documents.

    Every document in turn is the pivot, unless the triangle inequality shows that all it could link to are united with it.
    """
    m, radius = len(ids), float(1 - part) + 1e-9
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root, links = np.arange(m), []
    # distances to the first pivot that reached a document, by pivot
    reached: list[tuple[int, np.ndarray]] = []
    by_pivot = np.full(m, -1)
    for i in range(m):
        if by_pivot[i] >= 0:
            distance = reached[by_pivot[i]][1]
            window = np.abs(distance - distance[i]) <= radius
            if np.all(root[window] == root[i]):
                continue
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        shared = np.bincount(owner[at], minlength=m)
        union = sizes + sizes[i] - shared
        near = shared * part.denominator >= union * part.numerator
        near[i] = False
        if len(reached) < 64:
            reached.append((i, 1 - shared / union))
            by_pivot[(by_pivot < 0) & near] = len(reached) - 1
            by_pivot[i] = len(reached) - 1
        for j in np.flatnonzero(near & (root != root[i])):
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def _join_cells(part: Fraction):
    """Links of cells that come one after another, in rows sorted by cell."""

    def run(batches):
        key, ids, sets, found = None, [], [], []

        def close():
            if len(ids) > 1:
                found.extend(join_cell(ids, sets, part))

        for batch in batches:
            for own, member, shingles in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != key:
                    close()
                    key, ids, sets = own, [], []
                if not ids or ids[-1] != member:
                    ids.append(member)
                    sets.append(np.frombuffer(shingles, U))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
            found = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _cells(rows: DataFrame, part: Fraction) -> DataFrame:
    """(cell, member) from the regions (token, row, inner, n, core, last, m, low): cells that together hold every pair that may link.

    inner: the token is in the row's core.
    """
    num, den, core = part.numerator, part.denominator, _core(part)
    small = rows.filter(F.col("m") <= SMALL).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "row", "inner", "core", "last"))).alias("x"))
    made = "struct(struct(a.n as n, a.row as row, a.core as core) as a, struct(b.n as n, b.row as row, b.last as last) as b)"
    pairs = small.selectExpr(f"inline(flatten(transform(x, (a, i) -> transform(filter(slice(x, i + 2, size(x)), b -> a.inner and {den} * a.n >= {num} * b.n), b -> {made}))))")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    # of the one whose first shingles end first, what it shares up to there is known; at most the rest of it is shared beyond
    rest = f"if(a.core <= b.last, ceil({core.numerator} * a.n / {core.denominator}D - 1e-6), ceil({num} * b.n / {den}D - 1e-6)) - 1"
    pairs = pairs.filter(f"shared >= ceil(({num} * (a.n + b.n)) / {num + den}D - 1e-6) - ({rest})")
    pairs = materialise(pairs.selectExpr("least(a.row, b.row) as a", "greatest(a.row, b.row) as b"))
    # a pair is in the cell of a third if that is the smallest partner of both
    lowest = pairs.groupBy("b").agg(F.min("a").alias("low"))
    of_a = lowest.select(F.col("b").alias("a"), F.col("low").alias("low_a"))
    pairs = pairs.join(lowest, "b").join(of_a, "a", "left").filter("a = low or low_a is null or low_a != low")
    cells = pairs.select(F.col("a").alias("cell"), F.explode(F.array("a", "b")).alias("member"))
    return cells.unionByName(rows.filter(F.col("m") > SMALL).select(F.col("low").alias("cell"), F.col("row").alias("member"))).distinct()


def _measure(batches):
    """(cell, member, pivot, shared, total) of blocks whose first rows are the pivots: sizes of intersection and union with each one's set."""
    key, centres, before = None, {}, None
    for batch in batches:
        out = []
        for cell, block, first, member, shingles in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            own = np.frombuffer(shingles, U)
            if (cell, block) != key:
                key, centres, before = (cell, block), {}, None
            if not first:
                centres[member] = own
            elif member != before:
                before = member
                for pivot, centre in centres.items():
                    at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    shared = int(np.count_nonzero(centre[at] == own))
                    out.append((cell, member, pivot, shared, len(centre) + len(own) - shared))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["cell", "member", "pivot", "shared", "total"])


def _unite(rows: pd.DataFrame) -> pd.DataFrame:
    """(cell, node, to): the smallest node that each end of a cell's edges (x, y) is united with."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for x, y in zip(rows["x"].tolist(), rows["y"].tolist(), strict=True):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return pd.DataFrame({"cell": rows["cell"].iloc[0], "node": list(root), "to": [find(v) for v in root]})


def _over(cells: DataFrame) -> DataFrame:
    """(cell, m, blocks) of cells over the bound."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    return sizes.withColumn("blocks", blocks).filter((F.col("blocks") > 1) & (F.col("m") > 2)).select("cell", "m", "blocks")


def _part(cells: DataFrame, docs: DataFrame, size: int, part: Fraction) -> tuple[DataFrame, DataFrame | None]:
    """(cells, links): cells (cell, member, n, id, fp1, fp2) over the bound are parted into Voronoi regions, again and again; settled documents go.

    A round costs one row per document and pivot. A group of near copies, however large, is settled in the round that takes one of it as a pivot. A cell
    is left as it is if a round removes less than a tenth of it and its regions would save less than half of its pairs.
    """
    spark, radius = docs.sparkSession, float(1 - part)
    large = materialise(_over(cells))
    if large.isEmpty():
        return cells, None
    keys = ["member", "n", *_KEY]
    now = materialise(cells.join(large.select("cell"), "cell").withColumn("label", F.col("member")).withColumn("seen", F.lit(False)))
    done, links = [cells.join(large, "cell", "left_anti")], []
    named = now.select(*keys).distinct()
    wanted = spark.sparkContext.broadcast(bitmap(now, "id"))
    sets = map_batches(docs, _sets(size, wanted), "id long, fp1 long, fp2 long, shingles binary")
    sets = materialise(sets.join(named, _KEY).groupBy("member").agg(F.first("shingles").alias("shingles")))
    window, k = int(radius * STEPS) + 2, 0
    while True:
        large = materialise(_over(now))
        done.append(now.join(large, "cell", "left_anti").select("cell", *keys))
        if large.isEmpty():
            break
        now = materialise(now.join(large, "cell"))
        # by a hash, so that a round does not take the pivots of one before
        place = F.row_number().over(Window.partitionBy("cell").orderBy("seen", F.xxhash64("member", F.lit(k)), "member"))
        pivots = materialise(now.withColumn("place", place).filter(F.col("place") <= PIVOTS).select("cell", "blocks", F.col("member").alias("pivot")))
        rows = now.select("cell", F.pmod(F.xxhash64("member"), "blocks").cast("long").alias("block"), F.lit(1).cast("long").alias("first"), "member")
        centres = pivots.select("cell", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.lit(0).cast("long").alias("first"), F.col("pivot").alias("member"))
        keyed = rows.unionByName(centres).join(sets, "member").select("cell", "block", "first", "member", "shingles")
        keyed = keyed.repartition("cell", "block").sortWithinPartitions("cell", "block", "first", "member")
        found = map_batches(keyed, _measure, "cell long, member long, pivot long, shared long, total long")
        near = F.col("shared") * part.denominator >= F.col("total") * part.numerator
        found = materialise(found.select("cell", "member", "pivot", near.alias("near"), (1 - F.col("shared") / F.col("total")).alias("d"), F.expr(f"cast((total - shared) * {STEPS} div total as int)").alias("step")))
        links.append(found.filter("near and member != pivot").select(F.col("pivot").alias("a"), F.col("member").alias("b")))

        own = found.groupBy("cell", "member").agg(F.min(F.struct("d", "pivot", "step")).alias("home"), F.min(F.when(F.col("near"), F.col("pivot"))).alias("by"), F.collect_set(F.when(F.col("near"), F.col("pivot"))).alias("reached"))
        own = materialise(now.join(own, ["cell", "member"]))
        # between pivots and the labels of documents that earlier rounds reached: a bounded number for each cell
        ends = F.concat("reached", F.when(F.col("seen"), F.array("label")).otherwise(F.array().cast("array<bigint>")))
        edges = own.filter("by is not null").select("cell", F.col("by").alias("x"), F.explode(ends).alias("y")).distinct()
        united = materialise(edges.groupBy("cell").applyInPandas(_unite, "cell long, node long, to long"))
        own = own.withColumn("node", F.coalesce("by", "label")).join(united, ["cell", "node"], "left")
        own = materialise(own.withColumn("label", F.coalesce("to", "label")).withColumn("seen", F.expr("seen or by is not null")).drop("node", "to", "reached", "by"))
        steps = found.select("cell", "member", "pivot", "step").join(own.select("cell", "member", "label"), ["cell", "member"])
        steps = steps.groupBy("cell", "pivot", "step").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        steps = materialise(steps.groupBy("cell", "pivot").agg(F.collect_list(F.struct("step", "lo", "hi")).alias("steps")))
        other = F.exists("steps", lambda s: (F.abs(s["step"] - F.col("home.step")) <= window) & ((s["lo"] != F.col("label")) | (s["hi"] != F.col("label"))))
        own = own.withColumn("pivot", F.col("home.pivot")).join(steps, ["cell", "pivot"])
        own = materialise(own.filter(other).select("cell", "m", *keys, "label", "seen", F.col("home.d").alias("nearest"), F.col("home.pivot").alias("home")))

        reach = own.filter("nearest < 1").groupBy("cell", F.col("home").alias("pivot")).agg(F.max("nearest").alias("reach"))
        regions = found.select("cell", "member", "pivot", "d").join(own.select("cell", "member", "nearest"), ["cell", "member"]).join(materialise(reach), ["cell", "pivot"])
        regions = regions.filter(F.col("d") <= F.least(F.col("nearest") + 2 * radius, F.col("reach") + radius) + 1e-9).select("cell", "member", "pivot")
        # documents without a shingle of any pivot, and those that may link to them
        far = own.filter("nearest >= 1").select("cell").distinct()
        rest = own.filter(F.col("nearest") >= 1 - radius - 1e-9).join(far, "cell").select("cell", "member", F.lit(-1).cast("long").alias("pivot"))
        regions = materialise(regions.unionByName(rest))
        pairs = regions.groupBy("cell", "pivot").agg(F.count("*").cast("double").alias("c")).groupBy("cell").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        left = own.groupBy("cell").agg(F.count("*").cast("double").alias("c"), F.max("m").alias("m"))
        fate = F.when(F.col("pairs") <= 0.5 * F.col("c") * F.col("c"), "part").when(F.col("c") <= 0.9 * F.col("m"), "again").otherwise("blocks")
        fates = materialise(left.join(pairs, "cell").select("cell", fate.alias("fate")))
        own = own.select("cell", *keys, "label", "seen").join(fates, "cell")
        done.append(own.filter("fate = 'blocks'").select("cell", *keys))
        again = own.filter("fate = 'again'").drop("fate")
        parted = own.filter("fate = 'part'").drop("fate").join(regions, ["cell", "member"]).withColumn("cell", F.xxhash64("cell", "pivot", F.lit(k))).drop("pivot")
        now, k = materialise(again.unionByName(parted)), k + 1
    return materialise(functools.reduce(DataFrame.unionByName, [d.select("cell", *keys) for d in done])), functools.reduce(DataFrame.unionByName, links)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    component_id is the smallest doc_id that links lead to, its own included. A null or empty text, or one without words, has no shingles and
    links with nothing. Equal texts always share a class. A row without id gets its n_shingles and no component. Rows that share an id are one
    node with the links of all its texts, whatever their order. An empty table gives an empty result; other columns of docs are ignored. No row, partner
    or candidate is dropped at any size.
    """
    spark, part = docs.sparkSession, Fraction(str(threshold)).limit_denominator(1000)
    tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = map_batches(docs, _candidates(size, part), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    late = spark.sparkContext.broadcast(bitmap(counted.filter(F.col("n") > FREQUENT), "token"))
    found = map_batches(docs, _pivots(size, part, late), "id long, n long, fp1 long, fp2 long, core long, last long, pivots array<long>")
    # drawn once and kept
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()))

    sets = found.filter("n > 0 and id is not null").select("id", "n", "fp1", "fp2", "row")
    classes = materialise(sets.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("id", "row")).alias("f")).select("fp1", "fp2", "n", "f.id", "f.row"))
    shown = found.join(classes.select("row"), "row", "left_semi")
    of_core = f"n - ceil({_core(part).numerator} * n / {_core(part).denominator}D - 1e-6) + 1"
    # a row and whether the token is in its core, in one number
    regions = shown.select(F.posexplode("pivots").alias("at", "token"), "row", F.expr(of_core).alias("c")).select("token", F.expr("row * 2 + if(at < c, 1, 0)").alias("own")).repartition("token")
    shared = regions.groupBy("token").agg(F.count("*").alias("m"), F.min("own").alias("low"), F.max(F.expr("own & 1")).alias("inner")).filter("m > 1 and inner = 1").select("token", "m", F.shiftright("low", 1).alias("low"))
    regions = materialise(regions.join(shared.hint("shuffle_hash"), "token").select("token", F.shiftright("own", 1).alias("row"), F.expr("own & 1 = 1").alias("inner"), "m", "low"))
    cells = materialise(_cells(regions.join(shown.select("row", "n", "core", "last"), "row"), part))
    cells = materialise(cells.join(classes.select(F.col("row").alias("member"), "n", *_KEY), "member"))
    cells, parted = _part(cells, docs, size, part)

    wanted = spark.sparkContext.broadcast(bitmap(cells, "id"))
    members = map_batches(docs, _sets(size, wanted), "id long, fp1 long, fp2 long, shingles binary")
    blocks = cells.join(_over(cells).select("cell", "blocks"), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("member"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    keyed = blocks.select(F.struct("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("key"), "member", *_KEY)
    keyed = keyed.join(members, _KEY).select(F.to_json("key").alias("key"), "member", "shingles")
    links = map_batches(keyed.repartition("key").sortWithinPartitions("key", "member"), _join_cells(part), "a long, b long")
    links = links if parted is None else links.unionByName(parted)
    # an id of several texts joins their classes
    several = materialise(sets.groupBy("id").agg(F.min(F.struct("fp1", "fp2", "n")).alias("lo"), F.max(F.struct("fp1", "fp2", "n")).alias("hi")).filter("lo != hi").select("id", "lo"))
    if not several.isEmpty():
        of = classes.select("fp1", "fp2", "n", F.col("row").alias("a"))
        texts = sets.select("id", "fp1", "fp2", "n").join(several, "id").distinct().join(of, ["fp1", "fp2", "n"])
        first = several.select("id", "lo.*").join(of, ["fp1", "fp2", "n"]).select("id", F.col("a").alias("b"))
        links = links.unionByName(texts.join(first, "id").select("a", "b"))
    components = materialise(connected_components(links))

    named = classes.select(F.col("row").alias("node"), "id").join(components, "node").groupBy("component").agg(F.min("id").alias("least"))
    named = components.join(named, "component").select(F.col("node").alias("row"), "least")
    reps = classes.join(named, "row", "left").select("fp1", "fp2", "n", F.coalesce("least", "id").alias("rep"))
    # written, so that the join's two sides are plain shuffles and a text of many copies can be split
    out = found.select("id", "n", "fp1", "fp2").join(materialise(reps), ["fp1", "fp2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each class those of its smallest id, each text of it once, and all rows without an id.

    Of rows with equal id and text the least by their columns, in order, stays; these must then be of types with an order. A different text is never taken
    for a repeat. Columns stay as they are, whatever their names.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, size, threshold)
    gone = materialise(classes.filter("component_id != doc_id").select(F.col("doc_id").alias("id")).distinct())
    digest = F.coalesce(F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest"))
    # digests alone are shuffled; repeated rows are few, if any
    twice = materialise(whole.filter("id is not null").groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id", "digest"))
    kept = whole.join(gone, "id", "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    once = kept.join(twice, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min("row").alias("row"))
    return kept.join(twice, ["id", "digest"], "left_anti").select("row").unionByName(once.select("row")).select("row.*")
