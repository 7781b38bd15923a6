"""Best-fit packing: hierarchical residual packing of tokenised documents into sequences of bounded length.

Groups of pieces pack best-fit locally, longest first. Bins that are nearly full are emitted. Of the others, a group has one at most that is half empty;
two fuller ones never fit together. So what can still save a sequence is that one and, at the next level, the fuller ones with most room: these go on as
items of their fill to the next level, where the groups of several neighbours are merged and best-fit is repeated, until one group is left. A level holds a
bounded number of items per group below it, so the tree needs no other end. Groups are made of a key's hash, never of a partition, so that a retried task
gives the same bins.

Distinct words of a batch are found by Arrow; a worker remembers their ids in a cache bounded by bytes.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, chunks_of, expand, map_batches, materialise, tune

#: Pieces that a group packs at once; their rows fit a worker's memory many times over.
GROUP = 40_000
#: Groups that are merged at the next level, and fuller bins that a group sends there.
FAN = 64
#: A bin is emitted at this fill.
FULL = 0.995
#: Bytes of the words that a worker remembers, and their ids.
CACHE_BYTES = 96 << 20


class _Words:
    """Ids of words, by the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Generations(CACHE_BYTES)

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        words, out = [c.strip() for c in chunks], [b""] * len(chunks)
        places = [k for k, w in enumerate(words) if w]
        for at in range(0, len(places), 50_000):
            own = places[at : at + 50_000]
            e = self.tokenizer.encode([words[k].decode() for k in own], is_pretokenized=True, add_special_tokens=False)
            packed = np.array(e.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(own)), "right") * 4).tolist()
            for k, a, b in zip(own, [0, *ends], ends, strict=False):
                out[k] = packed[a:b]
        return out


_words = functools.lru_cache(maxsize=2)(_Words)


def text_ids(path: str, column: pa.Array) -> pa.Array:
    """Ids of each text of a column, null being empty, by the tokenizers library, as little-endian unsigned 32-bit integers.

    The vocabulary must drop white space and case, so that a text's ids are those of its words one after another.
    """
    own = _words(path)
    column = column.cast(pa.string()).fill_null("")
    # a special token's string is one in lower case only
    column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
    return expand(*chunks_of(column.cast(pa.binary())), own.known, own.learn)


def pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and then end_id, cut only where it is longer than a sequence.

    ids are little-endian unsigned 32-bit integers; without with_ids the column is left out. A null or empty text is its end_id alone.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            row, piece, start, n, crc, own = [], [], [], [], [], []
            for k, ids in enumerate(text_ids(path, batch.column(1)).to_numpy(zero_copy_only=False)):
                ids += end
                for j, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length] if len(ids) > 4 * length else ids
                    row.append(k)
                    piece.append(j)
                    start.append(at // 4)
                    n.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        own.append(part)
            kept = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.binary())] if with_ids else kept, [*names, "ids"] if with_ids else names)

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")).withColumnRenamed("id", "doc_id")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each item, longest first, each into the fullest bin that has room."""
    room = defaultdict(list)
    mask = 0  # bit r: a bin has room for exactly r more
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for k, size in enumerate(sizes.tolist()):
        free = mask >> size
        if free:
            r = size + (free & -free).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[k], places[k] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, places


def _pack(capacity: int, fan: int, full: float):
    """Best-fit of one group's bins `seq`, each with rows at places; `up` tells rows of bins that go on to the next level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "place", "key", "piece"], kind="stable")
        items = rows.groupby("seq", sort=True)["length"].sum().reset_index(name="size")
        items = items.sort_values(["size", "seq"], ascending=[False, True], kind="stable")
        bins, places = best_fit(items["size"].to_numpy(), capacity)
        # a bin is named after its first item
        first = items["seq"].to_numpy()[np.unique(bins, return_index=True)[1]]
        fill = np.bincount(bins, items["size"].to_numpy()).astype(np.int64)
        less = np.lexsort((first, fill))
        less = less[fill[less] < full * capacity]
        on = np.zeros(len(first), bool)
        on[less[: fan + int(np.count_nonzero(2 * fill[less] <= capacity))]] = True
        moved = pd.DataFrame({"seq": items["seq"].to_numpy(), "to": first[bins], "shift": places, "up": on[bins]})
        rows = rows.merge(moved, on="seq")
        return rows.assign(seq=rows["to"], place=rows["place"] + rows["shift"])[["key", "piece", "length", "seq", "place", "grp", "up"]]

    return run


def pack(items: DataFrame, capacity: int = 2048, group: int = GROUP, fan: int = FAN, full: float = FULL) -> DataFrame:
    """(key, piece, sequence_id, offset) for items (key long, piece int, length long from 1 to capacity); (key, piece) names an item.

    Equal items are all packed; an empty table packs to nothing. sequence_id is unique among sequences.
    """
    groups = max(1, -(-items.count() // group))
    schema = "key long, piece int, length long, seq long, place long, grp long, up boolean"
    items = items.select("key", "piece", "length", F.monotonically_increasing_id().alias("seq"), F.lit(0).cast("long").alias("place"))
    # seq and grp are drawn once and kept
    items = materialise(items.withColumn("grp", F.pmod(F.xxhash64("key", "piece"), F.lit(groups))))
    repeat = lambda rows: materialise(rows.groupBy("grp").applyInPandas(_pack(capacity, fan, full), schema))
    packed = repeat(items)
    out = lambda rows: rows.select("key", "piece", F.col("seq").alias("sequence_id"), F.col("place").alias("offset"))
    if groups == 1:
        return out(packed)
    # bins that go on, by their first name: at most fan + 1 of each group
    now = packed.filter("up").groupBy("seq", "grp").agg(F.sum("length").alias("length"))
    now, done = now.select(F.col("seq").alias("key"), F.lit(0).alias("piece"), "length", "seq", F.lit(0).cast("long").alias("place"), "grp"), []
    while groups > 1:
        groups = -(-groups // fan)
        now = repeat(now.withColumn("grp", F.expr(f"grp div {fan}")).drop("up"))
        done.append(now if groups == 1 else now.filter("not up"))
        now = now.filter("up")
    moved = functools.reduce(DataFrame.unionByName, done).select(F.col("key").alias("seq"), F.col("seq").alias("to"), F.col("place").alias("shift"))
    late = packed.filter("up").join(moved, "seq").select("key", "piece", F.col("to").alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset"))
    return out(packed.filter("not up")).unionByName(late)


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of docs with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null or empty texts are sequences' members of one token, rows that repeat are packed as often as they come, a null id stays null, an empty
    table gives an empty result, other columns are ignored. Ids of tokens are left out here; pieces() has them.
    """
    cut = pieces(docs, path, length, end_id, id_col, text_col, with_ids=False).withColumn("key", F.monotonically_increasing_id())
    cut = materialise(cut)
    placed = pack(cut.select("key", "piece", "length"), length)
    return cut.join(placed.drop("piece"), "key").drop("key")
