"""Problem 7: filling fixed-capacity containers with items of varying length.

Hierarchical multi-length packing. Items are routed to tiers of context sizes: the windows of tier t
are the capacity halved t times, and an item goes to the smallest window that holds it. Tiers are
packed one after another, the longest windows first:

1. gaps of the containers of longer tiers are filled with the tier's items, the longest item that
   fits into the tightest gap first;
2. the items left get windows of the tier's own, one each (an item is longer than half its window;
   the shortest tier packs several into a window, best fit first), and 2^t windows make a container;
3. what a container's windows leave unused is one gap: the tier's next items that fit go there, and
   the rest of the gap is left to the shorter tiers.

Items longer than the capacity are cut into full pieces and a rest first. Containers are then dealt
to step groups over the whole output: to and fro in the order of their tokens, the fullest first, so
that every group of a specification holds about the same number of containers and of tokens.

Only (key, size) is shuffled. Items are packed in independent lots, whose number follows the total
size, so a lot is of bounded size whatever the data; each lot leaves at most about one container
part-filled. The order of containers comes from counts by (lot, tokens), not from one global sort.
Null and empty texts have the size of their end mark. A key that stands in several rows is packed
for each row. Capacities must be positive.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import work_table

#: Containers in a lot, context-size tiers (the windows of each half as long as the last's), containers in a step group.
LOT, TIERS, STEP = 1024, 6, 64
#: Specifications packed at once: their number is checked.
MAX_SPECS = 1000


def byte_size(text: str) -> Column:
    """Tokens of a byte-level tokenizer with an end mark."""
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1


def token_size(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, size) by a public tokenizer's vocabulary file (JSON), with one end mark a text; the path is the caller's."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for b in batches:
            sizes = [len(e.ids) + 1 for e in tokenizer.encode_batch([t or "" for t in b.column(1).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [key, "size"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, size bigint")


def tier_of(size: int, capacity: int) -> int:
    """0 for items of more than half the capacity, 1 for more than a quarter, and so on; the last tier holds all shorter ones."""
    tier = 0
    while tier < TIERS - 1 and size * 2 <= capacity:
        size *= 2
        tier += 1
    return tier


class Containers:
    """The containers opened so far: gaps holds (room left, container) in order."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.gaps: list[tuple[int, int]] = []

    def fill(self, size: int) -> int | None:
        """The container with the tightest gap that holds size, after putting it there."""
        at = bisect_left(self.gaps, (size, -1))
        if at == len(self.gaps):
            return None
        room, c = self.gaps.pop(at)
        if room > size:
            insort(self.gaps, (room - size, c))
        return c

    def open(self, used: int) -> int:
        if used < self.capacity:
            insort(self.gaps, (self.capacity - used, self.made))
        self.made += 1
        return self.made - 1


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Best fit of sizes, longest first, into windows of one tier: the positions in each window."""
    gaps: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(gaps, (size, -1))
        room, w = gaps.pop(at) if at < len(gaps) else (window, len(out))
        if w == len(out):
            out.append([])
        out[w].append(i)
        if room > size:
            insort(gaps, (room - size, w))
    return out


def pack_lot(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (none larger than the capacity), by tiers as the module describes."""
    place = [-1] * len(sizes)
    tiers: list[list[int]] = [[] for _ in range(TIERS)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tiers[tier_of(sizes[i], capacity)].append(i)
    containers = Containers(capacity)
    for t, routed in enumerate(tiers):
        left = []
        for i in routed:
            c = containers.fill(sizes[i])
            if c is None:
                left.append(i)
            else:
                place[i] = c
        if not left:
            continue
        # windows of this tier, the fullest first; those that a gap swallows while containers are made up are gone
        windows = windows_of([sizes[i] for i in left], capacity >> t)
        used = [sum(sizes[left[j]] for j in w) for w in windows]
        order = sorted(range(len(windows)), key=lambda w: (used[w], -w))  # the fullest last
        loads = [used[w] for w in order]
        while order:
            mine, room = [], capacity
            for _ in range(min(1 << t, len(order))):
                mine.append(order.pop())
                room -= loads.pop()
            while (at := bisect_right(loads, room)) > 0:  # the gap of the windows together holds another one
                mine.append(order.pop(at - 1))
                room -= loads.pop(at - 1)
            c = containers.open(capacity - room)
            for w in mine:
                for j in windows[w]:
                    place[left[j]] = c
    return place


def pack(items: DataFrame, key: str, specs: DataFrame) -> DataFrame:
    """(spec_id, container, step_group, key, piece, start, size, tier) from items (key, size) and specs (spec_id, capacity_tokens).

    container names are unique within a spec; start is the piece's offset in its item.
    """
    kind = items.schema[key].dataType.simpleString()
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = specs.select("spec_id", F.col("capacity_tokens").cast("bigint").alias("cap")).where("cap > 0")
    known = wanted.limit(MAX_SPECS + 1).collect()
    if len(known) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specifications")
    lots = [F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.cap).cast("bigint").alias("cap"), F.lit(max(1, -(-total // (r.cap * LOT)))).cast("bigint").alias("lots")) for r in known]
    # every item is packed once for each specification, and becomes its pieces
    spec = F.array(*lots) if lots else F.array().cast("array<struct<spec_id:string,cap:bigint,lots:bigint>>")
    rows = items.select(F.col(key).alias("id"), "size", F.explode(spec).alias("s")).select("id", "size", "s.*")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("size") / F.col("cap")).cast("bigint") - 1))))
    rows = rows.select("spec_id", "cap", F.pmod(F.xxhash64("id", "piece"), F.col("lots")).alias("lot"), "id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.least("cap", F.col("size") - F.col("piece") * F.col("cap")).alias("size"))

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["id", "piece", "start"], kind="stable")
        capacity = int(lot["cap"].iloc[0])
        sizes = lot["size"].tolist()
        place = pd.Series(pack_lot(sizes, capacity))
        used = pd.Series(sizes).groupby(place).sum().sort_index()
        nth = used.groupby(used).cumcount()
        return pd.DataFrame({"spec_id": lot["spec_id"].to_numpy(), "lot": lot["lot"].to_numpy(), "c": place.to_numpy(), "used": used.loc[place].to_numpy(), "nth": nth.loc[place].to_numpy(), key: lot["id"].to_numpy(), "piece": lot["piece"].to_numpy(), "start": lot["start"].to_numpy(), "size": sizes, "tier": [tier_of(s, capacity) for s in sizes]})

    packed = work_table(rows.groupBy("spec_id", "lot").applyInPandas(run, f"spec_id string, lot bigint, c bigint, used bigint, nth bigint, `{key}` {kind}, piece bigint, start bigint, size bigint, tier int"), "packed")
    # rank of a container in its specification, the fullest first: containers with more tokens, then those of earlier lots, then its own lot's
    counts = packed.groupBy("spec_id", "used", "lot").agg((F.max("nth") + 1).alias("n"))
    levels = counts.groupBy("spec_id", "used").agg(F.sum("n").alias("n"))
    fuller = Window.partitionBy("spec_id").orderBy(F.desc("used")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("spec_id", "used", F.coalesce(F.sum("n").over(fuller), F.lit(0)).alias("fuller"), F.sum("n").over(Window.partitionBy("spec_id")).alias("all"))
    earlier = Window.partitionBy("spec_id", "used").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("spec_id", "used", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")).join(levels, ["spec_id", "used"])
    ranks = ranks.select("spec_id", "used", "lot", (F.col("fuller") + F.col("earlier")).alias("rank"), F.ceil(F.col("all") / F.lit(STEP)).cast("bigint").alias("groups"))
    at = F.col("rank") + F.col("nth")
    turn, step = F.floor(at / F.col("groups")).cast("bigint"), F.pmod(at, F.col("groups"))
    group = F.when(turn % 2 == 0, step).otherwise(F.col("groups") - 1 - step)
    return packed.join(ranks, ["spec_id", "used", "lot"]).select("spec_id", F.concat_ws("-", "lot", "c").alias("container"), group.alias("step_group"), key, "piece", "start", "size", "tier")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill): how full the containers are."""
    used = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("used")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return used.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select("spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
