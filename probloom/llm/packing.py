"""Filling fixed-capacity containers with items.

Items wait in one queue per source, in a fixed pseudo-random order. A container
is a window of the output; each window credits every source with its target part
of the capacity. The source with the greatest deficit gives the item at the head
of its queue for as long as heads fit; then the window is closed with the largest
items that still fit, of whatever source, the greater deficit first among equal
sizes. Deficits carry over to the next window, so the shares of the windows
together follow the target shares. An item larger than the capacity is cut: its
full pieces are containers of their own, its rest an item.

Shards of bounded size are packed in parallel. All their windows below ``POOR``
are opened again and packed together with those of 63 other shards, under the
shards' summed deficits, level by level until one shard is left; every shard
packs its poor windows once more, largest items first, before it gives them up.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.runtime import stored

#: Tokens and items of a shard (on average), shards that meet on the next level, fill below which a window is opened again.
SHARD_TOKENS, SHARD_ITEMS, MEET, POOR = 8_000_000, 100_000, 64, 0.98

PACKED = "spec_code string, shard long, container string, window int, source string, doc_id long, piece int, start long, end long, deficit double"
NAMES = [c.split()[0] for c in PACKED.split(", ")]


class Queue:
    """Items of one source: given from the head, or the largest that fits."""

    def __init__(self, items: list[tuple[int, int]]) -> None:
        self.held: dict[int, list[int]] = {}
        for size, item in reversed(items):
            self.held.setdefault(size, []).append(item)
        self.sizes = sorted(self.held)
        self.order, self.at, self.early = [size for size, _ in items], 0, Counter()

    def head(self) -> int | None:
        """Size of the item at the head; items of a size are alike, so those given early are passed over by size."""
        while self.at < len(self.order):
            size = self.order[self.at]
            if not self.early[size]:
                return size
            self.early[size] -= 1
            self.at += 1
        return None

    def fitting(self, room: int) -> int:
        """The largest size within ``room``, or 0."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def give(self, size: int, from_head: bool) -> int:
        if from_head:
            self.at += 1
        else:
            self.early[size] += 1
        items = self.held[size]
        item = items.pop()
        if not items:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return item


def fill_windows(capacity: int, queues: dict[str, list[tuple[int, int]]], credit: dict[str, float], deficit: dict[str, float]) -> list[list[tuple[str, int]]]:
    """Windows of (source, item); queues: (size, item) in the order in which they wait; deficit is changed."""
    windows, names = [], sorted(queues)
    waiting = sum(map(len, queues.values()))
    held = {s: Queue(queues[s]) for s in names}
    if any(q.sizes and q.sizes[-1] > capacity for q in held.values()):
        raise ValueError("an item is larger than the capacity")
    while waiting:
        left, window = capacity, []
        for s in names:
            deficit[s] = deficit.get(s, 0.0) + credit.get(s, 0.0) * capacity
        closing = False
        while left:
            ready = [s for s in names if held[s].sizes and held[s].sizes[0] <= left]
            if not ready:
                break
            s = max(ready, key=lambda s: (deficit[s], s))
            size = held[s].head()
            closing = closing or size > left
            if closing:
                size, _, s = max((held[s].fitting(left), deficit[s], s) for s in ready)
            window.append((s, held[s].give(size, not closing)))
            deficit[s] -= size
            left -= size
            waiting -= 1
        windows.append(window)
    return windows


def pack_shard(group: pa.Table, level: int, last: bool) -> pa.Table:
    """Pack one shard of one spec; windows to be opened again keep a null container."""
    frame = group.to_pandas()
    capacity, spec, shard = int(frame["capacity"].iloc[0]), frame["spec_code"].iloc[0], int(frame["shard"].iloc[0])
    carried = frame[frame["doc_id"].isna()]
    items = frame[frame["doc_id"].notna()].sort_values(["turn", "doc_id", "piece"], kind="stable").reset_index(drop=True)
    source, size = items["source"].to_numpy(), (items["end"] - items["start"]).to_numpy().astype(np.int64)
    deficit: dict[str, float] = {}
    for s, d in zip(carried["source"], carried["deficit"]):
        deficit[s] = deficit.get(s, 0.0) + d
    credit = dict(zip(items["source"], items["credit"]))

    def fill(rows: np.ndarray) -> list[list[tuple[str, int]]]:
        queues: dict[str, list[tuple[int, int]]] = {}
        for i in rows:
            queues.setdefault(source[i], []).append((int(size[i]), int(i)))
        return fill_windows(capacity, queues, credit, deficit)

    def poor(windows: list[list[tuple[str, int]]]) -> list[int]:
        return [w for w, window in enumerate(windows) if size[[i for _, i in window]].sum() < POOR * capacity]

    def undo(window: list[tuple[str, int]]) -> None:
        """Tokens and credit of a window go back."""
        for s in credit:
            deficit[s] = deficit.get(s, 0.0) - credit[s] * capacity
        for s, i in window:
            deficit[s] += int(size[i])

    windows = fill(np.arange(len(items)))
    again = poor(windows)
    for w in again:
        undo(windows[w])
    loose = np.array([i for w in again for _, i in windows[w]], np.int64)
    dropped = set(again)
    windows = [x for w, x in enumerate(windows) if w not in dropped] + fill(loose[np.argsort(-size[loose], kind="stable")])
    names, place = np.empty(len(items), object), np.zeros(len(items), np.int32)
    for w, window in enumerate(windows):
        at = [i for _, i in window]
        names[at], place[at] = f"{spec}-{level}-{shard}-{w}", w
    for w in () if last else poor(windows):
        undo(windows[w])
        names[[i for _, i in windows[w]]] = None
    n, extra = len(items), sorted(deficit)
    return pa.table(
        {
            "spec_code": pa.array([spec] * (n + len(extra)), pa.string()),
            "shard": pa.array([shard] * (n + len(extra)), pa.int64()),
            "container": pa.array([*names, *[None] * len(extra)], pa.string()),
            "window": pa.array([*place, *[0] * len(extra)], pa.int32()),
            "source": pa.array([*source, *extra], pa.string()),
            "doc_id": pa.array([*items["doc_id"].astype("int64"), *[None] * len(extra)], pa.int64()),
            "piece": pa.array([*items["piece"].astype("int32"), *[None] * len(extra)], pa.int32()),
            "start": pa.array([*items["start"].astype("int64"), *[None] * len(extra)], pa.int64()),
            "end": pa.array([*items["end"].astype("int64"), *[None] * len(extra)], pa.int64()),
            "deficit": pa.array([*[None] * n, *[deficit[s] for s in extra]], pa.float64()),
        }
    )


def _packer(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        return pack_shard(group, level, last)

    return run


def pack(items: DataFrame, specs: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(spec_code, container, shard, window, source, doc_id, piece, pieces, start, end): every token of every item once per spec.

    ``shares``: target token share of each source; a source without one has
    none and fills what others leave. Without ``shares`` the sources' own shares
    of all tokens are the targets. As every item is packed, windows keep to
    other targets until a source has run out.

    ``items``: doc_id, source, size; specs: spec_code, capacity (a handful of
    rows). Items of size 0 or null are none; a null source is a queue of its
    own. ``start``/``end`` are token positions in the document; an item is in
    one piece unless it exceeds the capacity. No items or no specs, no containers.
    A doc_id given twice is two items of that id. ``window`` numbers the
    containers of a shard in order; it is null for a full piece of a cut item.
    """
    items = items.where("size > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "size")
    of_source = items.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows")).withColumn("all", F.lit(1))
    total = of_source.agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    tokens, rows = total["tokens"] or 0, total["rows"] or 0
    shards = max(1, math.ceil(tokens / SHARD_TOKENS), math.ceil(rows / SHARD_ITEMS))
    credit = of_source.select("source", (F.col("tokens") / F.lit(float(max(tokens, 1)))).alias("credit"))
    if shares is not None:
        whole_share = sum(shares.values()) or 1.0
        credit = items.sparkSession.createDataFrame([(s, v / whole_share) for s, v in shares.items()], "source string, credit double")
    cut = items.crossJoin(F.broadcast(specs.select("spec_code", F.col("capacity").cast("long").alias("capacity"))))  # a few fixed rows
    cut = cut.select("*", F.ceil(F.col("size") / F.col("capacity")).cast("int").alias("pieces"))
    whole = F.expr("sequence(0, pieces - 1)")
    cut = cut.select("*", F.explode(whole).alias("piece")).select(
        "spec_code", "capacity", "source", "doc_id", "piece", "pieces", (F.col("piece") * F.col("capacity")).alias("start"), F.least("size", (F.col("piece") + 1) * F.col("capacity")).alias("end")
    )
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long")).join(credit, "source", "left").withColumn("credit", F.coalesce("credit", F.lit(0.0)))
    cut = stored(cut, "pack-items")
    pieces = cut.where("pieces > 1 AND end - start = capacity").select("spec_code", F.concat_ws("-", "spec_code", F.lit("whole"), F.col("doc_id"), "piece").alias("container"), F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("window"), "source", "doc_id", "piece", "start", "end")
    turn = F.xxhash64(F.lit(3), "doc_id", "piece").alias("turn")  # the order in which items wait
    open_ = cut.where("NOT (pieces > 1 AND end - start = capacity)").select("spec_code", "capacity", "shard", "source", "doc_id", "piece", "start", "end", "credit", F.lit(None).cast("double").alias("deficit"), turn)
    done, level = [pieces], 0
    spec_of = cut.select("spec_code", "capacity").distinct()
    while True:
        last = shards == 1
        packed = stored(open_.groupBy("spec_code", "shard").applyInArrow(_packer(level, last), PACKED), "packed")
        done.append(packed.where("container IS NOT NULL").select("spec_code", "container", "shard", "window", "source", "doc_id", "piece", "start", "end"))
        if last:
            break
        shards, level = math.ceil(shards / MEET), level + 1
        open_ = packed.where("container IS NULL").drop("container").withColumn("shard", F.floor(F.col("shard") / MEET)).join(F.broadcast(spec_of), "spec_code").join(credit, "source", "left").withColumn("credit", F.coalesce("credit", F.lit(0.0)))
        open_ = open_.select("spec_code", "capacity", "shard", "source", "doc_id", "piece", "start", "end", "credit", "deficit", turn)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    of_item = cut.where("piece = 0").select("spec_code", "doc_id", "pieces").distinct()
    return out.join(of_item, ["spec_code", "doc_id"]).select("spec_code", "container", "shard", "window", F.when(F.col("source") != "", F.col("source")).alias("source"), "doc_id", "piece", "pieces", "start", "end")


def pack_report(packed: DataFrame, specs: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Per spec: containers, pieces, tokens, fill, and how far the containers' source shares are from the targets.

    ``window_gap``: the greatest gap of a container's source shares, on average;
    ``running_gap``: the same of all windows of its shard up to a container.
    Targets are ``shares``, or the sources' shares of all tokens. Cut pieces that
    fill a container of their own count for the fill alone.
    """
    size = F.sum(F.col("end") - F.col("start"))
    rows = packed.withColumn("source", F.coalesce("source", F.lit("")))
    per = rows.groupBy("spec_code", "container").agg(size.alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("source").alias("sources"))
    out = per.groupBy("spec_code").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.avg("sources").alias("mean_sources"))
    if shares is None:
        target = rows.groupBy("spec_code", "source").agg(size.alias("t")).withColumn("target", F.col("t") / F.sum("t").over(Window.partitionBy("spec_code"))).select("spec_code", "source", "target")
    else:
        whole = sum(shares.values()) or 1.0
        target = specs.select("spec_code", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(v / whole).alias("target")) for s, v in shares.items()])).alias("x")).select("spec_code", "x.*")
    # A row per window and source, also of sources that give it nothing.
    windows = rows.where("window IS NOT NULL")
    given = windows.groupBy("spec_code", "container", "shard", "window", "source").agg(size.alias("given"))
    full = given.groupBy("spec_code", "container", "shard", "window").agg(F.sum("given").alias("all_given"))
    grid = full.join(F.broadcast(target), "spec_code").join(given.select("container", "source", "given"), ["container", "source"], "left").withColumn("given", F.coalesce("given", F.lit(0)))
    level = F.substring_index("container", "-", -3)  # level, shard and window
    level = F.substring_index(level, "-", 1)
    before = Window.partitionBy("spec_code", level, "shard", "source").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)  # at most a shard's windows
    grid = grid.select("spec_code", "container", F.abs(F.col("given") / F.col("all_given") - F.col("target")).alias("own"), F.abs(F.sum("given").over(before) / F.sum("all_given").over(before) - F.col("target")).alias("run"))
    gap = grid.groupBy("spec_code", "container").agg(F.max("own").alias("own"), F.max("run").alias("run")).groupBy("spec_code").agg(F.avg("own").alias("own"), F.avg("run").alias("run"))
    out = out.join(gap, "spec_code", "left").join(F.broadcast(specs), "spec_code")
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return out.select("spec_code", "capacity", "containers", "pieces", "tokens", "fullest", F.round("mean_sources", 4).alias("mean_sources"), F.round(fill, 6).alias("fill"), F.round("own", 6).alias("window_gap"), F.round("run", 6).alias("running_gap"))
