"""Mixing sources to target weights.

The documents of a source, in a fixed pseudo-random order, form one stream of
tokens that is cut into blocks of ``BLOCK`` tokens. A plan takes as many tokens
of each source as its target asks and the repeat cap allows. Output shards draw
multinomial source counts; the draws of a plan are conditioned on its quotas, so
shares are met to the token and nothing is left over. They are drawn top-down: a
range of shards splits its counts over two halves by a multivariate
hypergeometric draw of its own seed, so any shard's counts, and how many of each
source came before it, follow from the plan alone, without a shuffle. A slot
maps through the source's pseudo-random index permutation of the pass it falls
in to a block, and blocks are joined by index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.runtime import stored

#: Tokens of a block, most slots of an output shard, shards of a plan that isn't longer, shards drawn in one task, most slots of a book.
BLOCK, SHARD_SLOTS, LEAST_SHARDS, CHUNK, BOOK = 1024, 8192, 64, 256, 1 << 28


def salted_offset(df: DataFrame, group: list[str], order: list[Column], weight: str, out: str, salts: int) -> DataFrame:
    """Running sum of ``weight`` before each row, in a fixed pseudo-random order of each group, without sorting a group in one task."""
    rows = df.withColumn("__s", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sums = rows.groupBy(*group, "__s").agg(F.sum(weight).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__k_{c}") for c in group], F.col("__s").alias("__k"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inner = Window.partitionBy(*group, "__s").orderBy(F.xxhash64(F.lit(1), *order), *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    on = [F.col(c) == F.col(f"__k_{c}") for c in group] + [F.col("__s") == F.col("__k")]
    return rows.join(sums, on).select(*df.columns, (F.col("__in") + F.col("__at")).cast("long").alias(out))


def token_blocks(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, at, start, end): the parts of documents in every block of every source's stream; ``at`` is the part's place in the block."""
    n = items.count()
    placed = salted_offset(items, ["source"], [F.col("doc_id")], "size", "offset", max(16, math.ceil(n / 100_000)))
    rows = placed.select("*", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block"))
    lo, hi = F.greatest(F.col("offset"), F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("source", "block", "doc_id", (lo - F.col("block") * block).alias("at"), (lo - F.col("offset")).alias("start"), (hi - F.col("offset")).alias("end"))


def plan_quotas(items: DataFrame, plans: DataFrame) -> DataFrame:
    """A row per plan and source: tokens wanted, tokens there, the most that may be used, and the quota.

    ``items``: doc_id, source, size; a document without a source is in no mix
    and counts for no total. A source of a plan without documents has size 0.
    ``short``: the wanted tokens exceed ``max_repeats`` times the source.
    """
    plans = plans.select("plan_no", "source", "target_share", "max_repeats", "size_factor")
    sizes = items.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("size").alias("source_tokens"))
    total = sizes.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    out = plans.join(sizes, "source", "left").crossJoin(F.broadcast(total)).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)).cast("long"))  # total is one row
    wanted = F.col("target_share") * F.col("size_factor") * F.col("all_tokens")
    most = F.col("max_repeats") * F.col("source_tokens")
    return out.select("plan_no", "source", "target_share", "max_repeats", "size_factor", wanted.alias("wanted_tokens"), "source_tokens", most.alias("most_tokens"), (wanted > most).alias("short"), F.least(F.round(wanted).cast("long"), most.cast("long")).alias("quota"))


def slots_of(quota: int, size: int, block: int = BLOCK) -> int:
    """Slots that hold ``quota`` tokens of a stream of ``size`` tokens, pass after pass."""
    return 0 if not size else quota // size * math.ceil(size / block) + math.ceil(quota % size / block)


def _step(plan: int, source: str, turn: int, n: int) -> tuple[int, int]:
    """Step and start of the permutation of 0..n-1 that a pass uses."""
    if n <= 1:
        return 1, 0
    raw = int.from_bytes(hashlib.blake2b(f"{plan}/{source}/{turn}".encode(), digest_size=16).digest(), "big")
    step = raw % n or 1
    while math.gcd(step, n) != 1:
        step = step % n + 1
    return step, (raw >> 64) % n


def shard_length(slots: int) -> int:
    """Slots of a plan's shards (the last may be shorter)."""
    return max(1, min(SHARD_SLOTS, math.ceil(slots / LEAST_SHARDS)))


def books_of(slots: list[int]) -> list[tuple[list[int], list[int]]]:
    """(first slot, slots) of every source in every book: a plan cut into equal parts within what one draw can hold."""
    n = max(1, math.ceil(sum(slots) / BOOK))
    return [([s * b // n for s in slots], [s * (b + 1) // n - s * b // n for s in slots]) for b in range(n)]


def shard_counts(counts: np.ndarray, length: int, shards: int, wanted: range, seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, its slots of each source) for the shards ``wanted`` of a book of ``shards``."""

    def down(lo: int, hi: int, before: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= wanted.start or lo >= wanted.stop:
            return
        if hi - lo == 1:
            yield lo, before, own
            return
        mid = lo + (1 << ((hi - lo - 1).bit_length() - 1))
        left = np.random.default_rng([*seed, lo, hi]).multivariate_hypergeometric(own, min((mid - lo) * length, int(own.sum())), method="marginals")
        yield from down(lo, mid, before, left)
        yield from down(mid, hi, before + left, own - left)

    yield from down(0, shards, np.zeros(len(counts), np.int64), counts)


def mix(items: DataFrame, plans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(plan_no, shard, slot, source, pass, block, at, doc_id, start, end): the mixed blocks as parts of documents.

    ``slot`` numbers the blocks of a plan from 0 in their mixed order, parts of
    a slot follow one another by ``at``. No token of a document is used more
    than ``max_repeats`` times in a plan, and every source gives its quota to
    the token. Documents of size 0 or without a source, sources without
    documents and plans without rows give nothing.
    """
    spark = items.sparkSession
    items = stored(items.where("size > 0 AND source IS NOT NULL").select("doc_id", "source", "size"), "mix-items")
    quotas = plan_quotas(items, plans).collect()  # as many rows as the plans have
    books, draws, quota_rows, turns = [], {}, [], []
    by_plan: dict[int, list] = {}
    for r in quotas:
        by_plan.setdefault(r["plan_no"], []).append(r)
    for plan, own in sorted(by_plan.items()):
        own = sorted(own, key=lambda r: r["source"])
        slots = [slots_of(r["quota"], r["source_tokens"], block) for r in own]
        length, shard, base = shard_length(sum(slots)), 0, 0
        for b, (first, counts) in enumerate(books_of(slots)):
            n = math.ceil(sum(counts) / length)
            draws[plan, b] = ([r["source"] for r in own], first, counts, length, n, shard, base)
            books.append((plan, b, n))
            shard, base = shard + n, base + sum(counts)
        for r, s in zip(own, slots):
            blocks, full = math.ceil(r["source_tokens"] / block), r["source_tokens"] // block
            quota_rows.append((plan, r["source"], blocks, full, int(r["quota"]), int(r["source_tokens"])))
            for t in range(math.ceil(s / blocks) if blocks else 0):
                turns.append((plan, r["source"], t, *_step(plan, r["source"], t, full)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for plan, b, at in zip(frame["plan_no"], frame["book"], frame["at"]):
                names, first, counts, length, n, shard, base = draws[plan, b]
                for i, before, own in shard_counts(np.array(counts, np.int64), length, n, range(at, min(at + CHUNK, n)), [17, int(plan), int(b)]):
                    here, size = base + i * length, int(own.sum())
                    step, begin = _step(plan, f"shard {shard + i}", 0, size)
                    places = np.cumsum(own) - own
                    out += [(plan, shard + i, s, f + int(p), int(c), here, size, int(o), step, begin) for s, f, p, c, o in zip(names, first, before, own, places) if c]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in drawn_row.split(", ")])

    drawn_row = "plan_no long, shard long, source string, first long, n long, base long, size long, place long, jump long, offset long"
    sizes = F.broadcast(spark.createDataFrame(quota_rows, "plan_no long, source string, blocks long, full long, quota long, tokens long"))  # a row per plan and source
    steps = F.broadcast(spark.createDataFrame(turns, "plan_no long, source string, pass long, step long, begin long"))  # a row per plan, source and pass
    grid = spark.createDataFrame([x for x in books if x[2]], "plan_no long, book long, n long").select("plan_no", "book", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)")).alias("at"))
    drawn = grid.repartition("plan_no", "book", "at").mapInPandas(draw, drawn_row)
    slot = drawn.select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("j")).select(
        "plan_no", "shard", "source", (F.col("first") + F.col("j")).alias("k"), (F.col("base") + F.pmod((F.col("place") + F.col("j")) * F.col("jump") + F.col("offset"), F.col("size"))).alias("slot")
    )
    slot = slot.join(sizes, ["plan_no", "source"]).select("*", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("i")).join(steps, ["plan_no", "source", "pass"])
    # The short last block of a stream ends each pass; the last slot of a quota is cut to the token.
    slot = slot.withColumn("block", F.when(F.col("i") < F.col("full"), F.pmod(F.col("i") * F.col("step") + F.col("begin"), F.greatest("full", F.lit(1)))).otherwise(F.col("full")))
    room = F.col("quota") - F.col("pass") * F.col("tokens") - F.col("i") * block
    slot = slot.select("plan_no", "source", "shard", "slot", "pass", "block", F.least(room, F.lit(block)).alias("room"))
    parts = token_blocks(items, block)
    out = slot.join(parts, ["source", "block"]).where("at < room")
    end = F.least(F.col("end"), F.col("start") + F.col("room") - F.col("at"))
    return out.select("plan_no", "shard", "slot", "source", F.col("pass").cast("int").alias("pass"), "block", "at", "doc_id", "start", end.alias("end"))


def mix_report(items: DataFrame, plans: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per plan and source: target and actual share, tokens wanted, allowed and used, whether the target can't be met."""
    got = mixed.groupBy("plan_no", "source").agg(F.sum(F.col("end") - F.col("start")).alias("used_tokens"), (F.max("pass") + 1).alias("passes"))
    out = plan_quotas(items, plans).join(got, ["plan_no", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)).cast("long"))
    share = F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(Window.partitionBy("plan_no")), F.lit(1))
    return out.select("plan_no", "source", "target_share", F.round(share, 6).alias("actual_share"), "wanted_tokens", "source_tokens", "most_tokens", "used_tokens", F.coalesce("passes", F.lit(0)).alias("passes"), "short")
