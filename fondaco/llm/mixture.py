"""Mixing sources to target weights with a Pfair schedule.

1. Sizes: the tokens of each document, and of each source.
2. Weights: shares of the sources that have any tokens, made to add up to 1. The total is the largest that every such
   source can fill with at most its ``max_repeats`` passes (or a smaller one that is asked for).
3. Order within a source: documents stand in a random order (a hash), cut in buckets of that order so that no task holds a
   whole source; a document's offset is its bucket's offset plus the running sum inside the bucket. Every further pass
   repeats the order, and the last pass ends where the source's tokens are reached.
4. Pfair: the total is cut in equal slots. Block j (from 1) of a source with weight w is released at slot
   floor((j-1)/w) and due by slot ceil(j/w); of the released blocks the earliest deadline goes first. So after every slot
   each source has its due share to less than one block. The schedule repeats after a period in which every weight has a whole number
   of blocks, so only one period is made (on the driver, with rational weights), and a block's slot is found by its number in
   the period. A slot's length doesn't grow with the corpus. Weights without a common period of at most PERIOD slots are
   rounded to one; as a source's tokens are spread over its own blocks alike, its share stays exact and only the order is.
"""

from __future__ import annotations

import heapq
from collections import Counter
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Slots of a period at most, and the tokens of a slot at least.
PERIOD, SLOT_TOKENS = 20_000, 2_048
#: Documents in a bucket of a source's order, about.
BUCKET_DOCS = 50_000


def pfair(weights: dict[str, Fraction], slots: int) -> list[str]:
    """The source of each slot; ``weights`` add up to 1. Ties of deadlines go to the greater weight, then the name."""
    if slots and sum(weights.values()) != 1:
        raise ValueError("weights must add up to 1")
    waiting = [(0, s, 1) for s, w in sorted(weights.items()) if w > 0]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, Fraction, str, int]] = []  # (deadline, -weight, source, block)
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j // weights[s]), -weights[s], s, j))
        # weights add up to 1 and the work is never idle, so a block is always released
        _, _, s, j = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, (j // weights[s], s, j + 1))
    return out


def plan(supply: list[tuple[str, float, int, int]], total: int | None = None) -> tuple[int, dict[str, tuple[Fraction, int]]]:
    """(total tokens, {source: (weight, tokens wanted)}) from (source, target share, max repeats, tokens at hand)."""
    have = {s: (Fraction(str(w)), r, n) for s, w, r, n in supply if w and w > 0 and r and r > 0 and n and n > 0}
    if not have:
        return 0, {}
    whole = sum(w for w, _, _ in have.values())
    most = min(int(r * n / (w / whole)) for w, r, n in have.values())
    total = most if total is None else min(total, most)
    return total, {s: (w / whole, round(w / whole * total)) for s, (w, _, _) in have.items()}


def period(weights: dict[str, Fraction], most: int = PERIOD) -> tuple[int, dict[str, Fraction]]:
    """(slots of a period, weights with whole blocks in it); weights without one of at most ``most`` slots are rounded, none to nothing."""
    exact = lcm(*(w.denominator for w in weights.values())) if weights else 1
    if exact <= most:
        return exact, weights
    blocks = {s: max(1, int(w * most)) for s, w in weights.items()}
    by_rest = sorted(weights, key=lambda s: (int(weights[s] * most) - weights[s] * most, s))
    for s in by_rest * (1 + len(weights)):
        if sum(blocks.values()) == most:
            break
        blocks[s] += 1 if sum(blocks.values()) < most else -1 if blocks[s] > 1 else 0
    return most, {s: Fraction(n, most) for s, n in blocks.items()}


class Mixture:
    """``mixed``: one row per copy of a document in the mixture; ``shares``: the report per source."""

    def __init__(self, sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0):
        """sizes: doc_id, source, n_tokens (unique doc_id); targets: source, target_share, max_repeats.

        Defined cases: documents of sources without a target, of a null source, and documents of no tokens (null and
        empty texts) are not mixed; a source without tokens gets nothing, and its share is divided among the others
        in proportion; equal targets repeated count once (the greatest share); no targets or no documents give an empty mixture
        and a report of zeros; a document stays whole, and slots are at least as long as the longest.
        """
        spark: SparkSession = sizes.sparkSession
        self.seed = seed
        targets = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        at_hand = sizes.filter(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("at_hand"), F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("longest"))
        goals = targets.join(at_hand, "source", "left").collect()  # one row per source of the target list
        self.total, wanted = plan([(r.source, r.target_share, r.max_repeats, r.at_hand) for r in goals], total)
        # a slot holds the longest document, so that an undivided document doesn't upset the shares by more than a slot
        least = max([SLOT_TOKENS, *(r.longest or 0 for r in goals)])
        n = max(1, self.total // least) if self.total else 0
        self.slot_tokens = -(-self.total // n) if n else 1
        self.period, weights = period({s: w for s, (w, _) in wanted.items()})
        order = pfair(weights, min(n, self.period)) if n else []
        seen: dict[str, int] = {}
        slots = []
        for t, s in enumerate(order):
            slots.append((s, seen.get(s, 0), t))
            seen[s] = seen.get(s, 0) + 1
        # a source whose whole share is less than a slot has no block among so few slots: it stands in the last one
        slots += [(s, 0, n - 1) for s in sorted(weights) if n and s not in seen]
        self.slots = spark.createDataFrame(slots, "source string, block long, slot long")
        # blocks of a source in all n slots: whole periods and the beginning of one
        rest = Counter(order[: n % self.period])
        per = {s: int(w * self.period) for s, w in weights.items()}
        blocks = {s: n // self.period * per[s] + rest[s] for s in per}
        rows = [
            (r.source, float(r.target_share or 0), int(r.max_repeats or 0), int(r.at_hand or 0), int(r.docs or 0), wanted.get(r.source, (0, 0))[1], float(wanted.get(r.source, (0, 0))[0]), max(1, blocks.get(r.source, 0)), max(1, per.get(r.source, 1)))
            for r in goals
        ]
        self.goals = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, at_hand long, docs long, wanted long, weight double, blocks long, per_period long")
        self.mixed = self._mix(sizes)

    def _mix(self, sizes: DataFrame) -> DataFrame:
        goals = F.broadcast(self.goals.filter("wanted > 0"))  # as many rows as there are sources in the target list
        d = sizes.filter(F.col("n_tokens") > 0).select("doc_id", "source", "n_tokens").join(goals, "source")
        d = d.withColumn("h", F.xxhash64(F.lit(self.seed), "doc_id"))
        buckets = F.ceil(F.col("docs") / BUCKET_DOCS)
        # equal ranges of the hash, so buckets are in the order of the hash
        d = d.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31)) * buckets).cast("long")).withColumn("h", F.shiftrightunsigned("h", 33))
        sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("ahead"))
        inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("run", F.sum("n_tokens").over(inside)).join(sums, ["source", "bucket"])
        d = d.withColumn("start", F.col("ahead") + F.col("run") - F.col("n_tokens"))
        passes = F.least(F.col("max_repeats").cast("long"), F.ceil(F.col("wanted") / F.col("at_hand")))
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
        d = d.withColumn("start", F.col("copy") * F.col("at_hand") + F.col("start"))
        # the last document stays if more than half of it fits
        d = d.filter(F.col("start") + F.col("n_tokens") / 2 <= F.col("wanted"))
        # a source's tokens over its own blocks, so each block is filled alike
        d = d.withColumn("block", F.least(F.floor(F.col("start") * F.col("blocks") / F.col("wanted")), F.col("blocks") - 1))
        d = d.withColumn("at", F.col("block") % F.col("per_period"))
        slots = F.broadcast(self.slots.withColumnRenamed("block", "at").withColumnRenamed("slot", "slot_at"))  # one period
        d = d.join(slots, ["source", "at"]).withColumn("slot", F.col("slot_at") + F.floor(F.col("block") / F.col("per_period")) * self.period)
        return d.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", "block", "slot", F.col("start").alias("source_offset"))

    @property
    def shares(self) -> DataFrame:
        """source, target_share, max_repeats, docs, at_hand, tokens, actual_share, copies, most_copies."""
        got = self.mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), (F.max("copy") + 1).alias("most_copies"))
        whole = got.agg(F.sum("tokens").alias("whole"))
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        return (
            self.goals.join(got, "source", "left").join(F.broadcast(whole), how="left")
            .select("source", "target_share", "max_repeats", "docs", "at_hand", z("tokens").alias("tokens"), F.when(F.col("whole") > 0, z("tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"), z("copies").alias("copies"), z("most_copies").alias("most_copies"))
        )


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> Mixture:
    """The mixture; sizes are written to the checkpoint folder first, as three jobs read them."""
    return Mixture(cut(sizes), targets, total, seed)
