"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmark.llm.common import stored

#: Bits of the order by which groups are first summed up, and by which a part of it is looked at more closely.
FIRST_BITS, MORE_BITS = 14, 6
#: Groups that are fetched one by one rather than looked at more closely once more. Rows numbered by one window.
FEW_GROUPS, CELL_ROWS = 50_000, 10_000


@dataclass(frozen=True)
class Atom:
    """A run of groups that follow each other: its place in the order, their bytes, number, and first key."""

    place: tuple[int, int, int]  # first key of the part, bits, number of giants before
    bytes: int
    n: int
    first: int


class Order:
    """All groups as runs, and what the greedy way does on them. Runs of over one group may be taken as indivisible
    (which the true greedy way is never behind) or as divisible at any byte (which it is never ahead of)."""

    def __init__(self, atoms: list[Atom], giants: set[int]):
        self.atoms, self.ends = sorted(atoms, key=lambda a: a.first), [0]
        for a in self.atoms:
            self.ends.append(self.ends[-1] + a.bytes)
        self.walls = sorted(x for i, a in enumerate(self.atoms) if a.n == 1 and a.first in giants for x in (self.ends[i], self.ends[i + 1]))
        self.giants = {self.ends[i]: self.ends[i + 1] for i, a in enumerate(self.atoms) if a.n == 1 and a.first in giants}

    def cuts(self, capacity: int, divisible: bool, most: int) -> list[int] | None:
        """The bytes before each shard after the first, and the total; None if there are over `most` shards."""
        at, found, total = 0, [], self.ends[-1]
        while at < total:
            if len(found) == most:
                return None
            if at in self.giants:
                at = self.giants[at]
            else:
                k = bisect_right(self.ends, at + capacity) - 1
                to = self.ends[k]
                if divisible and k < len(self.atoms) and self.atoms[k].n > 1:
                    to = at + capacity
                w = bisect_right(self.walls, at)
                to = min(to, self.walls[w]) if w < len(self.walls) else to
                if to <= at:
                    return None
                at = to
            found.append(at)
        return found

    def least(self, shards: int, divisible: bool, largest: int) -> int:
        """Binary search for the smallest feasible capacity, of `largest` or more."""
        low, high = largest, max(largest, self.ends[-1])
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, divisible, shards) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def open(self, low: int, high: int, shards: int) -> list[Atom]:
        """The runs of several groups in which a cut of the least capacity, between low and high, may lie."""
        near = self.cuts(low, False, len(self.atoms) + 1) or [a for a in self.ends if a]
        far, found = self.cuts(high, True, shards) or [], set()
        for k, to in enumerate(far):
            start = near[k] if k < len(near) else 0
            for i in range(max(0, bisect_right(self.ends, start) - 1), min(len(self.atoms), bisect_right(self.ends, to))):
                if self.atoms[i].n > 1:
                    found.add(i)
        return [self.atoms[i] for i in sorted(found)] or [a for a in self.atoms if a.n > 1]


def _giants(top: list, total: int, shards: int) -> set[int]:
    """Groups larger than a fair share of what larger ones leave, of the `shards` largest ones."""
    found, rest, left = set(), total, shards
    for r in top:
        if left > 1 and r.bytes * left > rest:
            found.add(r.h)
            rest, left = rest - r.bytes, left - 1
    return found


def _atoms(groups: DataFrame, bits: int, giants: set[int]) -> list[Atom]:
    """Sums of groups by the first bits of their key, parted at the giants: at most as many rows as there are parts."""
    before = sum((F.when(F.col("h") >= g, 1).otherwise(0) + F.when(F.col("h") > g, 1).otherwise(0) for g in sorted(giants)), F.lit(0))
    part = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    rows = groups.groupBy(part.alias("part"), before.alias("before")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("first")).collect()
    return [Atom((r.part, bits, r.before), r.bytes, r.n, r.first) for r in rows]


def _search(groups: DataFrame, shards: int, giants: set[int], largest: int) -> tuple[int, Order]:
    """The smallest feasible capacity, and the runs on whose ends the greedy way can cut with it.

    The capacity for indivisible runs is too large, that for divisible ones too small by at most a run. Where they
    differ, runs in which a cut may lie are looked at more closely, until they agree: what comes to the driver are
    sums of 2 ** FIRST_BITS runs and then of a few runs a shard, whatever the number of groups.
    """
    atoms = {a.place: a for a in _atoms(groups, FIRST_BITS, giants)}
    while True:
        order = Order(list(atoms.values()), giants)
        low, high = order.least(shards, True, largest), order.least(shards, False, largest)
        if low == high:
            return high, order
        closer = order.open(low, high, shards)
        for bits in {a.place[1] for a in closer}:
            own = [a for a in closer if a.place[1] == bits]
            more = 64 if sum(a.n for a in own) <= FEW_GROUPS else min(64, bits + MORE_BITS)
            asked = groups.sparkSession.createDataFrame([(a.place[0],) for a in own], "part long").distinct()
            parts = groups.join(F.broadcast(asked), F.shiftright("h", 64 - bits) == F.col("part"), "left_semi")
            known = {a.place[0] for a in own}
            for place in [p for p in atoms if p[1] == bits and p[0] in known]:
                del atoms[place]
            atoms.update({a.place: a for a in _atoms(parts, more, giants)})


def plan(groups: DataFrame, shards: int) -> list[int]:
    """groups(h, bytes) -> the keys at which a new shard begins, of `shards` - 1 at most.

    Groups lie in the order of h. The cuts are those of the greedy way with the smallest capacity for which it needs
    no more shards than there are. A group larger than a fair share has a shard to itself, at its place in the order,
    so that the others are as even as can be; unless that would make the largest shard larger. h names a group and has
    no nulls or repeats, as groups of rows have none. Equal sizes are told apart by h, groups without bytes stay where
    they lie, an empty table and a single shard have no cuts; other columns are left alone.
    """
    facts = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()
    if not facts.total or shards < 2:
        return []
    top = groups.orderBy(F.desc("bytes"), "h").limit(shards).collect()
    giants = _giants(top, facts.total, shards)
    fair = max((r.bytes for r in top if r.h not in giants), default=1)
    capacity, order = _search(groups, shards, giants, fair)
    if giants and capacity > facts.largest:
        plain, other = _search(groups, shards, set(), facts.largest)
        if plain < capacity:
            capacity, order = plain, other
    starts = dict(zip(order.ends, [a.first for a in order.atoms], strict=False))
    return [starts[x] for x in order.cuts(capacity, False, shards)[:-1]]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous shards of the ordered groups of equal texts, of least capacity.

    size is the text's UTF-8 bytes plus 16. Groups are ordered by the 64-bit hash of their text, which names them.
    Null texts count as empty ones and share their group; very long texts count whole. Null ids stay, repeated rows
    take a slot each, an empty table gives no rows; other columns of docs, of any name, are left alone. Slots of a
    shard run from 0 without a gap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.select("id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    own = stored(own, "sizes")
    groups = stored(own.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    cuts = plan(groups, shards)
    rows = groups.agg(F.sum("rows")).first()[0] or 0
    cells = F.lit(rows // (shards * CELL_ROWS) + 1)
    at = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = own.withColumn("shard", at).withColumn("cell", F.pmod(F.xxhash64("id", "size"), cells))  # hot groups spread
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "h"))
    numbered = placed.withColumn("place", place.cast("long")).join(counts, ["shard", "cell"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
