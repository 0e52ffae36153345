"""Filling fixed-capacity containers with texts measured in tokens, by sum-of-squares online packing.

A packer knows its open containers only by how many stand at each fill level. An item goes where it makes the sum of the squared
counts smallest: putting size s on level h takes one container from h and adds one to h + s, so only those two counts change.
Packers work side by side, each on its share of the rows; a share ends with at most one open container a level.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe

#: Rows a packer takes: enough that the containers it leaves open are far below a hundredth of those it fills.
SHARE = 50_000
PLACED = "applies_to string, container long, piece int, place int, tokens int"


class SumOfSquares:
    """One packer. `level[h]` counts open containers filled up to h, `stacks[h]` names them; a full container leaves both."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("a container holds at least one token")
        self.capacity, self.opened = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int) -> tuple[int, int]:
        """The container and the place in it for an item of 1 to capacity tokens."""
        if size == self.capacity:
            self.opened += 1
            return self.opened - 1, 0
        top = self.capacity - size
        # change of the sum of squares for h = 1 .. top; an end at full capacity leaves the count
        gain = -2 * self.level[1 : top + 1] + 1
        gain[: top - 1] += 2 * self.level[1 + size : self.capacity] + 1
        gain[self.level[1 : top + 1] == 0] = np.iinfo(np.int64).max
        new = 2 * self.level[size] + 1
        # of equal changes the fullest container, so that fewer stay open
        best = top - 1 - int(np.argmin(gain[::-1]))
        if gain[best] <= new:
            held, h = self.stacks[best + 1].pop(), best + 1
            self.level[h] -= 1
        else:
            held, h = self.opened, 0
            self.opened += 1
        if h + size < self.capacity:
            self.level[h + size] += 1
            self.stacks[h + size].append(held)
        return held, h


def pack(sizes: Sequence[int], capacity: int, tighten: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, container, place, size) in the order of `sizes`.

    An item above the capacity is divided into full containers and one rest; nothing else is divided. An item without tokens
    takes no room and lies at the start of the packer's first container. With `tighten`, `close` repacks what is still open when all items are placed; without it every item
    stays where the sum of squares put it.
    """
    packer, out = SumOfSquares(capacity), []
    for item, size in enumerate(sizes):
        pieces = [capacity] * (size // capacity) + [size % capacity] * (size % capacity > 0)
        if not pieces:
            out.append((item, 0, 0, 0, 0))
        out += [(item, piece, *packer.put(n), n) for piece, n in enumerate(pieces)]
    return close(out, capacity) if tighten else out


def close(placed: list[tuple[int, int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Repacks the items of the containers that stayed open, largest first and each where it leaves least room, if that takes
    fewer containers. With no further item to come, there is no use in keeping levels balanced."""
    fill: dict[int, int] = {}
    for _, _, container, _, n in placed:
        fill[container] = fill.get(container, 0) + n
    still = sorted(c for c, n in fill.items() if n < capacity)
    loose = sorted((k for k, p in enumerate(placed) if p[4] and fill[p[2]] < capacity), key=lambda k: (-placed[k][4], k))
    room: list[tuple[int, int]] = []
    seats, used = {}, 0
    for k in loose:
        n = placed[k][4]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, c = room.pop(at)
        else:
            left, c, used = capacity, used, used + 1
        seats[k] = (c, capacity - left)
        if left > n:
            insort(room, (left - n, c))
    if used >= len(still):
        return placed
    # the containers keep consecutive numbers: the ones given up are filled from the end
    kept = [c for c in range(len(fill)) if c not in set(still)]
    names = {c: k for k, c in enumerate(kept)}
    return [(i, piece, len(kept) + seats[k][0], seats[k][1], n) if k in seats else (i, piece, names.get(c, 0), place, n) for k, (i, piece, c, place, n) in enumerate(placed)]


def shares(df: DataFrame, rows: int, key: str) -> tuple[Column, int]:
    """The packer of each row by the hash of its key, and how many packers the whole table needs."""
    count = max(1, -(-rows // SHARE))
    return F.pmod(F.xxhash64(key), F.lit(count)), count


def fill(sized: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "tokens", tighten: bool = True) -> DataFrame:
    """Packs every row once for each kind of container: kind, container, key, piece, place in it and tokens of the piece.

    Rows reach their packer by the hash of a key that is unique, so neither a source nor copies make one packer larger; the
    number of packers follows the number of rows. One shuffle, of key and size only. Within a packer items come in the order of
    another hash of the key, then key and size: as good as random, which suits the method best, and the same whatever the
    partitioning. Null sizes count as 0, rows with
    a null key are packed too, repeated rows are placed each for themselves, an empty table gives an empty one.
    """
    if not capacities:
        raise ValueError("no container given")
    narrow = sized.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("__size"), F.xxhash64(F.lit("order"), key).alias("__order"))
    share, count = shares(narrow, narrow.count(), key)
    kind = narrow.schema[key].dataType.simpleString()

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["__order", key, "__size"], kind="stable")
        owner, keys, frames = int(groups["__share"].iloc[0]), groups[key].to_numpy(), []
        for name, capacity in sorted(capacities.items()):
            placed = np.array(pack(groups["__size"].tolist(), capacity, tighten), np.int64).reshape(-1, 5)
            frames.append(pd.DataFrame({key: keys[placed[:, 0]], "applies_to": name, "container": placed[:, 2] * count + owner, "piece": placed[:, 1], "place": placed[:, 3], "tokens": placed[:, 4]}))
        return pd.concat(frames)

    return narrow.withColumn("__share", share).groupBy("__share").applyInPandas(run, f"`{key}` {kind}, {PLACED}")


def pack_documents(documents: DataFrame, limits: DataFrame, path: str = bpe.VOCABULARY, tighten: bool = True) -> DataFrame:
    """The texts of `documents` in the token containers of `limits` (a table that doesn't grow: a handful of rows reach the driver).

    Token counts are written once to the shared checkpoint folder, as both the number of packers and the packing need them.
    """
    from ..session import cut

    rows = limits.where(F.col("applies_to").startswith("container.") & (F.lower("unit") == "tokens") & F.col("max_size").isNotNull())
    capacities = {r.applies_to: int(r.max_size) for r in rows.select("applies_to", "max_size").distinct().collect()}
    return fill(cut(bpe.count_tokens(documents, path=path)), capacities, tighten=tighten)


def faults(placed: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """applies_to, capacity, items, and how many containers are overfull, places are not where the piece before ends, and items are
    divided though they fit: all of which must be 0. Containers are of bounded size, so no group is large."""
    rows = limits.where(F.col("applies_to").startswith("container.")).select("applies_to", F.col("max_size").alias("capacity"))
    rows = rows.groupBy("applies_to").agg(F.min("capacity").alias("capacity"))
    held = placed.join(rows, "applies_to")
    by = Window.partitionBy("applies_to", "container").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    gaps = held.where("tokens > 0").withColumn("__gap", F.col("place") != F.coalesce(F.sum("tokens").over(by), F.lit(0)))
    containers = gaps.groupBy("applies_to", "container").agg((F.sum("tokens") > F.max("capacity")).alias("__over"), F.count_if("__gap").alias("__gaps"))
    a = containers.groupBy("applies_to").agg(F.count_if("__over").alias("overfull"), F.sum("__gaps").alias("misplaced"))
    items = held.groupBy("applies_to", key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    b = items.groupBy("applies_to").agg(F.count(F.lit(1)).alias("items"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("c"))).alias("divided"))
    return rows.join(b, "applies_to").join(a, "applies_to", "left").select("applies_to", "capacity", "items", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("overfull", "misplaced", "divided")])
