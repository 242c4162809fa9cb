"""Filling fixed-capacity containers with items.

Method: bounded-space online best-fit. A packer keeps at most OPEN open containers in a bitset keyed by free space; an
item goes to the container with the least free space that still holds it, found by one shift and the lowest set bit; if
none holds it, a new one is opened, and beyond OPEN the fullest is closed first. Items are dealt to shards by a hash of
their key, in number proportional to the total size, and each shard is packed by one packer in the order of the keys; a
packer's memory is its open containers, whatever the shard's size.

Defined results: an item above the capacity is cut into full containers and a rest that is packed like an item, and no
other item is split; items of size 0 or null take part with size 0; rows with equal keys are items of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.session import cut

OPEN = 64
#: Containers' worth of items per shard: the open containers a packer leaves part-filled are few among them.
SHARD_CONTAINERS = 2000


class Packer:
    """Best-fit over a bounded number of open containers."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0
        self.free: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _take(self, space: int) -> int:
        at = self.free[space]
        box = at.pop()
        if not at:
            self.bits ^= 1 << space
        self.open -= 1
        return box

    def _keep(self, box: int, space: int) -> None:
        if space:  # a full container is closed at once
            self.free.setdefault(space, []).append(box)
            self.bits |= 1 << space
            self.open += 1

    def put(self, size: int) -> int:
        """The container of the next item (0 <= size <= capacity)."""
        fitting = self.bits >> max(size, 1)
        if fitting:
            space = max(size, 1) + (fitting & -fitting).bit_length() - 1
            box = self._take(space)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            box, space = self.made, self.capacity
            self.made += 1
        self._keep(box, space - size)
        return box

    def full(self) -> int:
        """A container of its own for a piece as large as the capacity."""
        self.made += 1
        return self.made - 1


def pack(items: DataFrame, key: str, size: str, capacity: int, most_open: int = OPEN, shard_containers: int = SHARD_CONTAINERS) -> DataFrame:
    """Rows (key, parte, inicio, tamanho, recipiente): where each item, or each part of a too large one, goes.

    recipiente numbers the containers: shard * 2**40 + number in the shard. The same items give the same containers.
    """
    flat = cut(items.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("tamanho")))
    total = flat.agg(F.sum("tamanho")).first()[0] or 0
    shards = max(1, round(total / (capacity * shard_containers)))
    dealt = flat.withColumn("lote", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(shards, 100_000), "lote").sortWithinPartitions("lote", key, "tamanho")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (lot, n) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist())):
                if lot != shard:
                    shard, packer = lot, Packer(capacity, most_open)
                part = at = 0
                while n - at > capacity:
                    part += 1
                    rows.append((i, part, at, capacity, (lot << 40) + packer.full()))
                    at += capacity
                rows.append((i, part + 1, at, n - at, (lot << 40) + packer.put(n - at)))
            if rows:
                i, part, at, n, box = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(part, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(box, pa.int64())], names=[key, "parte", "inicio", "tamanho", "recipiente"])

    return dealt.mapInArrow(run, f"`{key}` {flat.schema[0].dataType.simpleString()}, parte int, inicio long, tamanho long, recipiente long")
