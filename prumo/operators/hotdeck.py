"""Filling missing values from similar records: a sequential hot deck in SQL.

Records are sorted within groups of similar records; a missing cell takes the value of the nearest observed record
before or after it, the donor, and the distance to the donor in the sort key is kept. Groups are tried from narrow to
wide; every cell keeps its status: observed, filled, filled_unsorted, no_donor or not_applicable.

The sorted records are cut into ranges of about block_rows rows each, so that no group is one task's work: each range of
a group is filled by its own window, and the last and first donors of whole ranges are carried over by a window over one
row per range. There are as many ranges as the rows need. The result is the same as that of one window over the group.

Defined results: unusable values (by the rule of the field) count as missing and are never donors; a cell whose rule
says it does not apply stays as it is with the status not_applicable; of two donors equally near the one before wins;
ties in the sort key are ordered by a hash of the record's key, then by the key. A record without sort key is never a
donor; its own cells take the donor nearest to a place drawn by its key's hash from the places of DRAWS records, with the
status filled_unsorted and no distance.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.session import cut


@dataclass
class Target:
    """A column to fill: when its value is usable, when the column applies, and its groups from narrow to wide."""

    column: str
    usable: Column
    applies: Column = field(default_factory=lambda: F.lit(True))


#: Records from whose sort keys a place is drawn for those without one: the first by a hash of their keys.
DRAWS = 256


def hot_deck(df: DataFrame, key: list[str], targets: list[Target], groups: list[list[Column]], order: Column, block_rows: int = 50_000) -> DataFrame:
    """df with, per target c, the columns c_preenchido, c_distancia and c_status; columns of these names are replaced.

    groups: lists of grouping expressions from narrow to wide; order: numeric sort key of similarity.
    """
    names = [t.column for t in targets]
    hashed = F.xxhash64(*key)
    told = F.when(F.abs(order.cast("double")) < float("inf"), order.cast("double"))
    draws = [r[0] for r in df.select(told.alias("o"), hashed.alias("h")).where("o IS NOT NULL").orderBy("h", "o").limit(DRAWS).select("o").collect()]
    drawn = F.element_at(F.from_json(F.lit(json.dumps(draws)), "array<double>"), (F.pmod(hashed, F.lit(len(draws))) + 1).cast("int")) if draws else F.lit(0.0)
    work = df.withColumn("__ord", told)
    work = work.withColumn("__k", F.coalesce("__ord", drawn) + (hashed % F.lit(1 << 20) + F.lit(1 << 20)) / F.lit(float(1 << 21)) * 1e-6)
    for i, t in enumerate(targets):
        work = work.withColumn(f"__use{i}", F.coalesce(t.usable, F.lit(False))).withColumn(f"__app{i}", F.coalesce(t.applies, F.lit(False)))
    work = work.withColumns({f"__g{p}_{i}": F.coalesce(e.cast("string"), F.lit("")) for p, group in enumerate(groups) for i, e in enumerate(group)})
    donor = {i: F.when(F.col(f"__use{i}") & F.col(f"__app{i}") & F.col("__ord").isNotNull(), F.struct(F.col(c).alias("v"), F.col("__ord").alias("o"))) for i, c in enumerate(names)}
    keys = [[f"__g{p}_{i}" for i in range(len(group))] for p, group in enumerate(groups)]
    blocks = -(-df.count() // block_rows)
    if blocks > 1:
        # the ranges of all passes are made first, since donors do not depend on what is filled; written, so that they stay
        for p, g in enumerate(keys):
            work = cut(work.repartitionByRange(blocks, *g, "__k", *key).withColumn(f"__b{p}", F.spark_partition_id()))
    else:
        work = work.withColumns({f"__b{p}": F.lit(0) for p in range(len(keys))})
    carried = [_carried(work, g, f"__b{p}", key, donor) if blocks > 1 else None for p, g in enumerate(keys)]
    for i, t in enumerate(targets):
        work = work.withColumn(f"__fill{i}", F.lit(None).cast(df.schema[t.column].dataType)).withColumn(f"__dist{i}", F.lit(None).cast("double"))
    for p, g in enumerate(keys):
        work = _one_pass(work, [*g, f"__b{p}"], key, donor, carried[p])
    made = [f"{c}{s}" for c in names for s in ("_preenchido", "_distancia", "_status")]
    out = [c for c in df.columns if c not in made]
    for i, c in enumerate(names):
        miss = F.col(f"__app{i}") & ~F.col(f"__use{i}")
        filled = F.when(F.col("__ord").isNull(), "filled_unsorted").otherwise("filled")
        status = F.when(~F.col(f"__app{i}"), "not_applicable").when(F.col(f"__use{i}"), "observed").when(F.col(f"__fill{i}").isNotNull(), filled).otherwise("no_donor")
        work = work.withColumn(f"{c}_status", status).withColumn(f"{c}_preenchido", F.when(miss, F.col(f"__fill{i}")).otherwise(F.col(c))).withColumn(f"{c}_distancia", F.when(miss, F.col(f"__dist{i}")))
    return work.select(*out, *made)


def _carried(ranged: DataFrame, g: list[str], block: str, key: list[str], donor: dict[int, Column]) -> DataFrame:
    """Rows (g, block, __in{i}, __out{i}): for each range of the groups that lie in several, the donors before and after it."""
    groups = F.struct(*g)
    ends = ranged.groupBy(block).agg(F.min(groups).alias("a"), F.max(groups).alias("z")).select(block, F.explode(F.array_distinct(F.array("a", "z"))).alias("g"))
    wide = cut(ends.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g.*"))  # at most one per range
    pos = F.struct("__k", *key)
    last = [F.max_by(d, F.when(d.isNotNull(), pos)).alias(f"__last{i}") for i, d in donor.items()]
    first = [F.min_by(d, F.when(d.isNotNull(), pos)).alias(f"__first{i}") for i, d in donor.items()]
    at = ranged.join(wide, g).groupBy(*g, block).agg(*last, *first)
    before, after = (Window.partitionBy(*g).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(block), F.desc(block)))
    return cut(at.select(*g, block, *(F.last(f"__last{i}", True).over(before).alias(f"__in{i}") for i in donor), *(F.last(f"__first{i}", True).over(after).alias(f"__out{i}") for i in donor)))


def _one_pass(work: DataFrame, g: list[str], key: list[str], donor: dict[int, Column], carried: DataFrame | None) -> DataFrame:
    """Fill what is still missing from donors of the same group; g: the group and its range."""
    if carried is not None:
        work = work.join(carried, g, "left")
    else:
        work = work.withColumns({f"__{s}{i}": F.lit(None) for i in donor for s in ("in", "out")})
    w = Window.partitionBy(*g).orderBy("__k", *key)
    # a frame to the end would be computed anew for each row; the same rows before it in the opposite order are not
    back = Window.partitionBy(*g).orderBy(F.desc("__k"), *(F.desc(c) for c in key))
    prev, nxt = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, back))
    for i in donor:
        work = work.withColumn(f"__d{i}", donor[i])
    work = work.select("*", *(F.coalesce(F.last(f"__d{i}", True).over(prev), F.col(f"__in{i}")).alias(f"__p{i}") for i in donor), *(F.coalesce(F.last(f"__d{i}", True).over(nxt), F.col(f"__out{i}")).alias(f"__q{i}") for i in donor))
    for i in donor:
        # the place of a record without sort key serves to choose the donor, not as a distance
        a, b = (F.abs(F.coalesce("__ord", "__k") - F.col(f"__{s}{i}.o")) for s in "pq")
        first = F.col(f"__q{i}").isNull() | (a <= b)
        open_ = F.col(f"__fill{i}").isNull() & F.col(f"__app{i}") & ~F.col(f"__use{i}")
        far = F.when(F.col("__ord").isNotNull(), F.when(first, a).otherwise(b))
        work = work.withColumn(f"__dist{i}", F.when(open_, far).otherwise(F.col(f"__dist{i}")))
        work = work.withColumn(f"__fill{i}", F.when(open_, F.when(first, F.col(f"__p{i}.v")).otherwise(F.col(f"__q{i}.v"))).otherwise(F.col(f"__fill{i}")))
    return work.drop(*g, *(f"__{s}{i}" for i in donor for s in ("in", "out", "p", "q", "d")))
