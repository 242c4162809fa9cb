"""Which address records denote the same place: top-down matching through the hierarchy.

Records are read into region (city), neighbourhood, street and house number (or block and lot). Regions are linked first,
then the neighbourhoods within each region, the streets within each neighbourhood, and the numbers on each street; what
stands within the plot (flat, tower, room) is left out. A record without a region inherits the one that holds nearly all
records of its neighbourhood, else of its street, else of all; a record without a neighbourhood inherits the one in which
its street occurs. Where several are left, the record stays ambiguous and is matched to nothing.

Defined results: every record has a status: linked, inherited, ambiguous or incomplete (without street or number); null
and empty fields give no part; equal records are each matched; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.llm.address import base, has_syllables, place_key, read, region_pattern
from prumo.llm.names import link_names
from prumo.session import cut

#: Share of a street's records in one neighbourhood from which the street counts as that neighbourhood's alone; the rest
#: are slips in the neighbourhood's name.
SHARE = 0.9


#: A city is known if it is told by this share of the listings: 1000 names at most.
KNOWN_CITY = 0.001


def known_cities(df: DataFrame, city: str = "cidade") -> list[str]:
    """The cities told often enough to be looked for in addresses."""
    told = df.where(F.col(city).isNotNull()).groupBy(city).agg(F.count("*").alias("n"))
    return [r[0] for r in told.crossJoin(F.broadcast(told.agg(F.sum("n").alias("t")))).where(F.col("n") >= KNOWN_CITY * F.col("t")).select(city).collect()]


def read_addresses(df: DataFrame, key: str, address: str, place: str | None = None, region: str | None = None, cities: Iterable[str] = ()) -> DataFrame:
    """Rows (chave, regiao, lugar, rua, ponto, lugar_cheio, rua_cheia): the parts of an address column.

    place, region: columns with the neighbourhood and the city, else they are read from the address, with the help of the
    known cities. The fuller spellings keep the syllables that the normal form takes out.
    """
    flat = df.select(F.col(key), F.col(address), *([F.col(place)] if place else []), *([F.col(region)] if region else []))
    known = list(cities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = region_pattern(known)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [read(s, place is None, cities=pattern) for s in texts]
            full = [read(s, place is None, False, pattern) if has_syllables(s) else g for s, g in zip(texts, got)]
            if place:
                told = b.column(2).to_pylist()
                where, spelt = [place_key(s) for s in told], [place_key(s, False) for s in told]
            else:
                where, spelt = [g.place for g in got], [g.place for g in full]
            city = [base(c) or None if c else None for c in b.column(b.num_columns - 1).to_pylist()] if region else [g.region for g in got]
            parts = (city, where, [g.street for g in got], [g.spot for g in got], spelt, [g.street for g in full])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in parts)], names=["chave", "regiao", "lugar", "rua", "ponto", "lugar_cheio", "rua_cheia"])

    return flat.mapInArrow(run, f"chave {flat.schema[0].dataType.simpleString()}, regiao string, lugar string, rua string, ponto string, lugar_cheio string, rua_cheia string")


def counted_names(rows: DataFrame) -> DataFrame:
    """Different (regiao, lugar, rua) of rows with their number and a fuller spelling of each; without the column, regiao is empty."""
    fuller = lambda c: F.max(F.struct(F.length(c).alias("l"), F.col(c).alias("s")))["s"].alias(c)
    region = F.col("regiao") if "regiao" in rows.columns else F.lit("")
    return cut(rows.where("rua IS NOT NULL").groupBy(region.alias("regiao"), "lugar", "rua").agg(F.count("*").alias("n"), fuller("lugar_cheio"), fuller("rua_cheia")))


def _holder(rows: DataFrame, by: list[str], what: str, name: str) -> DataFrame:
    """Rows (by, name): the value of what that holds SHARE of the records, null if none does."""
    of = rows.groupBy(*by, what).agg(F.sum("n").alias("n"))
    most = F.when(F.max("n") >= SHARE * F.sum("n"), F.max_by(what, F.struct("n", what)))
    return of.groupBy(*by).agg(most.alias(name))


def in_regions(names: DataFrame) -> DataFrame:
    """counted_names() with r, the region each is in: linked or inherited; null if it is ambiguous."""
    links = link_names(names.where("regiao IS NOT NULL").select(F.lit("").alias("grupo"), F.col("regiao").alias("nome"), "n"))
    told = cut(names.join(links.select(F.col("nome").alias("regiao"), F.col("canonico").alias("r")), "regiao", "left"))
    known = told.where("r IS NOT NULL")
    by_place, by_street = (_holder(known.where(F.col(c).isNotNull()), [c], "r", f"r_{c}") for c in ("lugar", "rua"))
    everywhere = F.broadcast(_holder(known, [], "r", "r_todos"))
    lacking = told.where("r IS NULL").drop("r").join(by_place, "lugar", "left").join(by_street, "rua", "left").crossJoin(everywhere)
    found = lacking.withColumn("r", F.coalesce("r_lugar", "r_rua", "r_todos")).select(*told.columns)
    return cut(known.unionByName(found))


def resolve(names: DataFrame) -> DataFrame:
    """Rows (regiao, lugar, rua, regiao_c, lugar_c, rua_c, situacao) for counted_names(): linked, inherited or ambiguous.

    The levels are linked from the top down: regions, neighbourhoods within the region, streets within the neighbourhood.
    Streets without a neighbourhood are linked among all streets of the region, and inherit the neighbourhood that holds
    SHARE of the street's records.
    """
    named = names.where("regiao <> ''").isEmpty()
    names = names.withColumn("r", F.lit("")) if named else in_regions(names)
    lost = names.where("r IS NULL").select("regiao", "lugar", "rua", *(F.lit(None).cast("string").alias(c) for c in ("regiao_c", "lugar_c", "rua_c")), F.lit("ambiguous").alias("situacao"))
    group = F.col("r").alias("grupo")
    placed = names.where("lugar IS NOT NULL AND r IS NOT NULL")
    places = link_names(placed.select(group, F.col("lugar").alias("nome"), "n", F.col("lugar_cheio").alias("cheio")))
    placed = cut(placed.join(places.select(F.col("grupo").alias("r"), F.col("nome").alias("lugar"), F.col("canonico").alias("lugar_c")), ["r", "lugar"]))
    within = F.concat_ws("|", "r", "lugar_c")
    streets = link_names(placed.select(within.alias("grupo"), F.col("rua").alias("nome"), "n", F.col("rua_cheia").alias("cheio")))
    placed = placed.withColumn("grupo", within).join(streets.select("grupo", F.col("nome").alias("rua"), F.col("canonico").alias("rua_c")), ["grupo", "rua"])
    placed = cut(placed.select("regiao", "r", "lugar", "rua", "lugar_c", "rua_c", "n", "rua_cheia"))
    pairs = placed.groupBy("r", "rua_c", "lugar_c").agg(F.sum("n").alias("n"), F.max(F.when(F.col("rua") == F.col("rua_c"), F.col("rua_cheia"))).alias("cheio"))
    known = pairs.groupBy("r", "rua_c").agg(F.max_by("lugar_c", F.struct("n", "lugar_c")).alias("a"), (F.max("n") >= SHARE * F.sum("n")).alias("um"), F.sum("n").alias("n"), F.max("cheio").alias("cheio"))
    bare = names.where("lugar IS NULL AND r IS NOT NULL").select("regiao", "r", "rua", "n", "rua_cheia")
    # slips among streets without neighbourhood weigh less than any street that has one
    both = known.select(group, F.col("rua_c").alias("nome"), (F.col("n") + 1_000_000_000_000).alias("n"), "cheio").unionByName(bare.select(group, F.col("rua").alias("nome"), "n", F.col("rua_cheia").alias("cheio")))
    linked = bare.select("regiao", "r", "rua").distinct().join(link_names(both).select(F.col("grupo").alias("r"), F.col("nome").alias("rua"), "canonico"), ["r", "rua"])
    direct = known.select("r", F.col("rua_c").alias("rua"), F.lit(True).alias("certo"))
    linked = linked.join(direct, ["r", "rua"], "left").select("regiao", "r", "rua", F.when(F.col("certo"), F.col("rua")).otherwise(F.col("canonico")).alias("rua_c"))
    found = linked.join(known.select("r", "rua_c", "a", "um"), ["r", "rua_c"])
    out = ["regiao", "lugar", "rua", F.col("r").alias("regiao_c"), "lugar_c", "rua_c", "situacao"]
    inherited = found.withColumn("lugar", F.lit(None).cast("string")).withColumn("lugar_c", F.when(F.col("um"), F.col("a"))).withColumn("situacao", F.when(F.col("um"), "inherited").otherwise("ambiguous"))
    return cut(placed.withColumn("situacao", F.lit("linked")).select(*out).unionByName(inherited.select(*out)).unionByName(lost))


def located(side: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (chave, regiao_c, lugar_c, rua_c, ponto, situacao) of all records of read_addresses(), by the links of resolve()."""
    at = side.select("chave", "regiao", "lugar", "rua", "ponto").distinct().alias("s")
    hit = at.join(links.alias("l"), (F.col("s.rua") == F.col("l.rua")) & F.col("s.lugar").eqNullSafe(F.col("l.lugar")) & F.col("s.regiao").eqNullSafe(F.col("l.regiao")), "left")
    status = F.when(F.col("s.rua").isNull() | F.col("ponto").isNull(), "incomplete").otherwise(F.coalesce("situacao", F.lit("ambiguous")))
    return hit.select("chave", "regiao_c", "lugar_c", "rua_c", "ponto", status.alias("situacao"))


def linked_sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """located() of both sides, linked together."""
    told = ["regiao", "lugar", "rua", "lugar_cheio", "rua_cheia"]
    links = resolve(counted_names(left.select(*told).unionByName(right.select(*told))))
    return located(left, links), located(right, links)


def same_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (esquerda, direita): keys of records of both sides (read_addresses()) that denote one place."""
    at = ["regiao_c", "lugar_c", "rua_c", "ponto"]
    a, b = (x.where("situacao IN ('linked', 'inherited')").select(F.col("chave").alias(name), *at).distinct() for x, name in zip(linked_sides(left, right), ("esquerda", "direita")))
    return a.join(b, at).select("esquerda", "direita").distinct()


def listing_addresses(df: DataFrame) -> DataFrame:
    """Addresses of listings over all their scrapes; a scrape without a usable neighbourhood takes the one that most scrapes of its listing tell."""
    from prumo.functions.listing import is_place_name

    named = F.when(is_place_name(F.col("bairro"), F.col("cidade")), F.col("bairro"))
    parts = cut(read_addresses(df.select("id", "rua", named.alias("bairro"), "cidade").distinct(), "id", "rua", "bairro", "cidade"))
    told = parts.where("lugar IS NOT NULL").groupBy("chave", "lugar").agg(F.count("*").alias("n"), F.max("lugar_cheio").alias("lugar_cheio"))
    usual = told.groupBy("chave").agg(F.max(F.struct("n", "lugar", "lugar_cheio")).alias("u"))
    own = F.col("lugar").isNotNull()
    full = parts.where("rua IS NOT NULL").join(usual, "chave", "left")
    out = full.select("chave", "regiao", F.when(own, F.col("lugar")).otherwise(F.col("u.lugar")).alias("lugar"), "rua", "ponto", F.when(own, F.col("lugar_cheio")).otherwise(F.col("u.lugar_cheio")).alias("lugar_cheio"), "rua_cheia")
    return out.distinct()
