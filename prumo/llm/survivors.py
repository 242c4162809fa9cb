"""The best representative of each group of duplicate records, field by field.

Method: the different values of a field in a group are ranked by completeness, trust (a readable date of change) and
recency by a window with a deterministic tie-break, and the top one is kept. A value is incomplete if it is a stand-in for
a missing one or holds only part of what another value of the group gives: a text broken off, fewer of the same photos, a
street without its number.

Equal values of a group are combined before the shuffle, with their latest scrape. A text broken off stands, in the order
of the texts, right before one that goes on: one look at the next text finds it (groups are split by the texts' heads). A set of photos is compared with those
that hold its rarest photo only. No pairs within a group are made.

Defined results: fields whose values are all equal give no row, nor do fields without any complete value; null and blank
values are incomplete; unreadable dates of change rank below all readable ones; of values seen in the same scrape the
longer, then the alphabetically first survives; null ids are left out; copies of a row change nothing; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.functions.listing import is_place_name, is_stand_in
from prumo.functions.text import fold, squeeze
from prumo.llm.address import read
from prumo.operators.packed import split_anchored
from prumo.session import cut

FIELDS = ("descricao_completa", "fotos_urls", "rua", "bairro")
#: Marks of a text broken off (fixed values).
CUT_MARKS = r"(?i)(\s*(\.\.\.|…|\[(\.\.\.|…)\]|\[?\(?(ver|leia|ler|veja|read|saiba) (mais|more)\)?\]?|\(?continua\)?))+\s*$"
#: Letters of a text by which large groups are split.
HEAD = 16
#: Names of pictures that stand in for photos (fixed values).
_NO_PHOTO = re.compile(r"/(?:no-?image|sem-?(?:foto|imagem)|foto-em-breve|em-breve|placeholder|default|indisponivel|not-?found)[^/]*$", re.I)


def day(c: Column) -> Column:
    """The day of an ISO date or time; null where unreadable."""
    t = F.trim(c)
    return F.coalesce(F.substring(t, 1, 10).try_cast("date"), F.when(t.rlike(r"^\d{8}(\D|$)"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date")))


def distinct_values(raw: DataFrame) -> DataFrame:
    """Rows (id, campo, valor, cidade, dia, scraped_at): the different values of each field that has several, each with its latest scrape."""
    rows = raw.where("id IS NOT NULL").select("id", "scraped_at", day(F.col("data_modificacao")).alias("dia"), "cidade", *FIELDS)
    code = {f: F.xxhash64(F.coalesce(f, F.lit("\x00"))) for f in FIELDS}
    spread = rows.groupBy("id").agg(*(x for f in FIELDS for x in (F.min(code[f]).alias(f"a_{f}"), F.max(code[f]).alias(f"b_{f}"))))
    told = F.filter(F.array(*(F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull())
    several = spread.select(F.col("id"), told.alias("campos")).where(F.size("campos") > 0)
    value = F.coalesce(*(F.when(F.col("campo") == f, F.struct(F.col(f).alias("v"))) for f in FIELDS))["v"]
    cells = rows.join(several, "id").select("*", F.explode("campos").alias("campo")).select("id", "campo", "scraped_at", "dia", "cidade", value.alias("valor"))
    latest = F.struct(F.col("dia").isNotNull().alias("legivel"), "dia", F.col("scraped_at").try_cast("timestamp").alias("quando"), "scraped_at")
    return cells.groupBy("id", "campo", "valor").agg(F.max(latest).alias("l"), F.max("cidade").alias("cidade"))


def parts(values: DataFrame) -> DataFrame:
    """values with tem_ponto (a street field tells its number) and fotos (the real photos of a photo field)."""

    flat = values.select("id", "campo", "valor", "l", "cidade")
    names = flat.columns
    at = names.index("campo"), names.index("valor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot: list[bool | None] = []
            photos: list[list[str] | None] = []
            for f, v in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                spot.append(read(v).spot is not None if f == "rua" else None)
                photos.append(sorted({p for p in split_anchored(v) if not _NO_PHOTO.search(p) and p.startswith("http")}) if f == "fotos_urls" and v else [] if f == "fotos_urls" else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spot, pa.bool_()), pa.array(photos, pa.list_(pa.string()))], names=[*names, "tem_ponto", "fotos"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    return flat.mapInArrow(run, f"{kinds}, tem_ponto boolean, fotos array<string>")


def contained(photos: DataFrame) -> DataFrame:
    """Rows (id, valor) of the photo fields whose photos are all, and not all there are, in another value of the id."""
    one = photos.select("id", "fotos").distinct().select("id", "fotos", F.explode("fotos").alias("foto"))
    often = one.groupBy("id", "foto").agg(F.count("*").alias("n"))
    rarest = one.join(often, ["id", "foto"]).groupBy("id", F.col("fotos").alias("menos")).agg(F.min(F.struct("n", "foto"))["foto"].alias("foto"))
    wider = one.select("id", "foto", F.col("fotos").alias("mais"))
    hit = rarest.join(wider, ["id", "foto"]).where((F.size("mais") > F.size("menos")) & (F.size(F.array_except("menos", "mais")) == 0))
    return photos.join(hit.select("id", F.col("menos").alias("fotos")).distinct(), ["id", "fotos"]).select("id", "valor").distinct()


def broken_off(texts: DataFrame) -> DataFrame:
    """The rows (id, campo, nucleo) of different texts that another text of their group goes on from.

    In the order of the texts, a text stands right before one that begins with it. Texts of HEAD letters or more are
    sorted among those with the same head only, so a large group is not one task's work; shorter ones are looked up among
    the beginnings of the group's texts, which are made only in groups that have short ones.
    """
    keys = ["id", "campo"]
    head = F.substring("nucleo", 1, HEAD)
    ahead = F.lead("nucleo").over(Window.partitionBy(*keys, head).orderBy("nucleo"))
    long = texts.where(F.length("nucleo") >= HEAD).select(*keys, "nucleo", ahead.alias("seguinte")).where("startswith(seguinte, nucleo)").select(*keys, "nucleo")
    short = texts.where(F.length("nucleo") < HEAD)
    begins = texts.join(short.select(*keys).distinct(), keys, "left_semi").where(F.length("nucleo") > 1)
    begins = begins.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("nucleo") - 1, F.lit(HEAD - 1))), lambda n: F.substring("nucleo", 1, n))).alias("nucleo")).distinct()
    return long.unionByName(short.join(begins, [*keys, "nucleo"], "left_semi"))


def survivors(raw: DataFrame) -> DataFrame:
    """Rows (id, campo, scraped_at, valor): per field with several values, the scrape and value that survive."""
    values = parts(distinct_values(raw))
    # the marks of a break are looked for once; a text may be broken off inside a tag, so they go first
    v = values.withColumn("aparado", F.regexp_replace("valor", CUT_MARKS, ""))
    text = F.regexp_replace("aparado", r"(?i)<br\s*/?>|</?(p|b|i|strong)>|<[a-z/]*\s*$", " ")
    core = F.when(F.col("campo") == "descricao_completa", squeeze(text)).otherwise(squeeze(fold(F.col("aparado"))))
    v = v.withColumn("nucleo", F.coalesce(core, F.lit("")))
    street_only = F.col("nucleo").rlike(r"^(rua|r|av|avenida|aven|alameda|al|travessa|trav|tv|praca|pca)\.?$")
    missing = F.when(F.col("campo") == "bairro", ~is_place_name(F.col("valor"), F.col("cidade"))).when(F.col("campo") == "fotos_urls", F.size("fotos") == 0).when(F.col("campo") == "rua", is_stand_in(F.col("valor")) | street_only).otherwise(is_stand_in(F.col("valor")) | (F.col("nucleo") == ""))
    values = v = cut(v.withColumn("falta", F.coalesce(missing, F.lit(True))).drop("aparado"))
    v = v.join(broken_off(v.where("NOT falta AND nucleo <> ''").select("id", "campo", "nucleo").distinct()).withColumn("quebrado", F.lit(True)), ["id", "campo", "nucleo"], "left")
    fewer = contained(values.where("campo = 'fotos_urls' AND size(fotos) > 0")).select("id", F.col("valor").alias("valor"), F.lit("fotos_urls").alias("campo"), F.lit(True).alias("menos_fotos"))
    v = v.join(fewer, ["id", "campo", "valor"], "left")
    # counted by an aggregate, not a window: a listing's values need not meet in one task for it
    numbered = values.where("campo = 'rua' AND tem_ponto").select("id", F.lit("rua").alias("campo"), F.lit(True).alias("numerada")).distinct()
    v = v.join(numbered, ["id", "campo"], "left").withColumn("sem_numero", F.col("numerada").isNotNull() & ~F.coalesce("tem_ponto", F.lit(False)))
    whole = ~F.col("falta") & F.col("quebrado").isNull() & F.col("menos_fotos").isNull() & ~F.col("sem_numero")
    rank = Window.partitionBy("id", "campo").orderBy(F.col("l").desc(), F.length("valor").desc(), "valor")
    return v.where(whole).withColumn("posto", F.row_number().over(rank)).where("posto = 1").select("id", "campo", F.col("l.scraped_at").alias("scraped_at"), "valor")
