"""Misspelt names linked to the name they stand for, without comparing all pairs.

Two names that differ by one letter dropped, added, changed or swapped share a string that is left after deleting one
letter. Every such string elects the most frequent name that leaves it; every name goes to the most frequent of those
that its own strings elected. Work and shuffle are linear in the letters of the distinct names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.session import cut


def _tail(c: Column) -> Column:
    """A last word that tells names apart: a Roman numeral, a point of the compass, a single letter."""
    return F.regexp_extract(c, r" (i{1,3}|iv|vi{0,3}|ix|x|norte|sul|leste|oeste|[a-z])$", 1)


def link_names(names: DataFrame, least_letters: int = 4) -> DataFrame:
    """Rows (grupo, nome, canonico) for rows (grupo, nome, n[, cheio]): the name that each name stands for within its group.

    cheio is a fuller spelling of the name, if there is one; slips are looked for in both. Names with digits or fewer than
    least_letters letters, and names without a more frequent neighbour, stand for themselves; names of up to five letters
    (in their fuller spelling) need a neighbour five times as frequent. Of two equally frequent neighbours the
    alphabetically first stands. Names that are told apart by their last word (III, Sul) are never linked.
    """
    full = F.max(F.struct(F.length("cheio").alias("l"), F.col("cheio").alias("s")))["s"] if "cheio" in names.columns else F.lit(None).cast("string")
    own = names.groupBy("grupo", "nome").agg(F.sum("n").alias("n"), full.alias("cheio"))
    fuzzy = own.where(F.length("nome") >= least_letters).where(~F.col("nome").rlike("[0-9]"))
    short = "array_append(transform(sequence(1, length({0})), i -> concat(substr({0}, 1, i - 1), substr({0}, i + 1))), {0})"
    both = F.when(F.col("cheio").isNull() | (F.col("cheio") == F.col("nome")), F.expr(f"array_distinct({short.format('nome')})")).otherwise(F.expr(f"array_union({short.format('nome')}, {short.format('cheio')})"))
    left = fuzzy.select("grupo", "nome", "n", F.explode(both).alias("resto"), _tail(F.col("nome")).alias("fim"), F.greatest(F.length("nome"), F.length("cheio")).alias("letras"))
    # larger n first, then the alphabetically first name
    rank = F.struct(F.col("n").alias("n"), F.translate("nome", "abcdefghijklmnopqrstuvwxyz ", "zyxwvutsrqponmlkjihgfedcba~").alias("inv"), F.col("nome").alias("nome"))
    # names that leave one string differ in two letters at most, so a string's names are few: about 27 times its length
    elected = F.max(rank).over(Window.partitionBy("grupo", "resto", "fim"))
    near = left.withColumn("eleito", elected).where(F.col("eleito") > rank).where((F.col("letras") > 5) | (F.col("eleito.n") >= 5 * F.col("n")))
    step = cut(near.groupBy("grupo", "nome").agg(F.max("eleito").alias("e")).select("grupo", "nome", F.col("e.nome").alias("alvo")))
    # a slip of a slip: one more step
    onward = step.select("grupo", F.col("nome").alias("alvo"), F.col("alvo").alias("alem"))
    links = step.join(onward, ["grupo", "alvo"], "left").select("grupo", "nome", F.coalesce("alem", "alvo").alias("canonico"))
    return own.select("grupo", "nome").join(links, ["grupo", "nome"], "left").select("grupo", "nome", F.coalesce("canonico", "nome").alias("canonico"))
