"""What a raw listing's fields say: kind of property, condominium, usable values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prumo.functions.text import fold, squeeze

#: Words for kinds of property (fixed values).
KIND_WORDS = {
    "apartamento": ("apartamento", "apto", "ap", "apartment", "flat", "kitnet", "cobertura", "studio", "loft"),
    "casa": ("casa", "sobrado", "house", "chacara", "duplex"),
    "lote": ("lote", "terreno", "land", "area"),
    "sala": ("sala", "conjunto comercial", "loja", "office", "galpao"),
}
#: Stand-ins for a missing text (fixed values), folded.
STAND_INS = ("nan", "null", "none", "n/d", "n/i", "n/a", "na", "nd", "ni", "s/b", "s/n", "s/e", "outro", "outros", "a definir", "xxx", "teste", "sem", "indefinido", "a confirmar", "desconhecido")
#: Beginnings of longer stand-ins: 'Sem bairro', 'Endereço sob consulta', 'Consulte o corretor.', 'Rua não informada'.
STAND_IN_PATTERN = r"^(sem (bairro|endereco|rua|descricao|informac.*|numero)|((endereco|bairro|rua|descricao|valor) )?(sob consulta|a (definir|confirmar|combinar|consultar))|.{0,12}\bnao (informad[oa]|disponivel|definid[oa]|consta).{0,3}|consulte.{0,25}|em breve.{0,3})\.?$"


def _kind_in(text: Column) -> Column:
    """The kind whose word stands first in a folded text."""
    word = F.regexp_extract(text, r"\b(" + "|".join(w for ws in KIND_WORDS.values() for w in ws) + r")\b", 1)
    return reduce(lambda c, k: c.when(word.isin(*KIND_WORDS[k]), k), KIND_WORDS, F.when(word == "", F.lit(None)))


def kind(titulo: Column, tipo: Column, url: Column, rooms: Column) -> Column:
    """apartamento, casa, lote or sala; null where nothing tells. The address of the advert tells first, then the title, then the type.

    The raw type Place holds lots and business rooms; rooms (bathrooms or parking told) then mark a business room.
    """
    slug = F.regexp_replace(F.regexp_extract(url, r"/(?:venda|aluguel|compra|lancamento)-([a-z]+)-", 1), "-", " ")
    place = F.when(fold(tipo) == "place", F.when(rooms.isNotNull(), "sala").otherwise("lote"))
    return F.coalesce(_kind_in(slug), _kind_in(fold(titulo)), _kind_in(fold(tipo)), place)


def in_condominium(kind_: Column, titulo: Column) -> Column:
    """Whether the property pays a condominium fee: flats and rooms do, houses where the title names a condominium, lots never."""
    return F.coalesce(kind_.isin("apartamento", "sala") | (kind_ == "casa") & fold(titulo).rlike(r"\bcond(\b|ominio)"), F.lit(True))


def is_stand_in(c: Column) -> Column:
    """Null, blank, without letter or digit, or a stand-in for a missing text."""
    t = squeeze(fold(c))
    return c.isNull() | ~F.coalesce(t.rlike("[a-z0-9]"), F.lit(False)) | t.isin(*STAND_INS) | t.rlike(STAND_IN_PATTERN)


def is_place_name(bairro: Column, cidade: Column) -> Column:
    """Whether the neighbourhood is a usable name: no stand-in, and not the city's name with or without the state."""
    t, city = squeeze(fold(bairro)), squeeze(fold(cidade))
    return ~is_stand_in(bairro) & F.coalesce(F.regexp_replace(t, r"\s*[-/,]\s*[a-z]{2}$", "") != city, F.lit(True)) & ~t.rlike(r"^goiania(\s*[-/,]?\s*go(ias)?)?$")
