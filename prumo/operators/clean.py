"""Cleaning and feature extraction of raw listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.functions.text import first_word, title_number
from prumo.schema import UNUSED, narrow

#: Raw kinds of property and their names (fixed values); all others become null.
KINDS = {"House": "casa", "Apartment": "apartamento", "Place": "outro"}
#: First words of titles and the kind they tell (fixed values), for listings of the kind 'outro'.
TITLE_KINDS = {"Casa": "casa", "Apartamento": "apartamento", "Flat": "flat", "Cobertura": "cobertura", "Sobrado": "sobrado", "Studio": "studio"}

#: Amenity groups and their terms (fixed values). Terms are substrings, upper and lower case tell.
AMENITIES: dict[str, tuple[str, ...]] = {
    "piscina": ("Pool", "Adult Pool", "Childrens Pool", "Heated Pool", "Private Pool", "Covered Pool", "Semi Olympic Pool", "Reflecting Pool", "Pool Bar"),
    "espaco_gourmet": ("Barbecue Grill", "Barbecue Balcony", "Pizza Oven", "Gourmet Space", "Gourmet Balcony", "Gourmet Kitchen"),
    "academia": ("Gym", "Fitness Room"),
    "spa_massagem": ("Sauna", "Spa", "Whirlpool", "Hot Tub", "Massage Room"),
    "espaco_lazer": ("Party Hall", "Adult Game Room", "Games Room", "Cinema", "Bar", "Coffee Shop", "Restaurant", "Covention Hall", "Zen Space"),
    "area_trabalho": ("Coworking", "Meeting Room", "Library"),
    "espaco_infantil": ("Playground", "Toys Place", "Sand Pit", "Teen Space"),
    "area_esportiva": ("Sports Court", "Tennis Court", "Football Field", "Indoor Soccer", "Squash", "Skate Lane", "Hiking Trail", "Golf Field"),
    "portaria": ("Gated Community", "Concierge 24h", "Reception"),
    "seguranca": ("Watchman", "Patrol", "Alarm System", "Safety Circuit", "Electronic Gate", "Intercom", "Security Camera", "Security Cabin", "Armored Security Cabin", "Fence", "Security 24 Hours"),
    "servicos_garagem": ("Garage", "Parking", "Guest Parking", "Valet Parking", "Bicycles Place"),
    "acessibilidade": ("Elevator", "Disabled Access"),
    "pets": ("Pets Allowed", "Pet Space"),
    "varanda": ("Balcony", "Wall Balcony", "Deck"),
    "area_verde": ("Garden", "Backyard", "Green Space", "Grass", "Fruit Trees", "Pomar", "Vegetable Garden", "Tree Climbing"),
    "espaco_natural": ("Exterior View", "Lake", "River", "Lake View", "Mountain View", "Sea View", "Panoramic View"),
    "acabamento_premium": ("Porcelain", "Blindex Box", "Sanca", "Aluminum Window", "Laminated Floor", "Wood Floor", "Vinyl Floor", "Carpet", "Drywall", "Glass Wall", "Thermal Insulation", "Cold Floor", "Burnt Cement", "Platibanda"),
    "moveis_embutidos": ("Planned Furniture", "Builtin Wardrobe", "Bedroom Wardrobe", "Bathroom Cabinets", "Kitchen Cabinets", "Closet", "Dress Room2"),
    "layout_premium": ("Lavabo", "Reversible Room", "Dividers", "Integrated Environments", "Large Room", "Small Room", "High Ceiling Height"),
    "cozinha": ("Kitchen", "American Kitchen", "Large Kitchen", "Pantry", "Copa", "Dinner Room", "Lunch Room"),
    "servicos": ("Laundry", "Service Area", "Service Bathroom", "Service Room", "Employee Dependency", "Service Entrance"),
    "conforto_interno": ("Air Conditioning", "Heating", "Natural Ventilation", "Soundproofing", "Large Window"),
    "mobiliado": ("Furnished",),
    "casa_inteligente": ("Smart Apartment", "Smart Condominium", "Digital Locker"),
    "servicos_conectividade": ("Internet Access", "Cable Tv", "Full Cabling"),
    "infra_energetica": ("Solar Energy", "Electric Generator", "Eletric Charger"),
    "infra_hidrica": ("Water Tank", "Artesian Well", "Well"),
    "servicos_sustentaveis": ("Eco Garbage Collector", "Eco Condominium"),
}


def recode(c: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """c by a table of names; null, or default, for what the table lacks."""
    out = reduce(lambda w, k: w.when(c == k, names[k]), names, F.when(F.lit(False), F.lit(None).cast("string")))
    return out if default is None else out.otherwise(default)


def drop_unused(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns no later step uses; missing ones are ignored."""
    return df.drop(*(names or UNUSED))


def with_target(df: DataFrame, target: str = "preco") -> DataFrame:
    """Rows that have the target."""
    return df.dropna(subset=[target])


def rename_kinds(df: DataFrame) -> DataFrame:
    """Raw kinds by their names, null for any other."""
    return df.withColumn("tipo_imovel", recode(F.col("tipo_imovel"), KINDS))


def coherence(df: DataFrame) -> DataFrame:
    """One row: share in percent of numbers told in titles that equal the listing's field, over four fields pooled.

    A null field is a wrong one; the share is null if no title tells any number.
    """
    pairs = [(title_number(F.col("titulo"), unit), F.col(c).cast("double")) for c, unit in (("quartos", "quarto[s]"), ("banheiros", "banheiro[s]"), ("vagas", "vaga[s]"), ("area_m2", "m²"))]
    told = reduce(lambda a, b: a + b, (F.count(t) for t, _ in pairs))
    right = reduce(lambda a, b: a + b, (F.count(F.when(t == v, 1)) for t, v in pairs))
    return df.agg(right.alias("certos"), told.alias("informados")).withColumn("coherence_pct", 100.0 * F.col("certos") / F.nullif("informados", F.lit(0)))


def clean(df: DataFrame) -> DataFrame:
    """Copies, unused columns and rows without target dropped, kinds renamed, whole numbers narrowed."""
    return df.transform(lambda d: d.dropDuplicates()).transform(drop_unused).transform(with_target).transform(rename_kinds).transform(narrow)


def amenity_flags(df: DataFrame, source: str = "comodidades", exact: bool = False) -> DataFrame:
    """A flag per amenity group in one projection: whether any of its terms stands in the text, false for null.

    exact compares whole entries of the comma-separated text instead of substrings.
    """
    if exact:
        entries = F.transform(F.split(F.coalesce(F.col(source), F.lit("")), ","), lambda x: F.trim(x))
        flags = {k: F.arrays_overlap(entries, F.array(*map(F.lit, v))) for k, v in AMENITIES.items()}
    else:
        flags = {k: F.coalesce(F.col(source).rlike("|".join(v)), F.lit(False)) for k, v in AMENITIES.items()}
    return df.withColumns(flags)


def pets_allowed(df: DataFrame) -> DataFrame:
    """The flag pets also where the listing says so itself; null counts as false."""
    return df.withColumn("pets", F.coalesce("pets", F.lit(False)) | F.coalesce(F.col("aceita_pets").cast("boolean"), F.lit(False)))


def kind_from_title(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Listings of the kind 'outro' by the first word of their title, 'outro' where it tells nothing."""
    told = recode(first_word(F.col("titulo")), names or TITLE_KINDS, F.lit("outro"))
    return df.withColumn("tipo_imovel", F.when(F.col("tipo_imovel") == "outro", F.coalesce(told, F.lit("outro"))).otherwise(F.col("tipo_imovel")))


def extract(df: DataFrame) -> DataFrame:
    """Amenity flags, pets, kinds from titles; the columns they come from are dropped."""
    return df.transform(amenity_flags).transform(pets_allowed).transform(kind_from_title).drop("aceita_pets", "comodidades", "titulo").transform(narrow)
