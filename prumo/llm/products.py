"""Listings of the same property told by different agents.

Method: title combination voting. Titles are stripped of what describes rather than names (sizes, counts, kinds, places);
the pairs and triples of the name words left are combinations that every title votes for. A combination's score grows with
the titles that share it and with its length, and falls with its average position, the gaps between its words and the
neighbourhoods it stands in; each title is assigned to its best combination. Misspelt combinations are linked to the frequent one they stand for,
misspelt neighbourhoods too. A name common to properties of many neighbourhoods is split by them; a phrase is spread like the listings themselves.
Clusters are merged where a shorter combination stands inside a longer one, or where they share a street and number, and
verified: same kind, bedrooms, size up to rounding and price within a few percent. A property without a name is known by
street and number alone.

Verification sorts the different (bedrooms, size, price) of a cluster and cuts where a gap is too wide: no pairs are
compared. Equal listings are one row there, so copies of a listing cost nothing.

Defined results: a null or absurd price, and unknown bedrooms or size, decide nothing: such a listing joins the only group
it agrees with, and none if there are several; those of one size that agree with no group form their own, but those without
size never do; listings without name and address join no group; null ids are left out; repeated rows count once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.functions.listing import is_place_name, kind
from prumo.functions.text import fold_py
from prumo.llm.address import has_syllables, place_key, read
from prumo.llm.names import link_names
from prumo.llm.places import counted_names, resolve
from prumo.session import cut

#: Sizes of one property differ by at most the sum of this in m² and this share (agents round and convert them differently);
#: prices by at most this share.
AREA_GAP, AREA_SHARE, PRICE_SHARE = 0.6, 0.02, 0.08
#: Prices outside are absurd for a sale.
PRICE_RANGE = (20_000.0, 500_000_000.0)
#: A combination in more linked neighbourhoods than this, each weighed by its share of the listings, names another property in
#: each of them; one that is spread over this share of what all listings are spread over is a phrase.
MOST_PLACES, PHRASE_SHARE = 3, 0.5

_NUMBERS = {"um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10}
_COUNT = r"(\d+|" + "|".join(_NUMBERS) + r")\s*"
_ROOMS = re.compile(rf"\b{_COUNT}(?:quartos?|qtos?|qts?|qt|dorms?|dormitorios?|q)\b|\b(\d+)/4\b")
_AREA = re.compile(r"\b(\d+(?:\.\d{3})*(?:,\d+)?|\d+\.\d+)\s*(m2|mts|mt|m|metros(?: quadrados)?|ha|hectares?)\b")
_DESCRIBES = re.compile(
    rf"\bem [^,]+, goiania.*$|,? ?-? ?goiania\s*[-/,]\s*go\b|\b\d+(?:[.,]\d+)*\s*(?:m2|mts|mt|metros(?: quadrados)?|ha|hectares?)\b|\b{_COUNT}(?:quartos?|qtos?|qts?|qt|dorms?|dormitorios?|q|suites?|banheiros?|wc|bwc|vagas?|vgs?|vg)\b"
    r"|\bgaragem(?: \d+ carros?)?|\b\d+/4\b|\b(?:apartamento|apto|ap|casa terrea|sobrado|sala comercial|conjunto comercial|lote|terreno|flat|kitnet|cobertura)\b|^(?:casa|sala)\b|\b(?:casa|sala)$|\ba venda\b"
    r"|\b(?:edificio|ed|condominio|cond|fechado|horizontal|resid|res|centro empresarial|empresarial)\b\.?"
)
#: Marketing phrases (fixed values); others are told from names by standing in many neighbourhoods.
_PRAISE = re.compile(r"\b(?:oportunidade|imperdivel|aceita (?:permuta|financiamento)|documentacao ok|agende sua visita|venha conhecer|vista livre|sol da manha|pronto para morar|otima localizacao|abaixo da tabela|ultima unidade|exclusividade|alto padrao|lindo|novinho|reformado|destaque)\b!?")
_PLACE = re.compile(r"\b(?:setor|set|st|jardim|jard|jd|vila|vl|conjunto|conj|cj|parque|pque|prq|pq|chacara|chac|ch|bairro|s|v)\b\.? \w+(?: (?:norte|sul|leste|oeste|i{1,3}|iv)\b)?")
_UNIT = r"(?!\s*(?:m2|mts|mt|m|metros|ha|quartos?|qtos?|qts?|qt|dorms?|dormitorios?|q|suites?|banheiros?|wc|vagas?|vgs?|vg)\b|[.,/]\d)"
_SPOT = (
    r"(?:[\s,-]*\b(?:quadra|qdra|qd|q)[\s.:-]*\d+[\s,-]*(?:lote|lt|l)[\s.:-]*\d+\b|[\s,-]*\b(?:lote|lt|l)[\s.:-]*\d+[\s,-]*(?:quadra|qdra|qd|q)[\s.:-]*\d+\b"
    rf"|[\s,.-]*\b(?:numero|num|nro|no|n)[\s.:]*\d+\b{_UNIT}|\s*,\s*\d+\b{_UNIT}|(?:(?<=[a-z]{{3}})|(?<=\d)) - \d+\b{_UNIT})"
)
#: A street with its number or block and lot, in a folded title.
_STREET = re.compile(rf"\b(?:rua|r|avenida|aven|av|alameda|alam|al|travessa|trav|tv|tr|praca|pca|pc)\b\.? [^|,]{{1,60}}?{_SPOT}")
_SMALL = frozenset("de da do dos das e a o com na no em para por residencial iii ii iv norte sul leste oeste".split())


def _near(a: str, b: str) -> bool:
    """At most one letter dropped, added, changed or swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


_PLACE_TOLD = re.compile(r"\bem ([^,|]+), goiania\b")


def place_told(title: str) -> str | None:
    """The neighbourhood in a folded title without its street."""
    m = _PLACE_TOLD.search(title)
    if not m and (m := _PLACE.search(title)):
        return m[0]
    return m[1].rpartition(" em ")[2] if m else None


def rooms_told(title: str) -> int | None:
    """Bedrooms in a folded title without its street."""
    m = _ROOMS.search(title)
    n = None if not m else int(m[2]) if m[2] else _NUMBERS.get(m[1]) or int(m[1])
    return n if n and n <= 50 else None


def area_told(title: str) -> float | None:
    """Square metres in a folded title."""
    m = _AREA.search(title)
    if m:
        n = m[1]
        v = float(n.replace(".", "").replace(",", ".")) if "," in n or re.fullmatch(r"\d+(\.\d{3})+", n) else float(n)
        v = v * 10_000 if m[2].startswith("h") else v
        if 5 <= v <= 1e7:
            return v
    return None


def name_words(title: str, place: str | None) -> list[str]:
    """The words of a folded title without its street that may name the property."""
    t = _PLACE.sub(" | ", _PRAISE.sub(" | ", _DESCRIBES.sub(" | ", title)))
    own = [fold for fold in (place or "").split() if len(fold) > 3]
    return [w for w in re.findall(r"[a-z]{2,}", t) if w not in _SMALL and not any(_near(w, p) for p in own)]


def _tail_name(rua: str | None) -> str:
    m = re.search(r"\b(?:ed|edificio|cond|condominio|res|resid)\b\.? ([a-z ]+)$", fold_py(rua or ""))
    return m[1] if m else ""


def combinations(words: list[str]) -> dict[str, float]:
    """Pairs and triples of near words, in the order of the title, with gap and position as a penalty."""
    out: dict[str, float] = {}
    n = len(words)
    for i in range(n):
        for j in range(i + 1, min(n, i + 3)):
            out.setdefault(f"{words[i]} {words[j]}", (j - i - 1) + 0.1 * i / (n + 1))
            if j == i + 1 and j + 1 < n:
                out.setdefault(f"{words[i]} {words[j]} {words[j + 1]}", 0.1 * i / (n + 1))
    return out


def listing_facts(raw: DataFrame) -> DataFrame:
    """One row per listing: kind, bedrooms, size, price, address and name words, over all its scrapes."""
    named = is_place_name(F.col("bairro"), F.col("cidade"))
    what = kind(F.col("titulo"), F.col("tipo_imovel"), F.col("url"), F.coalesce("banheiros", "vagas"))
    seen = F.struct((F.col("rua").rlike("[0-9]")).cast("int"), F.length("rua"), F.col("rua"))
    one = (
        raw.where("id IS NOT NULL")
        .groupBy("id")
        .agg(
            F.max("titulo").alias("titulo"), F.max(what).alias("tipo"), F.max(F.regexp_extract("url", r"-(\d+)m2-", 1).try_cast("double")).alias("area_url"), F.max(F.when(F.col("preco").between(*PRICE_RANGE), F.col("preco"))).alias("preco"),
            F.max(F.when(F.col("area_m2").between(5.0, 1e7), F.col("area_m2"))).alias("area"), F.max(F.when(F.col("quartos").between(1, 50), F.col("quartos"))).alias("quartos"),
            F.max(F.when(named, F.col("bairro"))).alias("bairro"), F.max(seen)["rua"].alias("rua"),
        )
    )
    flat = one.select("id", "tipo", "titulo", "area_url", "rua", "bairro", "quartos", "area", "preco")

    fields = flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(fields)}
            out: dict[str, list] = {k: [] for k in ("id", "tipo", "lugar", "rua", "ponto", "dita", "quartos", "area", "preco", "combos", "pesos", "lugar_cheio", "rua_cheia")}
            for i, title in enumerate(cols["titulo"]):
                t = " ".join(fold_py((title or "").replace("–", "-")).split())
                s = _STREET.search(t)
                told = read(s[0]) if s else None
                by_street = bool(told and told.spot and told.street)
                a = told if by_street else read(cols["rua"][i])
                if s:
                    t = f"{t[: s.start()]} | {t[s.end() :]}"
                bairro = cols["bairro"][i] or place_told(t)
                combos = {} if by_street else combinations(name_words(t, fold_py(bairro or "")))
                if not by_street and (tail := _tail_name(cols["rua"][i])):
                    for c, w in combinations(tail.split()).items():
                        combos.setdefault(c, w)
                rooms, area = cols["quartos"][i], cols["area"][i]
                area = area if area is not None else area_told(t)
                row = (
                    cols["id"][i], cols["tipo"][i], place_key(bairro), a.street, a.spot, by_street, rooms if rooms is not None else rooms_told(t),
                    area if area is not None else cols["area_url"][i], cols["preco"][i], list(combos), list(combos.values()),
                    place_key(bairro, False), (read(s[0] if by_street else cols["rua"][i], cut=False).street if has_syllables(s[0] if by_street else cols["rua"][i]) else a.street),
                )
                for k, v in zip(out, row):
                    out[k].append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return flat.mapInArrow(run, "id string, tipo string, lugar string, rua string, ponto string, dita boolean, quartos int, area double, preco double, combos array<string>, pesos array<double>, lugar_cheio string, rua_cheia string")


def linked_places(facts: DataFrame) -> DataFrame:
    """Rows (lugar, lugar_c): each neighbourhood of the listings with the one whose name it misspells."""
    names = facts.where("lugar IS NOT NULL").groupBy("lugar").agg(F.count("*").alias("n"), F.max(F.struct(F.length("lugar_cheio").alias("l"), F.col("lugar_cheio").alias("s")))["s"].alias("cheio"))
    return cut(link_names(names.select(F.lit("").alias("grupo"), F.col("lugar").alias("nome"), "n", "cheio")).select(F.col("nome").alias("lugar"), F.col("canonico").alias("lugar_c")))


def _weighed(n: Column) -> Column:
    """The number of neighbourhoods, each weighed by its share: that of equally large ones with the same sum of squared shares."""
    return F.pow(F.sum(n), 2) / F.sum(n * n)


def best_combination(facts: DataFrame) -> DataFrame:
    """Rows (id, nome): the combination each title is assigned to, the shorter one where one stands inside the other."""
    facts = facts.join(linked_places(facts), "lugar", "left")
    votes = cut(facts.select("id", "lugar_c", F.explode(F.arrays_zip("combos", "pesos")).alias("c")).select("id", "lugar_c", F.col("c.combos").alias("combo"), F.col("c.pesos").alias("peso")))
    count = cut(votes.groupBy("combo", "lugar_c").agg(F.count("*").alias("n")))
    # misspelt words are linked, and with them the combinations
    word = count.groupBy("combo").agg(F.sum("n").alias("n")).select("combo", "n", F.posexplode(F.split("combo", " ")).alias("i", "palavra"))
    links = link_names(word.select(F.lit("").alias("grupo"), F.col("palavra").alias("nome"), "n")).where("nome <> canonico")
    changed = word.join(links.select(F.col("nome").alias("palavra"), "canonico"), "palavra").groupBy("combo").agg(F.map_from_entries(F.collect_list(F.struct("i", "canonico"))).alias("troca"))
    swapped = F.concat_ws(" ", F.transform(F.split("combo", " "), lambda w, i: F.coalesce(F.try_element_at("troca", i), w)))
    names = cut(count.join(changed, "combo", "left").select("combo", "lugar_c", "n", F.coalesce(F.when(F.col("troca").isNotNull(), swapped), "combo").alias("nome")))
    at = names.groupBy("nome", "lugar_c").agg(F.sum("n").alias("n"))
    placed = F.when(F.col("lugar_c").isNotNull(), F.col("n").cast("double"))
    spread = at.groupBy("nome").agg(F.sum("n").alias("todos"), F.coalesce(_weighed(placed), F.lit(1.0)).alias("lugares"))
    usual = facts.where("lugar_c IS NOT NULL").groupBy("lugar_c").agg(F.count("*").cast("double").alias("n")).agg(_weighed(F.col("n")).alias("geral"))
    # one name, or one in each neighbourhood (onde), or a phrase
    many = F.col("lugares") > MOST_PLACES
    judged = spread.where("todos > 1").crossJoin(F.broadcast(usual)).where(~many | (F.col("lugares") < PHRASE_SHARE * F.col("geral"))).drop("geral")
    onde = F.when(many, F.col("lugar_c")).otherwise("")
    total = at.join(judged, "nome").withColumn("onde", onde).where("onde IS NOT NULL").groupBy("nome", "onde").agg(F.sum("n").alias("n"), F.first("lugares").alias("lugares"))
    total = cut(total.where("n > 1"))
    split = names.select("combo", "nome").distinct().join(total, "nome")
    scored = votes.join(split, "combo").where((F.col("onde") == "") | (F.col("onde") == F.col("lugar_c")))
    length = F.size(F.split("nome", " "))
    score = F.log2(F.col("n") + 1.0) * (1 + 0.1 * length) / (1 + F.col("peso")) / F.pow(F.greatest("lugares", F.lit(1.0)), 2)
    best = cut(scored.groupBy("id").agg(F.max(F.struct(F.round(score, 9).alias("s"), "n", "nome", "onde")).alias("m")).select("id", F.col("m.nome").alias("nome"), F.col("m.onde").alias("onde")))
    # merge: a triple goes to the more frequent of the pairs inside it
    pair = F.split("nome", " ")
    inner = F.explode(F.array(F.concat_ws(" ", pair[0], pair[1]), F.concat_ws(" ", pair[1], pair[2]))).alias("par")
    triples = best.select("nome", "onde").distinct().where(F.size(pair) == 3)
    inside = triples.select("nome", "onde", inner).join(total.select(F.col("nome").alias("par"), "onde", "n"), ["par", "onde"]).groupBy("nome", "onde").agg(F.max(F.struct("n", "par"))["par"].alias("par"))
    full = F.concat(F.coalesce("par", "nome"), F.when(F.col("onde") == "", "").otherwise(F.concat(F.lit("@"), "onde")))
    return best.join(inside, ["nome", "onde"], "left").select("id", full.alias("nome"))


def _steps(new: Column, over: Window) -> Column:
    return F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(over)


def verified_groups(keyed: DataFrame) -> DataFrame:
    """Rows (id, grupo) of listings (id, chave, tipo, quartos, area, preco) that agree within their cluster."""
    own = ["chave", "tipo", "quartos", "area", "preco"]
    told = keyed.select(*own).distinct()
    by_area = Window.partitionBy("chave", "tipo").orderBy(F.col("area").asc_nulls_last())
    gap = F.col("area") - F.lag("area").over(by_area)
    told = told.withColumn("novo", gap > F.col("area") * AREA_SHARE + AREA_GAP).withColumn("faixa", _steps(F.col("novo") | F.col("area").isNull(), by_area.rowsBetween(Window.unboundedPreceding, 0)))
    sure = (F.col("preco").isNotNull()) & F.col("area").isNotNull() & (F.col("quartos").isNotNull() | F.col("tipo").isin("lote", "sala"))
    told = told.withColumn("certo", sure).withColumn("q", F.coalesce("quartos", F.lit(0)))
    by_price = Window.partitionBy("chave", "tipo", "faixa", "q", "certo").orderBy("preco")
    jump = F.col("preco") > F.lag("preco").over(by_price) * (1 + PRICE_SHARE)
    told = told.withColumn("salto", jump).withColumn("nivel", _steps(F.col("salto"), by_price.rowsBetween(Window.unboundedPreceding, 0)))
    told = cut(told.select(*own, "faixa", "q", "nivel", "certo"))
    group = F.concat_ws("|", "chave", F.coalesce("tipo", F.lit("")), "faixa", "q", "nivel")
    fixed = told.where("certo").withColumn("grupo", group)
    sums = fixed.groupBy("grupo", "chave", "tipo", "faixa", "q").agg(F.min("preco").alias("de"), F.max("preco").alias("ate"))
    # those that leave something open join the only sure group they agree with
    open_ = told.where("NOT certo").select(*own, "faixa")
    s = sums.select(F.col("chave").alias("c"), F.col("tipo").alias("t"), F.col("faixa").alias("f"), "q", "de", "ate", "grupo")
    agrees = (open_.chave == s.c) & open_.tipo.eqNullSafe(s.t) & (F.col("area").isNull() | (F.col("faixa") == F.col("f")))
    within = F.col("preco").between(F.col("de") / (1 + PRICE_SHARE), F.col("ate") * (1 + PRICE_SHARE))
    fits = (F.col("quartos").isNull() | (F.col("quartos") == F.col("q"))) & (F.col("preco").isNull() | within)
    only = [F.min("grupo").alias("grupo"), F.max("grupo").alias("outro")]
    found = cut(open_.join(s, agrees & fits, "left").groupBy(*own, "faixa").agg(*only))
    hits = found.where("grupo = outro").select(*own, "grupo")
    # open ones that agree with none form groups of their own: one where bedrooms and prices told at this size contradict
    # nothing, else one for each price level and each number of bedrooms
    rest = found.where("grupo IS NULL AND area IS NOT NULL").select(*own, "faixa")
    at = Window.partitionBy("chave", "tipo", "faixa")
    leap = F.col("preco") > F.lag("preco").over(at.orderBy("preco")) * (1 + PRICE_SHARE)
    rest = rest.withColumn("salto", leap).withColumn("nivel", _steps(F.col("salto"), at.orderBy("preco").rowsBetween(Window.unboundedPreceding, 0)))
    one = (F.max("nivel").over(at) == 0) & F.coalesce(F.min("quartos").over(at) == F.max("quartos").over(at), F.lit(True))
    part = F.when(one, "").when(F.col("preco").isNotNull(), F.concat(F.lit("p"), "nivel")).when(F.col("quartos").isNotNull(), F.concat(F.lit("q"), "quartos"))
    rest = cut(rest.withColumn("parte", part).where("parte IS NOT NULL").withColumn("grupo", F.concat_ws("|", "chave", F.coalesce("tipo", F.lit("")), "faixa", F.lit("?"), "parte")).select(*own, "grupo"))
    # one without size joins the only such group, if it tells nothing that the group leaves open
    loose = found.where("grupo IS NULL AND area IS NULL").select(*own)
    r = rest.groupBy("grupo", F.col("chave").alias("c"), F.col("tipo").alias("t")).agg(F.max("quartos").alias("q"), F.min("preco").alias("de"), F.max("preco").alias("ate"))
    told_there = (F.col("quartos").isNull() | (F.col("quartos") == F.col("q"))) & (F.col("preco").isNull() | within)
    late = loose.join(r, (loose.chave == r.c) & loose.tipo.eqNullSafe(r.t) & told_there).groupBy(*own).agg(*only).where("grupo = outro").drop("outro")
    mapped = fixed.select(*own, "grupo").unionByName(hits).unionByName(rest).unionByName(late)
    same = [keyed[c].eqNullSafe(mapped[c]) if c != "chave" else keyed[c] == mapped[c] for c in own]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return keyed.join(mapped, on).select("id", "grupo")


def same_property(raw: DataFrame) -> DataFrame:
    """Rows (id, grupo) of the listings of raw that share their property with others."""
    facts = cut(listing_facts(raw))
    names = best_combination(facts.select("id", "lugar", "lugar_cheio", "combos", "pesos"))
    links = resolve(counted_names(facts))
    at = facts.drop("combos", "pesos").alias("f").join(links.alias("l"), (F.col("f.rua") == F.col("l.rua")) & F.col("f.lugar").eqNullSafe(F.col("l.lugar")), "left")
    address = F.when(F.col("ponto").isNotNull() & F.col("lugar_c").isNotNull(), F.concat_ws("/", "lugar_c", "rua_c", "ponto"))
    at = at.select("id", "tipo", "quartos", "area", "preco", "dita", address.alias("endereco"))
    at = cut(at.join(names, "id", "left").select("*", F.col("nome").isNotNull().alias("tem_nome")))
    # the name most often told at an address stands for the address where a listing tells none
    usual = at.where("tem_nome AND endereco IS NOT NULL").groupBy("endereco", "nome").agg(F.count("*").alias("n")).groupBy("endereco").agg(F.max(F.struct("n", "nome"))["nome"].alias("usual"))
    at = at.join(usual, "endereco", "left")
    key = F.when(F.col("tem_nome"), F.concat(F.lit("n:"), "nome")).when(F.col("usual").isNotNull() & ~F.col("dita"), F.concat(F.lit("n:"), "usual")).when(F.col("endereco").isNotNull(), F.concat(F.lit("a:"), "endereco"))
    keyed = cut(at.withColumn("chave", key).where("chave IS NOT NULL").select("id", "chave", "tipo", "quartos", "area", "preco"))
    return verified_groups(keyed)


def pairs(groups: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of each group, id_a < id_b; the equi-join's hot groups are split by adaptive execution."""
    g = cut(groups.select("id", "grupo").distinct())
    a, b = g.select(F.col("id").alias("id_a"), "grupo"), g.select(F.col("id").alias("id_b"), "grupo")
    return a.join(b, "grupo").where("id_a < id_b").select("id_a", "id_b").distinct()
