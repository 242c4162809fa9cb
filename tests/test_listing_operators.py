"""Hand-written edge rows of the listing operators."""

from conftest import rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from prumo.functions.cast import safe_int, safe_str
from prumo.functions.listing import is_place_name, is_stand_in, kind
from prumo.functions.text import contains_normalized, neighbourhood_told, normalize_text, parking_told, title_number
from prumo.operators import clean as cl
from prumo.operators import dedup as dd
from prumo.operators import enrich as en
from prumo.operators import stats as st
from prumo.schema import LISTING_SCHEMA
from prumo.sources import files, pages, store


def one(spark, value, expr, kind_="string"):
    return spark.createDataFrame([(value,)], f"x {kind_}").select(expr(F.col("x")).alias("y")).first().y


def test_keep_best(spark):
    cols = "id string, rua string, bairro string, tipo_imovel string, area_m2 string, preco double, quartos int, banheiros int, vagas int, fotos_urls string, descricao_completa string"
    data = [
        ("1", "Rua T-30", "Setor Bueno", "Apartment", "75.4", 500000.0, 3, 2, 1, "u1,u2", "abc"), ("2", " rua t-30 ", None, "Apartment", "74.6", 500000.4, 3, 2, 1, "u1,u2,u3", "abcdef"),
        ("3", None, "Setor Oeste", "House", "120", 900000.0, 4, 3, 2, None, "x"), ("4", None, "SETOR OESTE", "House", "120", 900000.0, 4, 3, 2, "u1", None),
        ("5", "Rua X", None, "Place", "n/d", 300000.0, None, None, None, None, None), ("6", "Rua Y", "B", "Place", "2.5", 100000.0, 1, 1, 0, None, "k"),
        ("7", "Rua Y", "B", "Place", "1.5", 100000.0, 1, 1, 0, None, "k"), ("8", "Rua Y", "B", "Place", "3.5", 100000.0, 1, 1, 0, None, "k"),
    ]
    df = spark.createDataFrame(data, cols)
    kept = dd.keep_best(df)
    assert sorted(r.id for r in kept.collect()) == ["1", "4", "5", "6", "8"]
    assert rows(dd.keep_best(kept)) == rows(kept)
    assert rows(dd.dedup_counts(df)) == [(8, 3, 5)]
    assert dd.keep_best(df.limit(0)).count() == 0


def test_titles(spark):
    t = "Apartamento com 3 quartos, 2 banheiros, 1 vaga e 75 m² em Setor Bueno, Goiânia - GO"
    assert one(spark, t, parking_told) == 1 and one(spark, t, neighbourhood_told) == "Setor Bueno"
    assert [one(spark, t, lambda c, u=u: title_number(c, u)) for u in ("quarto[s]", "banheiro[s]", "vaga[s]", "m²")] == [3, 2, None, 75]
    assert one(spark, "Casa com garagem em Setor Sul, GO", neighbourhood_told) == "em Setor Sul"
    t = "Sobrado com 1 quarto e 4 VAGAS em Jardim América, GOIÂNIA"
    assert (one(spark, t, parking_told), one(spark, t, neighbourhood_told), one(spark, t, lambda c: title_number(c, "quarto[s]"))) == (4, "Jardim América", None)
    assert one(spark, "Lote", parking_told) is None and one(spark, None, neighbourhood_told) is None


def test_normalize_text(spark):
    for a, b in (
        ("Av. T-9, Setor Bueno", "avenida t 9, setor bueno"), ("R. das Flores nº 12, Jardim Goiás", "rua s flores no 12, jardim goias"), ("Pq. Amazônia", "parque amazonia"), ("QD. 3 ½ da Cidade", "quadra 3 12 ci"),
        ("  Rua São José ² ", "rua sao jose 2"), ("Alameda dos Buritis", "alame s buritis"), ("", ""), (None, ""), ("œuvre ﬁm", "uvre fim"),
    ):
        assert one(spark, a, normalize_text) == b, a
    assert one(spark, "Rua Goiânia", lambda c: contains_normalized(c, F.lit("GOIANIA"))) is True


def test_amenities(spark):
    df = cl.amenity_flags(spark.createDataFrame([("Barbecue Grill, Gourmet Space", None), ("Pool, Pet Space", None), ("pool", True), (None, None)], "comodidades string, aceita_pets boolean"))
    pick = lambda d: [tuple(r) for r in d.select("piscina", "espaco_gourmet", "spa_massagem", "espaco_lazer", "pets").collect()]
    assert pick(df) == [(False, True, True, True, False), (True, False, True, False, True), (False,) * 5, (False,) * 5]
    assert [r.pets for r in cl.pets_allowed(df).collect()] == [False, True, True, False]
    exact = cl.amenity_flags(df.select("comodidades", "aceita_pets"), exact=True)
    assert [r.spa_massagem for r in exact.collect()] == [False] * 4
    assert len(cl.AMENITIES) == 28


def test_kinds_and_casts(spark):
    df = spark.createDataFrame([("Flat x", "outro"), ("Flat x", "casa"), ("  ", "outro"), (None, "outro"), ("Nada", None)], "titulo string, tipo_imovel string")
    assert [r.tipo_imovel for r in cl.kind_from_title(df).collect()] == ["flat", "casa", "outro", "outro", None]
    assert [one(spark, v, safe_int) for v in ("2.9", "-2.9", "x", None)] == [2, -2, None, None]
    assert [one(spark, v, safe_str) for v in ("  ", " a ", None, " b\t")] == [None, "a", None, "b"]
    assert all(one(spark, v, is_stand_in) for v in (None, "", " ", "-", "?", "nan", "N/D", "Não informado", "NÃO INFORMADO", "Endereço sob consulta", "Sem descrição", "Consulte o corretor.", "...", "a definir", "Rua não informada", "sem endereço"))
    assert not any(one(spark, v, is_stand_in) for v in ("Setor Sul", "Rua T-9", "Casa ampla", "Nanuque"))
    assert [one(spark, v, lambda c: is_place_name(c, F.lit("Goiânia"))) for v in ("Goiânia", "GOIÂNIA - GO", "Setor Goiânia", None, "Outros")] == [False, False, True, False, False]
    k = lambda t, tipo, url, r=None: spark.createDataFrame([(t, tipo, url, r)], "t string, k string, u string, r int").select(kind(F.col("t"), F.col("k"), F.col("u"), F.col("r"))).first()[0]
    assert k("x", "Place", "https://a.example/imovel/venda-lote-b-1m2-id-1/") == "lote"
    assert (k("Sobrado lindo", "Apartment", None), k(None, "Place", None), k(None, "Place", None, 1), k(None, None, None), k("AP 2q", None, None)) == ("casa", "lote", "sala", None, "apartamento")


def test_incremental(spark):
    cols = "id string, scraped_at string"
    batch = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), (None, "a"), ("", "a")], cols)
    known = spark.createDataFrame([("2",)], "listing_id string")
    assert rows(dd.first_per_id(dd.only_new(batch, known))) == [("1", "a")]
    assert rows(dd.known_ids(batch, known)) == [("2",)]
    assert rows(dd.later_copies(spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "a"), ("2", None)], cols))) == [("1", "a")] * 2
    left, right = spark.createDataFrame([("k", 1), ("l", 2)], "a string, v int"), spark.createDataFrame([("k", 9)], "a string, v int")
    assert rows(dd.union_right_wins(left, right, "a")) == [("k", 9), ("l", 2)]


def test_store(spark, tmp_path):
    base = {n: None for n in LISTING_SCHEMA.names}
    batch = files.from_records(spark, [base | {"id": "1", "titulo": " x ", "scraped_at": "2025-01-01T10:00:00+00:00"}, base | {"id": " "}, base | {"id": "2", "scraped_at": "bad", "preco": float("nan")}])
    path = str(tmp_path / "store")
    assert store.insert_if_absent(batch, path) == 2 and store.insert_if_absent(batch, path) == 0
    got = {r.listing_id: r for r in spark.read.parquet(path).collect()}
    assert got["1"].titulo == "x" and got["1"].scraped_at.isoformat() == "2025-01-01T10:00:00" and got["2"].scraped_at.year >= 2025 and got["2"].preco is None
    assert store.jdbc_options("postgres://u:p@h:5/b") == {"url": "jdbc:postgresql://h:5/b", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert store.unknown_fields(batch.drop("rua")) == ["rua"]


def test_csv_round_trip(spark, tmp_path):
    base = {n: None for n in LISTING_SCHEMA.names}
    df = files.from_records(spark, [base | {"id": "1", "descricao_completa": 'a "q", b\nsecond  ', "preco": 2.5, "quartos": 3, "aceita_pets": True}, base | {"id": "NA"}])
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    got = sorted(files.scan_csv(spark, path).collect(), key=lambda r: r.id or "")
    assert got[1].descricao_completa == 'a "q", b\nsecond  ' and got[1].preco == 2.5 and got[1].quartos == 3 and got[1].aceita_pets is True and got[0].id is None
    assert files.scan_csv(spark, path, columns=["id"]).columns == ["id"]


def test_paging(spark):
    def keep(items, known):
        p = spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(items)], "parte string, pagina int, itens array<string>")
        k = None if known is None else spark.createDataFrame([(x,) for x in known], "id string")
        return [r.pagina for r in en.pages_to_keep(p, ["parte"], "pagina", "itens", k).orderBy("pagina").collect()]

    assert keep([["a"], ["b"], ["n"]], ["a", "b"]) == [1]
    assert keep([["n"], ["m"], ["a"]], ["a"]) == [1, 2]
    assert keep([["a"], [None], ["n"]], ["a"]) == [1]
    assert keep([["a"], ["b"], [], ["c"]], None) == [1, 2]


def test_lookup_cascade_and_bounds(spark):
    gaz = spark.createDataFrame([("b2", -16.7, -49.2, "2"), ("B2", -16.6, -49.3, "1"), ("rua a", -16.8, -49.2, "3")], "nome string, latitude double, longitude double, place_id string")
    asked = spark.createDataFrame([("zz, b2",), ("Rua A, nada",), ("y, z",), ("sem virgula",)], "endereco string")
    got = {r.endereco: (r.latitude, r.place_id, r.passo) for r in en.cascade(asked, gaz).collect()}
    assert got == {"zz, b2": (-16.6, "1", 1), "Rua A, nada": (-16.8, "3", 2), "y, z": (None, None, None), "sem virgula": (None, None, None)}
    pts = spark.createDataFrame([(-16.85, -49.3), (-16.851, -49.3), (None, -49.3)], "latitude double, longitude double")
    assert en.inside_bounds(pts).count() == 1


PAGE = """<html><script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@id":"1","name":"Casa em X, GO","image":["u1","u2"],"numberOfBedrooms":0,"numberOfRooms":2,
"offers":{"price":"10.5","additionalProperty":{"name":"Condominium Fee","value":3}},"amenityFeature":[{"value":"Pool"},{"value":""},{"x":1},"bad"],"additionalType":"http://s/House"}},{"item":"bad"},{"item":{"@id":"2","image":"u1","offers":"bad"}}]}</script>
<script type='application/ld+json'>{"@type":"Thing"}</script><script type="application/ld+json">{oops</script><h1>Há <b>1.234</b> casas</h1></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,)], "html string")
    got = {r.id: r for r in pages.parse_items(pages.embedded_items(df), F.lit("now")).collect()}
    assert set(got) == {"1", "2"}
    a, b = got["1"], got["2"]
    assert (a.fotos_urls, a.quartos, a.preco, a.condominio, a.comodidades, a.tipo_imovel, a.bairro, a.moeda, a.scraped_at) == ("u1, u2", 2, 10.5, 3.0, "Pool", "House", "X", "BRL", "now")
    assert (b.fotos_urls, b.titulo, b.tipo_imovel, b.preco) == ("u1", "", None, None)
    assert [r[0] for r in df.select(pages.result_count(F.col("html"))).collect()] == [1234, 0, 0]
    assert len(pages.PRICE_RANGES) == 40 and rows(pages.range_gaps(spark)) == [(2400000, 2800000)]
    d = spark.createDataFrame([("bad", "2024-01-05T10:00"), (None, None)], "a string, b string").select(pages.matches_date(F.col("a"), F.col("b"), F.lit("2024-01-05").cast("date")))
    assert [r[0] for r in d.collect()] == [True, False]


def test_statistics_match_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2, 2, 3, None, 7], "b": [5.0, 3, 3, None, 1, 0], "k": ["x", "x", "y", "y", None, "y"]})
    df = spark.createDataFrame([Row(**{c: (None if v != v else v) for c, v in r.items()}) for r in pdf.to_dict("records")], "a double, b double, k string")
    rho = st.spearman(df, ["a", "b"]).first().rho
    x = pdf[["a", "b"]].dropna().rank()
    assert abs(rho - x.a.corr(x.b)) < 1e-12
    d = pdf.dropna(subset=["k"]).groupby("k").a.describe()
    for r in st.describe_by(df, ["k"], "a").collect():
        want = d.loc[r.valor]
        assert [r["count"], r["mean"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == [want["count"], want["mean"], want["min"], want["25%"], want["50%"], want["75%"], want["max"]]
    assert rows(st.histogram(df, "a", 3)) == [(1, 3), (2, 1), (3, 1)]
    assert rows(st.null_patterns(df, ["a", "k"])) == [("00", 1), ("11", 5)]
    assert st.null_correlation(df, ["a", "k"]).first().r == 1.0


def test_the_normal_form_of_every_character_is_that_of_unicode(spark):
    import unicodedata

    from prumo.functions.text import ascii_only

    every = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(f"a{c}B",) for c in every], "t string")
    for r in df.select("t", ascii_only(F.col("t"), whole=True).alias("f")).collect():
        assert r.f == unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()
