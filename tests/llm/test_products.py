from conftest import rows

from prumo.functions.text import fold_py
from prumo.llm.products import _STREET, area_told, combinations, name_words, pairs, rooms_told, same_property, verified_groups

COLS = "id string, titulo string, tipo_imovel string, url string, preco double, area_m2 double, quartos int, banheiros int, vagas int, bairro string, cidade string, rua string, grupo string"


def listing(i, title, price, area, rooms, bairro="Setor Sul", rua=None, kind="apartamento"):
    return (i, title, "Apartment", f"https://a.example/imovel/venda-{kind}-sul-{round(area or 60)}m2-id-{i}/", price, area, rooms, 1, 1, bairro, "Goiânia", rua, "x")


DATA = [
    listing("1", "Apartamento com 2 quartos, 1 vaga e 60 m² no Ed. Campo Molivu Plaza em Setor Sul, Goiânia - GO", 300000.0, 60.0, 2),
    listing("2", "Lindo! Apto - 60,2mts - CAMPO MOLIVU PLAZA - 2/4", 305000.0, 60.2, None),
    listing("3", "60m² Ap 2 qts Res. Campo Moilvu Plaza aceita permuta", 1.0, None, None),
    listing("4", "Apartamento com 2 quartos e 60 m² no Ed. Campo Molivu Plaza em Setor Sul, Goiânia - GO", 380000.0, 90.0, 2),
    listing("5", "Apartamento com 3 quartos e 60 m² no Ed. Campo Molivu Plaza em Setor Sul, Goiânia - GO", 301000.0, 60.0, 3),
    listing("6", "Apartamento com 2 quartos e 60 m² no Ed. Porto Molivu Park em Setor Sul, Goiânia - GO", 300000.0, 60.0, 2),
    listing("7", "Casa com 2 quartos e 80 m² na Rua T-9, 55 em Setor Sul, Goiânia - GO", 200000.0, 80.0, 2, kind="casa"),
    listing("8", "Casa 2Q Rua T 9 n. 55 novinho 80m2", None, 80.4, 2, kind="casa"),
    listing("9", "Casa com 2 quartos e 80 m² na Rua T-9, 57 em Setor Sul, Goiânia - GO", 200000.0, 80.0, 2, kind="casa"),
    listing(None, "Casa com 2 quartos e 80 m² na Rua T-9, 57 em Setor Sul, Goiânia - GO", 200000.0, 80.0, 2, kind="casa"),
    listing("10", None, None, None, None),
    listing("11", "x " * 20_000, 5.0, 60.0, 2),
]


def test_readers():
    t = fold_py("Apto 2 dorms - Rua K - 424, 335 - 75,4 m²")
    s = _STREET.search(t)
    assert s[0] == "rua k - 424, 335" and area_told(t) == 75.4 and rooms_told(t) == 2
    assert rooms_told("3/4 lindo") == 3 and rooms_told("tres quartos") == 3 and rooms_told("casa") is None and area_told("0,0315 ha") == 315
    assert area_told("lote 1.200 m2") == 1200 and area_told("") is None
    assert name_words(fold_py("Apto à venda Ed. Campo Molivu Plaza - Setor Sul - 60 m² - aceita permuta em Setor Sul, Goiânia - GO"), "setor sul") == ["campo", "molivu", "plaza"]
    assert set(combinations(["a", "b", "c"])) == {"a b", "a b c", "a c", "b c"}


def test_groups(spark):
    df = spark.createDataFrame(DATA + DATA[:1], COLS)
    assert rows(pairs(same_property(df))) == [("1", "2"), ("1", "3"), ("2", "3"), ("7", "8")]
    assert pairs(same_property(df.limit(0))).count() == 0


def test_verification_is_by_gaps_not_pairs(spark):
    rows_ = [("a", "k", "apartamento", 2, 60.0, 100000.0), ("b", "k", "apartamento", 2, 60.5, 104000.0), ("c", "k", "apartamento", 2, 60.0, 130000.0), ("d", "k", "apartamento", None, 60.0, 131000.0), ("e", "k", "apartamento", 2, 60.0, None), ("f", "k", "casa", 2, 60.0, 100000.0), ("g", "k", "lote", None, 300.0, 1e5), ("h", "k", "lote", None, 300.0, 1e5), ("i", "k", None, None, None, None)]
    got = verified_groups(spark.createDataFrame(rows_, "id string, chave string, tipo string, quartos int, area double, preco double"))
    by = {}
    for i, g in rows(got):
        by.setdefault(g, set()).add(i)
    assert sorted(map(sorted, by.values())) == [["a", "b"], ["c", "d"], ["f"], ["g", "h"]]


def test_names_are_judged_by_linked_neighbourhoods(spark):
    title = "Apartamento com 2 quartos e 60 m² no Ed. {}"
    spelt = ["Setor Primavera"] * 3 + ["Setor Primaveraa", "Setor Prmavera", "Setor Primavrea", "Setor Primavoera"]
    one = [listing(f"a{i}", title.format("Campo Molivu Plaza"), 300000.0, 60.0, 2, s) for i, s in enumerate(spelt)]
    far = ["Aeroviario", "Bueno", "Coimbra", "Faicalville", "Guanabara", "Leblon", "Maracana", "Novo Mundo", "Pedro Ludovico", "Santa Genoveva", "Urias Magalhaes", "Negrao de Lima", "Finsocial", "Recreio", "Solange", "Tremendao"]
    # one name in five of sixteen neighbourhoods, and words told in all of them
    shared = [listing(f"b{i}{j}", title.format("Porto Zefiro"), 300000.0, 60.0, 2, far[i]) for i in range(5) for j in range(2)]
    phrase = [listing(f"c{i:02}{j}", title.format("Otimo Negocio"), 300000.0, 60.0, 2, p) for i, p in enumerate(far) for j in range(2)]
    got = rows(pairs(same_property(spark.createDataFrame(one + shared + phrase, COLS))))
    a = [f"a{i}" for i in range(len(spelt))]
    assert got == [(x, y) for x in a for y in a if x < y] + [(f"b{i}0", f"b{i}1") for i in range(5)]


def test_open_listings_form_groups_and_join_without_size(spark):
    rows_ = [
        ("a", "k", "casa", 2, 80.0, None), ("b", "k", "casa", 2, 80.4, None), ("c", "k", "casa", 3, 80.0, None),  # no usable price
        ("d", "m", "apartamento", None, 60.0, 200000.0), ("e", "m", "apartamento", None, 60.0, 205000.0), ("f", "m", "apartamento", None, 60.0, 300000.0), ("g", "m", "apartamento", None, 60.0, None),
        ("h", "n", "apartamento", 2, 60.0, 100000.0), ("i", "n", "apartamento", 2, None, 101000.0), ("j", "n", "apartamento", 3, 90.0, 100000.0), ("l", "n", "apartamento", None, None, 100000.0),  # no size
        ("o", "o", "lote", None, 300.0, None), ("p", "o", "lote", None, None, None), ("q", "o", "lote", None, None, 90000.0),
    ]
    by = {}
    for i, g in rows(verified_groups(spark.createDataFrame(rows_, "id string, chave string, tipo string, quartos int, area double, preco double"))):
        by.setdefault(g, set()).add(i)
    assert sorted(map(sorted, by.values())) == [["a", "b"], ["c"], ["d", "e"], ["f"], ["h", "i"], ["j"], ["o", "p"]]
