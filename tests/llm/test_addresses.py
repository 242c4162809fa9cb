import pytest
from conftest import rows

from prumo.llm.address import base, place_key, read, region_pattern
from prumo.llm.names import link_names
from prumo.llm.places import linked_sides, read_addresses, same_places


@pytest.mark.parametrize(
    "text, want",
    [
        ("Rua T-93, 123, Setor Bueno", ("t93", "n123", "bueno")),
        ("rua t 93 n. 123, st. bueno, goiania go", ("t93", "n123", "bueno")),
        ("123 R. T–93, S. Bueno", ("t93", "n123", "bueno")),
        ("Av. Dr. Anhanguera N°7, apto 12, Jd. América - Goiânia, GO", ("anhanguera", "n7", "america")),
        ("qd 9 lt 8, rua 1028, jardim america", ("1028", "q9l8", "america")),
        ("Rua 1028 Lt. 08 Qd. 09, Ed. Sol, Jardim América", ("1028", "q9l8", "america")),
        ("Setor Sul, rua das Flores, Q40 L13", ("flores", "q40l13", "sul")),
        ("rua ST-1001, 5, Vila Nova", ("st1001", "n5", "nova")),
        ("rua xe 10601 543, st. jochisce", ("xe10601", "n543", "jochisce")),
        ("aveni c 764 jardim dicosorma", ("c764", None, "dicosorma")),
        ("R. do Sol - 44 - fundos, V. Lobo", ("sol", "n44", "lobo")),
        ("Rua", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_read(text, want):
    a = read(text, True)
    assert (a.street, a.spot, a.place) == want


def test_forms_of_one_name_agree():
    assert read("Rua Doutor Bôsori Dalbrevei, 12").street == read("rua utor bosori lbrevei, 12").street
    assert place_key("Setor Docraulga") == place_key("st. craulga") == place_key("S. DOCRAULGA") == base("Docraulga")
    for bad in ("Endereço sob consulta", "n/d", "NÃO INFORMADO", "-", "sem endereço"):
        assert read(bad).spot is None and (read(bad).street or "") not in ("sob", "consulta", "informado")
    assert read("Rua Xisto, " + "a" * 100_000).street


def test_links(spark):
    names = [("g", "flores", 50), ("g", "floers", 1), ("g", "flors", 2), ("g", "flores", 3), ("g", "praia ii", 9), ("g", "praia iii", 1), ("g", "t93", 9), ("g", "t94", 1), ("h", "floers", 1), ("g", "aurora", 5), ("g", "aurorra", 5)]
    got = {(r.grupo, r.nome): r.canonico for r in link_names(spark.createDataFrame(names, "grupo string, nome string, n bigint")).collect()}
    assert got["g", "floers"] == got["g", "flors"] == got["g", "flores"] == "flores"
    assert got["h", "floers"] == "floers" and got["g", "praia iii"] == "praia iii" and got["g", "t94"] == "t94"
    assert got["g", "aurorra"] == got["g", "aurora"] == "aurora"
    assert len(got) == 10


def test_same_places(spark):
    listings = [("l1", "Rua das Flores, 10", "Setor Sul"), ("l2", "R. Floers n 10, apto 3", "St. Sul"), ("l3", "Rua T-9, 5", None), ("l4", "Rua T-8, 5", None), ("l5", "Rua das Flores", "Setor Sul"), ("l6", None, None), ("l1", "Rua das Flores, 10", "Setor Sul")]
    cache = [("c1", "rua s flores, 10, setor sul"), ("c2", "Rua das Flores, 10"), ("c3", "rua t 9 5, vila nova"), ("c4", "rua t 8, 5, vila nova"), ("c5", "rua t 8, 5, vila velha"), ("c6", "Rua das Flores, 11, Setor Sul"), ("c7", ""), ("c8", None)]
    cache += [(f"f{k}", "Rua das Flores, 99, Setor Sul") for k in range(8)]
    left = read_addresses(spark.createDataFrame(listings, "id string, rua string, bairro string"), "id", "rua", "bairro")
    right = read_addresses(spark.createDataFrame(cache, "place_id string, address string"), "place_id", "address")
    got = rows(same_places(left, right))
    assert got == sorted([("l1", "c1"), ("l1", "c2"), ("l2", "c1"), ("l2", "c2"), ("l3", "c3")], key=repr)
    assert same_places(left.limit(0), right).count() == 0 and same_places(left, right.limit(0)).count() == 0


def test_regions_part_equal_streets_and_missing_ones_are_inherited(spark):
    listings = [("l1", "Rua das Flores, 10", "Setor Sul", "Goiânia"), ("l2", "Rua das Flores, 10", "Setor Sul", "Anápolis"), ("l3", "Rua T-9, 5", "Vila Nova", None), ("l4", "Rua das Flores, 10", "Setor Sul", None), ("l5", "Rua das Flores", "Setor Sul", "Goiânia"), ("l6", "R. Flores n 10", "Setor Sul", "GOIANIA")]
    cache = [("c1", "Rua das Flores, 10, Setor Sul, Goiânia - GO"), ("c2", "Rua das Flores, 10, Setor Sul, Anápolis - GO"), ("c3", "rua t 9 5, vila nova, goiania/go"), ("c4", "Rua das Flores, 10, Setor Sul")]
    cities = ["Goiânia", "Anápolis"]
    left = read_addresses(spark.createDataFrame(listings, "id string, rua string, bairro string, cidade string"), "id", "rua", "bairro", "cidade")
    right = read_addresses(spark.createDataFrame(cache, "place_id string, address string"), "place_id", "address", cities=cities)
    assert rows(same_places(left, right)) == [("l1", "c1"), ("l2", "c2"), ("l3", "c3"), ("l6", "c1")]
    status = {r.chave: r.situacao for x in linked_sides(left, right) for r in x.collect()}
    assert status["l1"] == status["c3"] == "linked" and status["l4"] == status["c4"] == "ambiguous" and status["l5"] == "incomplete"
    # a city that isn't known is read before its state
    assert read("Rua X, 5, Vila Lobo, Anicuns/GO", True, cities=region_pattern([])).region == "anicuns"
    assert read("Rua X, 5, Vila Lobo", True, cities=region_pattern(cities)).region is None
