"""One group with a third or more of all rows."""

from collections import Counter

from prumo.llm.names import link_names
from prumo.llm.packing import pack
from prumo.llm.survivors import survivors
from test_survivors import COLS, U, at


def test_a_listing_with_most_of_the_rows(spark):
    data = [("hot", at(1 + k % 28), "2025-01-01", "Goiânia", f"Casa {k:05d} com quintal e varanda", ", ".join(U[: 1 + k % 4]), f"Rua A, {k % 50}", "Setor Sul", "x") for k in range(4000)]
    data += [("hot", at(28), "2025-01-02", "Goiânia", f"Casa {k:05d}", U[0], "Rua A", None, "x") for k in range(0, 4000, 7)]
    data += [(f"i{k}", at(n), "2025-01-01", "Goiânia", f"t{n}", U[0], "Rua B, 1", "Setor Sul", "x") for k in range(500) for n in (1, 2)]
    got = {(r.id, r.campo): r.valor for r in survivors(spark.createDataFrame(data, COLS)).collect()}
    assert got[("hot", "descricao_completa")].endswith("com quintal e varanda") and got[("hot", "fotos_urls")] == ", ".join(U) and got[("hot", "bairro")] == "Setor Sul"
    assert sum(k[0] != "hot" for k in got) == 500


def test_a_name_with_most_of_the_rows(spark):
    names = [("", "setor grande", 1)] * 5000 + [("", "setor grnade", 1)] * 3 + [("", f"lugar {chr(97 + k % 26)}{k}", 1) for k in range(2000)]
    got = Counter(r.canonico for r in link_names(spark.createDataFrame(names, "grupo string, nome string, n bigint")).collect())
    assert got["setor grande"] == 2 and len(got) == 2001


def test_equal_items(spark):
    out = pack(spark.createDataFrame([(1, 40)] * 3000 + [(k, 70) for k in range(1500)], "k bigint, n int"), "k", "n", 100, shard_containers=100)
    fill = Counter()
    for r in out.collect():
        fill[r.recipiente] += r.tamanho
    assert max(fill.values()) <= 100 and sum(fill.values()) == 40 * 3000 + 70 * 1500
