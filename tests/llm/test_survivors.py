import datetime

from conftest import rows
from pyspark.sql import functions as F

from prumo.llm.survivors import day, survivors

COLS = "id string, scraped_at string, data_modificacao string, cidade string, descricao_completa string, fotos_urls string, rua string, bairro string, campo string"
U = [f"https://f.example/x/{k}.jpg" for k in range(4)]


def at(n):
    return f"2025-01-{n:02d}T10:00:00.000001+00:00"


def run(spark, data):
    return {(r.id, r.campo): (r.scraped_at, r.valor) for r in survivors(spark.createDataFrame(data, COLS)).collect()}


def row(i, n, mod, desc="d", fotos=U[0], rua="Rua A, 1", bairro="Setor Sul"):
    return (i, at(n), mod, "Goiânia", desc, fotos, rua, bairro, "x")


def test_each_field_by_itself(spark):
    data = [
        row("1", 1, "2025-01-01", "Casa boa. Tem quintal.", ", ".join(U[:3]), "Rua das Flores, 10", "Setor Sul"),
        row("1", 2, "2025-01-02T00:00:00Z", "Casa boa. Tem...", ", ".join(U[1:3]), "Rua das Flores", "Goiânia"),
        row("1", 3, "2025-01-02", None, "https://f.example/no-image.png", "sem endereço", None),
        row("2", 1, "2025-01-05", "Nova descrição"), row("2", 2, "2025-01-03", "Outra antiga"), row("2", 3, "ontem", "Sem data"),
        row("3", 1, None, "x a"), row("3", 2, None, "x b"), row("3", 2, None, "x b"),
        row("4", 1, "2025-01-01", " "), row("4", 2, "2025-01-01", None),
        row("5", 1, "2025-01-01"), row("5", 2, "2025-01-02"),
        row(None, 1, "2025-01-01", "p"), row(None, 2, "2025-01-01", "q"),
    ]
    got = run(spark, data)
    assert got[("1", "descricao_completa")] == (at(1), "Casa boa. Tem quintal.")
    assert got[("1", "fotos_urls")][0] == at(1) and got[("1", "rua")] == (at(1), "Rua das Flores, 10") and got[("1", "bairro")] == (at(1), "Setor Sul")
    assert got[("2", "descricao_completa")] == (at(1), "Nova descrição")
    assert got[("3", "descricao_completa")] == (at(2), "x b")
    assert set(got) == {("1", f) for f in ("descricao_completa", "fotos_urls", "rua", "bairro")} | {("2", "descricao_completa"), ("3", "descricao_completa")}


def test_same_value_takes_its_latest_scrape_and_wider_photo_sets_win(spark):
    data = [row("1", 1, "2025-01-03", fotos=U[0]), row("1", 2, "2025-01-03", fotos=f"{U[1]};{U[0]}"), row("1", 3, "2025-01-03", fotos=f"{U[1]};{U[0]}"), row("1", 4, "2025-01-09", fotos=U[1]), row("1", 5, "2025-01-01", fotos=U[3])]
    assert run(spark, data)[("1", "fotos_urls")] == (at(3), f"{U[1]};{U[0]}")


def test_ties_empty_tables_and_long_texts(spark):
    long = "palavra " * 40_000
    data = [row("1", 1, "2025-01-01", long), row("1", 1, "2025-01-01", "palavra palavra…"), row("2", 1, "2025-01-01", "bb"), row("2", 1, "2025-01-01", "aa")]
    got = run(spark, data)
    assert got[("1", "descricao_completa")][1] == long and got[("2", "descricao_completa")][1] == "aa"
    assert survivors(spark.createDataFrame([], COLS)).count() == 0


def test_days(spark):
    texts = ["2025-01-03T12:03:00-03:00", "2025-01-03", " 2025-01-03T00:00:00.000+00:00", "20250103", "0000-00-00", "ontem", "", None]
    d = datetime.date(2025, 1, 3)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(day(F.col("t")).alias("d"))
    assert [r.d for r in got.collect()] == [d, d, d, d, None, None, None, None]
    assert rows(got.where("d IS NULL")) == [(None,)] * 4


def test_broken_off_against_brute_force(spark):
    import random

    from prumo.llm.survivors import broken_off

    rng = random.Random(8)
    texts = {(rng.choice("ab"), "f", "".join(rng.choice("xy ") for _ in range(rng.randint(1, 5))) * rng.randint(1, 8) + rng.choice(["", "z"])) for _ in range(400)}
    got = set(rows(broken_off(spark.createDataFrame(sorted(texts), "id string, campo string, nucleo string"))))
    assert got == {a for a in texts if any(a[:2] == b[:2] and a[2] != b[2] and b[2].startswith(a[2]) for b in texts)}
