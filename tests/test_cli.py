from prumo.cli import main
from prumo.schema import LISTING_SCHEMA
from prumo.sources import files


def test_commands(spark, tmp_path, capsys):
    base = {n: None for n in LISTING_SCHEMA.names}
    raw = files.from_records(spark, [base | {"id": str(k), "titulo": "Casa com 2 quartos e 50 m²", "preco": 1e5 + k // 2, "area_m2": 50.0, "quartos": 2, "rua": "Rua A", "tipo_imovel": "House", "bairro": "B", "scraped_at": "2025-01-01T00:00:00"} for k in range(6)])
    src, out, store, cache = (str(tmp_path / x) for x in ("raw.csv", "out.csv", "store", "cache"))
    files.write_csv(raw, src)
    main(["deduplicate", src, out], spark)
    assert files.scan_csv(spark, out).count() == 3
    main(["daily", src, store, "--dry-run"], spark)
    main(["daily", out, store], spark)
    main(["load-csv", src, store], spark)
    said = capsys.readouterr().out
    assert "{'inicial': 6, 'removidos': 3, 'unicos': 3}" in said and said.count("{'novos': 3}") == 1 and said.count("{'inseridos': 3}") == 2
    spark.createDataFrame([("rua a, b", -16.7, -49.3, "x", "1")], "address string, latitude double, longitude double, formatted_address string, place_id string").write.parquet(cache)
    main(["preprocess", src, str(tmp_path / "feat"), "--cache", cache], spark)
    assert spark.read.parquet(str(tmp_path / "feat")).where("faixa_area = 'pequeno'").count() == 6
    (tmp_path / "totals.csv").write_text("categoria,total\nHouse,12\n")
    main(["validate", src, "--totals", str(tmp_path / "totals.csv")], spark)
    assert "50.0" in capsys.readouterr().out
    page = tmp_path / "pages"
    page.mkdir()
    (page / "p1.html").write_text('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@id":"9","name":"Casa"}}]}</script>')
    main(["ingest", str(page), str(tmp_path / "parsed")], spark)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "parsed")).collect()] == ["9"]
