import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prumo.operators.packed import learn, learn_heads, split_anchored, split_packed, splitter

WORDS = ["Pool", "Gym", "Spa", "Water/Gas Meter", "Semi-Covered Garage", "Wi-Fi/Internet", "Lake View", "Closet", "Garden"]


def sample(spark):
    data = []
    for k in range(120):
        a, b, c = (WORDS[(k * m + m) % len(WORDS)] for m in (1, 2, 5))
        sep = (", ", "; ", " | ", " / ", " - ", "\n", " • ", "\t")[k % 8]
        data.append((f"i{k}", "s", sep.join([a, b, c])))
    return data, spark.createDataFrame(data, "id string, scraped_at string, comodidades string")


def test_learned_splits(spark):
    data, df = sample(spark)
    model = learn(df, "comodidades")
    split = splitter(model)
    for _, _, s in data:
        assert set(split(s)) <= set(WORDS), s
        assert len(split(s)) == 3
    assert split('Pool, "Balcony, glazed, east",Gym') == ["Pool", "Balcony, glazed, east", "Gym"]
    assert split('["Deck \\"sunset\\"", "Gym / Spa"]') == ['Deck "sunset"', "Gym / Spa"]
    assert split("['Pool', 'Kitchen | Pantry']") == ["Pool", "Kitchen | Pantry"]
    assert split('{Pool,"Party Hall - 80 seats"}') == ["Pool", "Party Hall - 80 seats"]
    assert split('"Room ""home office"""; Gym;;') == ['Room "home office"', "Gym"]
    assert split('Closet / Garden / "Gym / Spa" / Pool') == ["Closet", "Garden", "Gym / Spa", "Pool"]
    assert split(" , ; | ") == [] and split("  ") == []
    assert split('5" Pipe, Gym') == ['5" Pipe', "Gym"]


def test_photos():
    u = ["https://f.example/fit-in/870x654,q80/a-1.webp", "http://f.example/x/foto_01.JPG?w=870&h=654;v=0"]
    for text in (", ".join(u), ";".join(u), " ".join(u), "\n".join(u) + "\n", str(u), '["' + '","'.join(u) + '"]', "{" + ",".join(f'"{x}"' for x in u) + "}", f"{u[0]}, , {u[1]},", '["' + '", "'.join(u).replace("/", "\\/") + '"]'):
        assert split_anchored(text) == u, text
    assert split_anchored("") == [] and split_anchored(" ,; ") == []
    assert split_anchored("nada") == ["nada"]


def test_rows_positions_and_edge_tables(spark):
    _, df = sample(spark)
    model = learn(df, "comodidades")
    long = ", ".join(["Pool"] * 30000)
    t = spark.createDataFrame([("a", None, "Pool, Pool", None, "x"), ("b", "s", None, "", "x"), (None, "s", "", "http://e.example/1.jpg", "x"), ("c", "s", long, None, "x")], "id string, scraped_at string, comodidades string, fotos_urls string, campo string")
    out = split_packed(t, ["id", "scraped_at"], {"comodidades": model, "fotos_urls": learn_heads(t, "fotos_urls")})
    assert out.columns == ["id", "scraped_at", "campo", "posicao", "valor"]
    got = rows(out.where("id IS NULL OR id <> 'c'"))
    assert got == sorted([("a", None, "comodidades", 1, "Pool"), ("a", None, "comodidades", 2, "Pool"), (None, "s", "fotos_urls", 1, "http://e.example/1.jpg")], key=repr)
    assert out.where("id = 'c'").count() == 30000
    assert split_packed(t.limit(0), ["id"], {"comodidades": learn(t.limit(0), "comodidades")}).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters='",;|\n\r\t•/-–[]{}\'\\'), min_size=1).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([",", "; ", " | ", "\n"]))
def test_round_trip_of_plain_values(values, sep):
    from prumo.operators.packed import Model

    assert splitter(Model({}, {}, 1.0))(sep.join(values)) == values
    assert splitter(Model({}, {}, 1.0))(sep.join(f'"{v}"' for v in values)) == values


def test_heads_are_learned_from_the_column(spark):
    # no scheme is known beforehand: values begin with file: or ftp:, and go on after commas and blanks
    value = [f"file://h/{k},w{k % 3}/a b{k % 5}.png" if k % 2 else f"ftp://g/{k};v={k % 4}" for k in range(60)]
    seps = (", ", ";", " ", "\n", ",")
    data = [(seps[k % 5].join(value[k : k + 3]),) for k in range(57)] + [(str(value[:2]),), ("",), (None,)]
    split = splitter(learn_heads(spark.createDataFrame(data, "f string"), "f"))
    for k, (s,) in enumerate(data[:57]):
        assert split(s) == value[k : k + 3]
    assert split(str(value[:2])) == value[:2] and split(" ") == []
    assert splitter(learn_heads(spark.createDataFrame([], "f string"), "f"))("ftp://a") == ["ftp://a"]


def test_values_of_many_pieces_are_learned(spark):
    data = [("A/B/C/D/E",)] * 300 + [("A/B/C/D/E, Pool",)] * 20 + [("Gym / A/B/C/D/E / Spa",)] * 3 + [("Pool, Gym",)] * 80 + [("Gym, Spa",)] * 80 + [("x" + "/x" * 30_000,)]
    split = splitter(learn(spark.createDataFrame(data, "f string"), "f"))
    assert split("A/B/C/D/E") == ["A/B/C/D/E"] and split("A/B/C/D/E; Pool / Gym") == ["A/B/C/D/E", "Pool", "Gym"]
    assert split("Gym / A/B/C/D/E / Spa") == ["Gym", "A/B/C/D/E", "Spa"]


def test_a_lexicon_above_the_limit_gives_the_same_model(spark):
    data, _ = sample(spark)
    data += [(f"n{k}", None, v) for k, v in enumerate(["A/B/C/D/E", "Gym / A/B/C/D/E / Spa", 'Pool / "Gym / Spa" / Wi-Fi/Internet', "A/B/C/D/E, Pool", "Lake/View", "", None] * 20)]
    df = spark.createDataFrame(data, "id string, scraped_at string, f string").selectExpr("*", "f AS g", "'file://a, file://b' AS h")
    held, wide = learn(df, "f"), learn(df, "f", lexicon_limit=3)
    split = splitter(held)
    got = {(r.id, r.campo): r.valores for r in split_packed(df, ["id"], {"f": wide, "g": held, "h": learn_heads(df, "h")}).groupBy("id", "campo").agg(F.array_sort(F.collect_list(F.struct("posicao", "valor"))).alias("valores")).collect()}
    for i, _, s in data:
        want = list(enumerate(split(s or ""), 1))
        assert [tuple(v) for v in got.get((i, "f"), [])] == want == [tuple(v) for v in got.get((i, "g"), [])], s
    assert splitter(wide)("A/B/C/D/E; Pool / Gym") == split("A/B/C/D/E; Pool / Gym") == ["A/B/C/D/E", "Pool", "Gym"] and wide.lexicon.count() == len(held.counts) > 3
    # values never seen are split like before, in another table as well
    new = spark.createDataFrame([("a", "Pool / Sauna/Steam"), ("a", "Pool / Wi-Fi/Internet")], "k string, f string")
    assert rows(split_packed(new, ["k"], {"f": wide})) == rows(split_packed(new, ["k"], {"f": held}))


def test_no_expected_use_is_dropped():
    from prumo.operators.packed import Model

    values, _, _ = Model({"A/B": 1e9}, {"/": 0.005}, 1e9).expect([("A/B", False)])
    assert set(values) == {"A/B", "A", "B"} and 0 < values["A"] < 1e-6


def test_rare_heads_keep_their_counts(spark):
    # one field in 60 000 begins with ftp:, another one goes on with it
    often = spark.range(60_000).selectExpr("concat('file://h/', id, ', file://g/a b', id % 7) AS f")
    df = often.unionByName(spark.createDataFrame([("ftp://x",), ("file://h/1, ftp://y",)], "f string"))
    for limit in (100_000, 2):
        split = splitter(learn_heads(df, "f", heads_limit=limit))
        assert split("file://h/1, ftp://y") == ["file://h/1", "ftp://y"] and split("file://h/1, file://g/a b3") == ["file://h/1", "file://g/a b3"]


def test_heads_above_the_limit_give_the_same_model(spark):
    value = [f"file://h/{k},w{k % 3}/a b{k % 5}.png" if k % 2 else f"ftp://g/{k};v={k % 4}" for k in range(60)]
    seps = (", ", ";", " ", "\n", ",")
    data = [(k, seps[k % 5].join(value[k : k + 3])) for k in range(57)] + [(57, str(value[:2])), (58, ""), (59, None), (60, " , ")]
    df = spark.createDataFrame(data, "k int, f string").selectExpr("*", "f AS g")
    held, wide = learn_heads(df, "f"), learn_heads(df, "f", heads_limit=3)
    assert wide.heads.count() > 3 and wide.bare.sums == pytest.approx(held.sums) and wide.bare.rates == pytest.approx(held.rates)
    out = split_packed(df, ["k"], {"f": wide, "g": held}).cache()
    assert rows(out.where("campo = 'f'").drop("campo")) == rows(out.where("campo = 'g'").drop("campo"))
    assert [r.valor for r in out.where("k = 7 AND campo = 'f'").orderBy("posicao").collect()] == value[7:10] == splitter(wide)(data[7][1])
    new = spark.createDataFrame([(1, "x://1; file://2,y://3")], "k int, f string")
    assert rows(split_packed(new, ["k"], {"f": wide})) == rows(split_packed(new, ["k"], {"f": held}))
