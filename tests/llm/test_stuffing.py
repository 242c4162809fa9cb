import random

import pytest
from conftest import rows

from prumo.llm.stuffing import Automaton, first_look, measures, page_measures, stuffed_pages, symbols

PROSE = "O piso laminado foi trocado em janeiro e ainda está na garantia. A visita foi marcada para março e o corretor leva as chaves. O contrato prevê multa de 34% em caso de desistência."


def brute(seq, times):
    out = []
    for i in range(len(seq)):
        best = 0
        for k in range(1, i + 2):
            s = seq[i + 1 - k : i + 1]
            if sum(seq[j : j + k] == s for j in range(len(seq) - k + 1)) >= times:
                best = k
        out.append(best)
    return out


@pytest.mark.parametrize("letters", [2, 3, 6, 12])
def test_repeats_against_brute_force(letters):
    rng = random.Random(letters)
    for times in (2, 3):
        for _ in range(25):
            seq = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
            assert Automaton(seq).repeated(times) == brute(seq, times)
            assert Automaton(seq, times).repeated(times) == brute(seq, times)


STUFFED = [
    "kitnet barato | lote novo | kitnet barato | casa usada | lote novo | kitnet barato | casa usada | lote novo",
    "Procurando flat novo? Aqui tem flat novo, casa barata e lote usado, o melhor flat novo em flat novo. Compre flat novo, venda casa barata, flat novo casa barata já.",
    "#CasaNova #LoteBarato #FlatUsado #CasaSetorSul #KitnetNova",
    "www.a.example/x | b.example/lista-1.html | http://c.example/?p=4 | https://www.d.example/imovel/2",
    "casa piscina barato alugar na sala comercial alugar venda terreno quartos chácara kitnet garagem proprietário",
    "<p>tag:casa+nova</p><p>tag:lote+barato</p><p>Water Tank Pool 8un R$9</p><p>tag:flat+usado</p>",
]
FINE = [PROSE, PROSE + " " + PROSE, PROSE + "\nPool, Gym, Spa, Lake View, Garden", f"<p>{PROSE}</p>", "Vendido.", "ok", PROSE + " Mais em www.a.example/x.", "The kitchen is small but the balcony makes up for it. " * 4, "", "   ", None, "​", "!!!"]


def stuffed(text):
    return measures(text).stuffed


def test_pages():
    assert [stuffed(t) for t in STUFFED] == [True] * len(STUFFED)
    assert [stuffed(t) for t in FINE] == [False] * len(FINE)
    assert stuffed(PROSE + " " + " ".join(STUFFED[:1] * 10))
    assert not stuffed(STUFFED[0] + ". " + PROSE * 6)


def test_no_page_is_stuffed_without_coverage():
    # lists without repetition, links or tags, prose of a language nobody listed, and short notes
    assert not stuffed("Pool, Gym, Spa, Lake View, Garden, Barbecue, Sauna, Playground, Garage, Balcony")
    assert not stuffed("Die Wohnung liegt ruhig im dritten Stock und hat einen großen Balkon nach Süden. Der Vermieter möchte eine Kaution von zwei Monatsmieten.")
    assert not stuffed("Asunto on hiljaisella kadulla ja sen parveke avautuu etelään päin. Vuokranantaja pyytää kahden kuukauden takuun.")
    assert stuffed("casa casa casa") and not stuffed("casa nova")


def test_a_long_tag_is_no_text():
    assert measures(f"<div style='{'margin: casa casa casa; ' * 300}'>{PROSE}</div>").size == measures(PROSE).size


def test_symbols_of_tokens_are_those_of_the_page():
    from prumo.llm.stuffing import _SYMBOL, _symbol

    for t in [*STUFFED, *FINE, "a.b\n\n c'd\r\n\r\n#x; http://a.b/c?d=e, 3.5 m2 -> fim!?", "\n\n\nx\n \ny"]:
        assert not t or symbols(t) == [_symbol(m) for m in _SYMBOL.finditer(t)]


def test_clause_words_are_learned_from_any_language(spark):
    prose = [f"Die Wohnung Nummer {i} ist ruhig und hat einen Balkon, der nach Süden geht." for i in range(40)]
    lists = ["Wohnung Balkon Süden Nummer; Wohnung Balkon; Balkon Süden"] * 20
    df = spark.createDataFrame(list(enumerate([*prose, *lists, None, ""])), "doc_id int, text string")
    got, pages = first_look(df)
    assert {r.text for r in pages.collect()} == set(lists)
    assert {"die", "ist", "und", "hat", "der"} <= got.words and not {"wohnung", "balkon", "süden"} & got.words
    assert measures("die lage ist gut und der preis hat sich kaum bewegt", got).bare == 0
    assert first_look(df.limit(0))[0].words == frozenset()


def test_table(spark):
    df = spark.createDataFrame([(1, STUFFED[0], "x"), (2, PROSE, "x"), (3, None, "x"), (1, STUFFED[0], "x"), (4, "lote novo | " * 20_000, None)], "doc_id bigint, text string, palavras_chave string")
    assert rows(page_measures(df).where("palavras_chave").select("doc_id")) == [(1,), (1,), (4,)]
    assert page_measures(df.limit(0)).count() == 0
    assert rows(stuffed_pages(df)) == [(1,), (1,), (4,)] and stuffed_pages(df.limit(0)).count() == 0
