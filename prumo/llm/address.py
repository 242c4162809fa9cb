"""Reading postal addresses: street, number or block and lot, neighbourhood.

Raw addresses and such as were normalised the project's way (accents, hyphens and the syllables da, do, de taken out) get
the same form: the syllables are taken out of both until none is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

_CUT = re.compile("da|do|de")


def base(s: str, cut: bool = True) -> str:
    """Lower-case ASCII without hyphens and, with cut, without the syllables da, do, de."""
    if not s.isascii():
        s = s.replace("–", " ").replace("—", " ").replace("°", "o").replace("º", "o").replace("ª", "a")
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    t = s.lower().replace("-", " ")
    while cut and (u := _CUT.sub("", t)) != t:
        t = u
    return " ".join(t.split())


@lru_cache(1)
def words() -> dict[str, str]:
    """Types and honorifics as base() leaves them, cut or not: t: street type, h: honorific, b: type of neighbourhood (fixed values)."""
    forms = {
        "t:rua": "rua r", "t:avenida": "avenida av ave aven avn", "t:alameda": "alameda al alam", "t:travessa": "travessa tv tr trav tra", "t:praca": "praca pc pca pr", "t:rodovia": "rodovia rod", "t:viela": "viela", "t:via": "via",
        "h:": "doutor dr doutora dra professor prof professora profa engenheiro eng engo maestro mtro senador sen coronel cel comendador com comend santa sta santo sto general gen presidente pres governador gov desembargador des vereador ver padre pe dom major maj capitao cap deputado dep",
        "b:setor": "setor set st", "b:jardim": "jardim jd jar jard", "b:vila": "vila vl", "b:conjunto": "conjunto conj cj", "b:parque": "parque pq prq parq pque", "b:residencial": "residencial res resid", "b:chacara": "chacara chac chc", "b:bairro": "bairro",
    }
    out = {}
    for k, v in forms.items():
        for w in v.split():
            out.setdefault(base(w), k)
            out.setdefault(w, k)
    return out


#: Short forms that only a neighbourhood field may use (fixed values).
_SHORT_PLACES = {"s": "b:setor", "v": "b:vila", "ch": "b:chacara", "p": "b:parque", "j": "b:jardim", "c": "b:conjunto", "r": "b:residencial"}
_CITY = re.compile(r"\b(goiania|goias|brasil|brazil)\b|(?:^|(?<=[,/ ]))(go|br)\b|\b7[2-6]\d{3} ?\d{3}\b")
_BLOCK = r"\b(?:quadra|qdra|qd|q)[\s.:]*0*(\d+)"
_LOT = r"\b(?:lote|lt|l)[\s.:]*0*(\d+)"
_BLOCK_LOT = re.compile(rf"{_BLOCK}[\s,;/.]*{_LOT}\b")
_LOT_BLOCK = re.compile(rf"{_LOT}[\s,;/.]*{_BLOCK}\b")
_INNER = re.compile(r"[,;]?\s*\b(?:funs|fundos|frente)\b|[,;]?\s*\b(?:apto|apartamento|apt|ap|bloco|bl|sala|sl|casa|cs|torre|edificio|ed|condominio|condo?|conv?|loja|lj|andar|unidade|unid|kit|kitnet|fundos|quarto|box|galpao)\b[\s.:]*[\w]*(?:\s[^,]*)?(?=,|$)")
_BARE = re.compile(r",\s*0*(\d+)\s*(?=,|$)")
_NOTHING = re.compile(r"nao (informa|disponi)|sob consulta|^(n/?[aid]|null|nan|none|sem en.*|a (de)?finir|s/?n)$")
_CODE = re.compile(r"[a-z]{0,3}\d+[a-z]?")
_OTHER = re.compile(r"[^a-z0-9 ]")
_OTHER_PART = re.compile(r"[^a-z0-9 ,]")
_COMMAS = re.compile(r"(?:,\s*)+")
_WORD = re.compile(r"(?:^|(?<=[ ,.]))([a-z]+)\b\.?")
_NAME_AHEAD = re.compile(r"[. ]*[a-z]{3}")
_AT_END = re.compile(r"\s\d+\s*$|\s+(?:no|n|num|numero)\b.*$")
_AHEAD = re.compile(r"0*(\d+)[\s,]+(?=[a-z])")
_STREET_AHEAD = re.compile(r"[a-z]{2,}|r\b")
_LAST = re.compile(r"(?<=[a-z]{3})\s+0*(\d+)$|(?<=\d)\s+0*(\d+)$")
_MARK = re.compile(r"[,\s.]*\b(?:numero|num|nro|nr|no|n)(?:\b|(?=\d))[\s.:]*0*(\d+)\b")


#: States (fixed values).
STATES = "ac al ap am ba ce df es go ma mt ms mg pa pb pr pe pi rj rn rs ro rr sc sp se to"


def region_pattern(cities: Iterable[str]) -> tuple[re.Pattern, re.Pattern]:
    """What tells the city in a text of base(): a known name, with or without its state; else any name before a state at the end."""
    known = sorted({b for c in cities for cut in (True, False) if (b := base(c, cut))}, key=lambda c: (-len(c), c))
    state = f"(?:{STATES.replace(' ', '|')})"
    names = "|".join(map(re.escape, known)) or "(?!)"
    return re.compile(rf"[,/ ]*\b({names})\b(?: *[-/, ] *{state}\b)?"), re.compile(rf", *([a-z][a-z ]+?) *[-/,] *{state} *(?:, *brasil *)?$")


class Address(NamedTuple):
    """Keys of an address; None where it doesn't tell."""

    street: str | None
    kind: str | None
    number: str | None
    block: str | None
    lot: str | None
    place: str | None
    region: str | None = None

    @property
    def spot(self) -> str | None:
        """The house number, or block and lot."""
        if self.block and self.lot:
            return f"q{self.block}l{self.lot}"
        return f"n{self.number}" if self.number else None


@lru_cache(20_000)
def place_key(s: str | None, cut: bool = True) -> str | None:
    """The key of a neighbourhood: its name without the type, types in short or long form alike."""
    if not s:
        return None
    t = _OTHER.sub(" ", _CITY.sub(" ", base(s, cut)))
    tokens = t.split()
    w = words()
    if len(tokens) > 1 and (w.get(tokens[0], "").startswith("b:") or tokens[0] in _SHORT_PLACES):
        tokens = tokens[1:]
    return " ".join(tokens) or None


def _street_key(tokens: list[str]) -> tuple[str | None, str | None]:
    w, kind = words(), None
    if tokens and w.get(tokens[0], "").startswith("t:"):
        kind = w[tokens[0]][2:]
        tokens = tokens[1:]
    code = "".join(tokens)
    if _CODE.fullmatch(code):
        return code.lstrip("0") or None, kind
    while tokens and (w.get(tokens[0]) == "h:" or tokens[0] in ("s", "d", "e", "a", "o", "da", "do", "das", "dos", "de")) and len(tokens) > 1:
        tokens = tokens[1:]
    key = " ".join(x for x in tokens if x not in ("s", "d", "da", "do", "das", "dos", "de"))
    return (key if len(key) > 2 and not w.get(key, "").startswith("t:") else None), kind


def read(s: str | None, with_place: bool = False, cut: bool = True, cities: tuple[re.Pattern, re.Pattern] | None = None) -> Address:
    """The parts of a street field, or, with_place, of a whole address; cut as in base(). cities: a region_pattern()."""
    nothing = Address(None, None, None, None, None, None)
    if not s or s.isspace():
        return nothing
    t = base(s, cut)
    if _NOTHING.search(t):
        return nothing
    w = words()
    block = lot = number = None
    m = _BLOCK_LOT.search(t)
    if m:
        block, lot = m[1], m[2]
    elif m := _LOT_BLOCK.search(t):
        lot, block = m[1], m[2]
    if m:
        t = t[: m.start()] + "," + t[m.end() :]
    region = None
    if with_place:
        if cities and (m := cities[0].search(t) or cities[1].search(t)):
            region = m[1]
            t = t[: m.start()] + "," + t[m.end() :]
        t = _CITY.sub(",", t)
    t = _INNER.sub("", t)
    place = None
    t = t.replace("/", ",").replace(";", ",")
    if with_place:
        # the neighbourhood starts at its type, which isn't the first word of a street
        for p in _WORD.finditer(t):
            k = w.get(p[1], "")
            ahead = t[: p.start()].replace(".", " ").split()
            typed = len(ahead) == 1 and w.get(ahead[0], "").startswith("t:")
            short = p[1] in _SHORT_PLACES and p[1] != "r" and t[p.end(1) : p.end(1) + 1] == "." and not typed
            if (k.startswith("b:") and not typed or short) and _NAME_AHEAD.match(t, p.end(1)):
                rest = t[p.end() :]
                stop = rest.find(",")
                name, tail = (rest, "") if stop < 0 else (rest[:stop], rest[stop:])
                num = _AT_END.search(name)
                if num:
                    tail, name = "," + name[num.start() :] + tail, name[: num.start()]
                place = " ".join(_OTHER.sub(" ", name).split()) or None
                t = t[: p.start()] + "," + tail
                break
    t = (_COMMAS.sub(", ", t) if "," in t else t).strip(", .")
    if not (block and lot):
        m = _AHEAD.match(t)
        if m and _STREET_AHEAD.match(t, m.end()):
            number, t = m[1], t[m.end() :]
        else:
            for m in _MARK.finditer(t):
                before = t[: m.start()].strip(" ,.").split()
                if before and not w.get(before[-1].strip("."), "").startswith("t:"):
                    number, t = m[1], t[: m.start()] + "," + t[m.end() :]
                    break
            else:
                m = _BARE.search("," + t if t[:1].isdigit() else t) if "," in t else None
                if m and m.start() > 0:
                    number, t = m[1], t[: m.start()] + t[m.end() :]
                elif m := _LAST.search(t):
                    head = t[: m.start()].split()
                    if not (len(head) == 1 and w.get(head[0].strip("."), "").startswith("t:")):
                        number, t = m[1] or m[2], t[: m.start()]
    parts = [p for p in (x.split() for x in _OTHER_PART.sub(" ", t).split(",")) if p]
    typed = [p for p in parts if w.get(p[0], "").startswith("t:") and len(p) > 1] or [p for p in parts if not (len(p) == 1 and p[0].isdigit())]
    street, kind = _street_key(typed[0]) if typed else (None, None)
    if with_place and place is None:
        rest = [p for p in parts if p is not (typed[0] if typed else None) and any(len(x) > 3 and x.isalpha() for x in p)]
        place = " ".join(rest[0]) if rest else None
    return Address(street, kind, number, block, lot, place, region)


def has_syllables(s: str | None) -> bool:
    """Whether base() cuts anything out of a text."""
    return bool(s) and bool(_CUT.search(base(s, False)))
