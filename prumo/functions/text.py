"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition leaves exactly one ASCII character, and that character."""
    src, dst = [], []
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(chr(cp))
            dst.append(plain)
    return "".join(src), "".join(dst)


@lru_cache(1)
def wide_folds() -> tuple[tuple[str, str], ...]:
    """Characters whose decomposition leaves two or more ASCII characters (ligatures, fractions, squared units)."""
    out = []
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) > 1:
            out.append((chr(cp), plain))
    return tuple(out)


#: Wide characters of fold(); normalize_text() takes all of wide_folds().
_COMMON_WIDE = "¼½¾ﬁﬂﬀﬃﬄ…№℃㎡㎢™"


def _widened(c: Column) -> Column:
    """c with the characters of wide_folds() written out; texts without any are left as they are."""
    wide = wide_folds()
    table = F.str_to_map(F.lit("\x02".join(f"{a}\x01{b}" for a, b in wide)), F.lit("\x02"), F.lit("\x01"))
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    # all beyond the Latin blocks, and the few within them: a class of ranges is tested at once, one of all characters is not
    some = "".join(a for a, _ in wide if a < "\u0250")
    return F.when(c.rlike(f"[{some}\u0250-\U0010ffff]"), F.array_join(letters, "")).otherwise(c)


def ascii_only(c: Column, whole: bool = False) -> Column:
    """Compatibility-decompose and drop what is not ASCII, as Unicode NFKD + ASCII encoding does.

    Without whole, of the characters that become several only the common ones are written out, in compiled code.
    """
    src, dst = fold_table()
    if whole:
        c = _widened(c)
    else:
        for a, b in wide_folds():
            if a in _COMMON_WIDE:
                c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, src, dst), "[^\\x00-\\x7F]", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(ascii_only(c))


def fold_py(s: str) -> str:
    """fold() for one Python string."""
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()


def squeeze(c: Column) -> Column:
    """Runs of any white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def strip_all(c: Column) -> Column:
    """Strip any white space at both ends (Spark's trim only knows the blank)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def lower_key(c: Column) -> Column:
    """A comparison key: null as empty, lower case, no white space around."""
    return strip_all(F.lower(F.coalesce(c, F.lit(""))))


def normalize_text(c: Column) -> Column:
    """The geocoder's normal form of an address.

    ASCII, lower case, hyphens as blanks; the syllables da, do, de are taken out wherever they stand, then das and dos;
    the short forms r., av., pq., qd. are written out; white space is squeezed. Null and empty give the empty text.
    """
    t = F.replace(F.lower(ascii_only(F.coalesce(c, F.lit("")), whole=True)), F.lit("-"), F.lit(" "))
    for syllable in ("da", "do", "de", "das", "dos"):
        t = F.replace(t, F.lit(syllable), F.lit(""))
    for short, full in (("r", "rua"), ("av", "avenida"), ("pq", "parque"), ("qd", "quadra")):
        t = F.regexp_replace(t, rf"\b{short}\.\s*", f"{full} ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def contains_normalized(text: Column, part: Column) -> Column:
    """Whether the normal form of part stands in that of text."""
    return F.contains(normalize_text(text), normalize_text(part))


def address(rua: Column, bairro: Column, sep: str = ", ") -> Column:
    """Street and neighbourhood in one text, null as empty."""
    return F.concat(F.coalesce(rua, F.lit("")), F.lit(sep), F.coalesce(bairro, F.lit("")))


def first_word(c: Column) -> Column:
    """The first word of a text; null for a null or blank one."""
    return F.nullif(F.regexp_extract(c, r"(?U)^\s*(\S+)", 1), F.lit(""))


def title_number(titulo: Column, unit: str) -> Column:
    """The number before a unit in a title, as a float; units are plural, as the coherence check wants them."""
    return F.regexp_extract(titulo, rf"(\d+) {unit}", 1).try_cast("double")


def parking_told(titulo: Column) -> Column:
    """Parking spaces told in a title."""
    return F.regexp_extract(titulo, r"(?iu)(\d+)\s+vagas?", 1).try_cast("int")


def neighbourhood_told(titulo: Column) -> Column:
    """The neighbourhood told in a title: what stands between 'em' and the city, state or country."""
    return F.nullif(strip_all(F.regexp_extract(titulo, r"(?iu)em\s+(.+?),\s*(?:Goiânia|GO|Brasil)", 1)), F.lit(""))
