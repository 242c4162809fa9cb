"""Keyword-stuffed and link-list pages.

Method: each page becomes a stream of symbols (words, marks, one symbol for any link and one for any tag); its suffix
automaton gives, for every position, the longest substring ending there that occurs at least REPEATS times; the union of
these repeated maximal substrings is the page's repeated text. The page is also cut into units (sentences, lines, list
entries). A unit has clause structure if it has enough of the words that hold clauses together, or is written as a
sentence (a capital, six words or more that hardly repeat, a full stop), and does not say one phrase again and again. Text
counts as stuffing where a unit without clause structure is repeated, linked or tagged. A page is stuffed if that is most
of its text, or if nearly none of its text has clause structure and part of it occurs twice at least. No page is stuffed
without repeated substrings, links or tags.

Which words hold clauses together is learned from all pages, whatever their language: those several times as frequent in
units written as sentences as in all others. Nouns and adjectives of the trade, and the prepositions between them, stand
in lists as well and drop out.

Defined results: null, empty and blank texts are no stuffing; texts of any length are read whole in linear time; markup
and invisible characters are left out of all measures; without any sentence in the corpus only the shape of units counts;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prumo.session import cut

#: Occurrences from which a substring counts as repeated, and in pages that are nearly without clause structure.
REPEATS, TWICE = 3, 2
#: A word holds clauses together if it stands in one of 200 sentences, CONTRAST times as often as elsewhere.
LEAST_SHARE, CONTRAST = 0.005, 4.0
#: Shares: of stuffing in a stuffed page; of text without clause structure, and of it what occurs twice.
STUFFED, BARE, TOLD_TWICE = 0.5, 0.85, 0.05
_MARKUP = re.compile(r"<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]*)[^>]*>|<[a-zA-Z/!][^>]*>")
_BLOCK = re.compile(r"</?(p|br|div|li|tr|h\d)\b", re.I)
#: Symbols of a page by group: 1 and 4 words (most words end at white space or a comma: the first alternative takes them
#: at once), 2 links, 3 tags, 5 ends of units, 6 other marks.
_SYMBOL = re.compile(
    r"(\w+)(?![\w.\-:/'’@]|\s+:)"
    r"|((?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?![\w@]))"
    r"|(#\w+|\b(?:tags?|keywords?|palavras?-chave|etiquetas?)\s*:\s*[\w+%-]+)|(\w+(?:['’]\w+)?)|([.!?]+(?=\s|$)|\n+|[|•·;]|->)|([^\w\s])",
    re.I,
)
#: Where a symbol may reach across white space.
_ACROSS = re.compile(r"\s:|(?:tags?|keywords?|palavras?-chave|etiquetas?)\s*:\s", re.I)
Symbol = tuple[int, str, int, bool]  # group, text, size, whether a word with a capital


class Clauses(NamedTuple):
    """The words that hold clauses together, and the share of them from which a unit has clause structure."""

    words: frozenset[str] = frozenset()
    share: float = 1.0


class Automaton:
    """The suffix automaton of a sequence, with the number of ends of each state.

    Symbols that occur fewer than least times part the sequence: no substring that occurs least times holds one, so the
    automaton of the runs between them (their joint one) has all such substrings.
    """

    def __init__(self, seq: list[int], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]
        nxt, link, length, count = self.next, self.link, self.len, self.count
        rare = {c for c, n in Counter(seq).items() if n < least}
        last = 0
        self.state = []
        note = self.state.append
        for c in seq:
            if c in rare:
                last = 0
                note(0)
                continue
            q = nxt[last].get(c)
            if q is not None:  # the run so far has gone on like this before
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                    link[q] = last
                count[last] += 1
                note(last)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    link[q] = link[cur] = self._clone(p, c, q)
            last = cur
            note(cur)

    def _clone(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the substrings that end p's with c, one symbol longer than p's."""
        nxt, link = self.next, self.link
        made = len(nxt)
        nxt.append(nxt[q].copy())
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        return made

    def repeated(self, times: int) -> list[int]:
        """For each position, the length of the longest substring ending there that occurs at least so often."""
        length, link, count = self.len, self.link, self.count
        # states in ascending order of length, by counting
        bucket = [0] * (max(length) + 2)
        for x in length:
            bucket[x + 1] += 1
        for i in range(1, len(bucket)):
            bucket[i] += bucket[i - 1]
        order = [0] * len(length)
        for s, x in enumerate(length):
            order[bucket[x]] = s
            bucket[x] += 1
        for s in reversed(order[1:]):
            count[link[s]] += count[s]
        longest = [0] * len(length)
        for s in order[1:]:
            longest[s] = length[s] if count[s] >= times else longest[link[s]]
        return [longest[s] for s in self.state]


@lru_cache(1)
def _invisible() -> frozenset[str]:
    """The format characters (category Cf)."""
    return frozenset(chr(i) for i in range(0x80, 0x110000) if unicodedata.category(chr(i)) == "Cf")


def plain(text: str) -> str:
    """Text without markup, entities and invisible characters; addresses of links are kept."""
    if "<" in text:
        text = _MARKUP.sub(lambda m: f" {m[1]} " if m[1] else "\n" if _BLOCK.match(m[0]) else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        text = text if _invisible().isdisjoint(text) else "".join(c for c in text if c not in _invisible())
    return text


def echo(words: list[str]) -> float:
    """Share of a unit's words in word pairs that the unit has more than once."""
    if len(words) < 4 or len(set(words)) >= len(words) - 1:  # a pair again takes two words again
        return 0.0
    pairs = list(zip(words, words[1:]))
    seen: dict[tuple[str, str], int] = {}
    for p in pairs:
        seen[p] = seen.get(p, 0) + 1
    if len(seen) == len(pairs):
        return 0.0
    hit = [False] * len(words)
    for i, p in enumerate(pairs):
        if seen[p] > 1:
            hit[i] = hit[i + 1] = True
    return sum(hit) / len(words)


_symbols: dict[Symbol, Symbol] = {}
_tokens: dict[str, tuple[Symbol, ...]] = {}
_NEW_LINE: Symbol = (5, "\n", 0, False)


def _symbol(m: re.Match) -> Symbol:
    kind, s = m.lastindex, m[0]
    if kind == 1 or kind == 4:
        made = (1, s.lower(), len(s), s[0].isupper())
    else:
        made = (kind, "<link>" if kind == 2 else "<tag>" if kind == 3 else s[0] if kind == 5 else s, len(s) if kind < 4 else 0, False)
    return _symbols.setdefault(made, made)


def symbols(text: str) -> list[Symbol]:
    """The symbols of a plain text. Symbols end at white space, with few exceptions, so those of a token are kept."""
    if len(_tokens) > 300_000:
        _tokens.clear()
        _symbols.clear()
    if ":" in text and _ACROSS.search(text):
        return [_symbol(m) for m in _SYMBOL.finditer(text)]
    out: list[Symbol] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if k and (k == 1 or lines[k - 1]):  # line ends in a row are one
            out.append(_NEW_LINE)
        for token in line.split():
            got = _tokens.get(token)
            if got is None:
                got = tuple(map(_symbol, _SYMBOL.finditer(token)))
                if len(token) < 64:
                    _tokens[token] = got
            out += got
    return out


def as_sentence(words: int, different: int, capital: bool, end: str) -> bool:
    """Whether a unit is written as a sentence."""
    return words >= 6 and capital and end in ".!?" and different >= 0.8 * words


class Measures(NamedTuple):
    """Characters of words, links and tags, and shares of them: repeated or linked, without clause structure, stuffing,
    and, of pages nearly without clause structure, what occurs twice or is a link or tag."""

    size: int = 0
    repeated: float = 0.0
    bare: float = 0.0
    stuffing: float = 0.0
    twice: float = 0.0

    @property
    def stuffed(self) -> bool:
        """Whether most of the page is stuffing."""
        return self.stuffing >= STUFFED or self.bare >= BARE and self.twice >= TOLD_TWICE


def _covered(seq: list[int], size: list[int], times: int) -> list[int]:
    """The sizes of the symbols that are covered, or a link or tag: the widest substring reaches back from its end."""
    hit = [0] * len(seq)
    if max(Counter(seq).values()) < times and min(seq) > 1:
        return hit
    far = Automaton(seq, times).repeated(times)
    reach = 0
    for i in range(len(seq) - 1, -1, -1):
        reach -= 1
        if far[i] > reach:
            reach = far[i]
        if reach > 0 or seq[i] < 2:
            hit[i] = size[i]
    return hit


class Tally:
    """How often each word stands in units written as sentences, and in others, and the number of those sentences."""

    def __init__(self) -> None:
        self.inside: Counter[str] = Counter()
        self.outside: Counter[str] = Counter()
        self.sentences = 0


def measures(text: str | None, clauses: Clauses = Clauses(), tally: Tally | None = None) -> Measures:
    """The measures of a page; its words are added to the tally."""
    if not text or text.isspace():
        return Measures()
    page = symbols(plain(text))
    size = [s[2] for s in page]
    total = sum(size)
    if not total:
        return Measures()
    ids: dict[str, int] = {"<link>": 0, "<tag>": 1}
    seq = [ids.setdefault(s[1], len(ids)) for s in page]
    hit = _covered(seq, size, REPEATS)
    bare = stuffing = at = 0
    ends = [i + 1 for i, s in enumerate(page) if s[0] == 5]
    told: list[str] = []
    loose: list[str] = []
    for end in [*ends, len(page)]:
        whole = sum(size[at:end])
        if whole:
            unit = [s for s in page[at:end] if s[0] == 1]
            words = [s[1] for s in unit]
            written = bool(unit) and as_sentence(len(words), len(set(words)), unit[0][3], page[end - 1][1])
            held = written or len([w for w in words if w in clauses.words]) >= max(1, clauses.share * len(words))
            if tally is not None:
                if written:
                    told += words
                    tally.sentences += 1
                else:
                    loose += words
            if not held or echo(words) >= 0.4:
                bare += whole
                if sum(hit[at:end]) > 0.25 * whole:
                    stuffing += whole
        at = end
    if tally is not None:
        tally.inside.update(told)
        tally.outside.update(loose)
    twice = sum(_covered(seq, size, TWICE)) / total if bare >= BARE * total else 0.0
    return Measures(total, sum(hit) / total, bare / total, stuffing / total, twice)


def _learned(counts: DataFrame) -> Clauses:
    """The clause words by rows (palavra, dentro, fora); the row without palavra has the number of sentences.

    The driver gets 200 words per word of a sentence at most.
    """
    counts = cut(counts.groupBy("palavra").agg(F.sum("dentro").alias("dentro"), F.sum("fora").alias("fora")))
    told = F.col("palavra").isNotNull()
    all_ = counts.agg(F.sum(F.when(told, F.col("dentro"))).alias("dentro"), F.sum("fora").alias("fora"), F.max(F.when(~told, F.col("dentro"))).alias("frases")).first()
    if not all_.frases:
        return Clauses()
    often = (F.col("dentro") >= LEAST_SHARE * all_.frases) & (F.col("dentro") / F.lit(float(all_.dentro)) >= CONTRAST * (F.col("fora") + 1) / F.lit(float(all_.fora + 1)))
    rows = counts.where(told & often).collect()
    return Clauses(frozenset(r.palavra for r in rows), sum(r.dentro for r in rows) / all_.dentro / 3)


def first_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Clauses, DataFrame]:
    """The clause words of a corpus, and the rows (key, text) of the pages that are stuffed if no word holds clauses together.

    Every page is measured, its automaton built, and its words counted, in one pass. Clause words can only give a unit
    clause structure, so no other page can turn out to be stuffed.
    """
    flat = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally = Tally()
            found = [i for i, t in enumerate(b.column(1).to_pylist()) if measures(t, tally=tally).stuffed]
            words: list[str | None] = [*(tally.inside | tally.outside), None]
            n, m = len(found), len(words)
            pages = [b.column(k).take(pa.array(found, pa.int64())) for k in (0, 1)]
            inside = [*(tally.inside[w] for w in words[:-1]), tally.sentences]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pages[0], pa.nulls(m, pages[0].type)]), pa.concat_arrays([pages[1].cast(pa.string()), pa.nulls(m, pa.string())]), pa.array([True] * n + [False] * m),
                    pa.array([None] * n + words, pa.string()), pa.array([0] * n + inside, pa.int64()), pa.array([0] * n + [tally.outside[w] for w in words], pa.int64()),
                ],
                names=[key, text, "__pagina", "palavra", "dentro", "fora"],
            )

    noted = cut(flat.mapInArrow(run, f"`{key}` {flat.schema[0].dataType.simpleString()}, `{text}` string, __pagina boolean, palavra string, dentro long, fora long"))
    return _learned(noted.where("NOT __pagina").select("palavra", "dentro", "fora")), noted.where("__pagina").select(key, text)


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the stuffed pages: those of the first look that are so by the learned clause words as well."""
    clauses, pages = first_look(df, key, text)
    return page_measures(pages, key, text, clauses).where("palavras_chave").select(key)


def page_measures(df: DataFrame, key: str = "doc_id", text: str = "text", clauses: Clauses | None = None) -> DataFrame:
    """Rows (key, caracteres, repetido, sem_oracao, recheio, duas_vezes, palavras_chave) of every page; clauses are learned from df unless given."""
    flat = df.select(key, text)
    known = first_look(flat, key, text)[0] if clauses is None else clauses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measures(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g.size for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.float64()) for k in (1, 2, 3, 4)), pa.array([g.stuffed for g in got], pa.bool_())],
                names=[key, "caracteres", "repetido", "sem_oracao", "recheio", "duas_vezes", "palavras_chave"],
            )

    return flat.mapInArrow(run, f"`{key}` {flat.schema[0].dataType.simpleString()}, caracteres long, repetido double, sem_oracao double, recheio double, duas_vezes double, palavras_chave boolean")
