"""Several values packed in one field: one row per value, with its position.

Method: expectation-maximisation over the whole column learns how often each value occurs and how often each class of
delimiter separates; the Viterbi path through the lattice of a text's possible splits is its split; quoted spans are
atomic. Two models say how likely a value is:

Model, for values that come again and again (amenities): by the frequency of the value. Commas, semicolons, bars, tabs,
line ends and bullets outside quotes are sure separators; slash and dash, which also stand inside values, open the lattice.

HeadModel, for values that are nearly all different (web addresses): by the head of the value, its first letters. Every
delimiter opens the lattice, and what follows it either begins a value, with a head like those at the beginning of fields,
or goes on with one. No head is known beforehand.

Defined results: a null, empty or blank field gives no row; empty pieces are left out and not counted; repeated values
are kept; an unclosed quote is an ordinary character; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping
from copy import copy

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.session import cut, cuts_dropped, scratch

#: Separators wherever they stand outside quotes.
HARD = ",;|\n\r\t•"
#: Delimiters that may also stand inside a value.
SOFT = "/–-"

_TOKENS = {q: re.compile(rf"{q}(?:[^{q}\\]|\\.|{q}{q})*{q}|[{HARD}]|[^{q}{HARD}]+|{q}", re.S) for q in ("\"", "'")}
_SOFT = re.compile(rf"\s*(?<!\S)[{SOFT}](?!\S)\s*|[{SOFT}]")
#: Runs of delimiters and quotes between the pieces of a field of different values; brackets count at a piece's beginning.
_RUN = re.compile(r"[\s,;|•\"']+[\[{]*")
_HEAD = re.compile(r"[A-Za-z]+:?|\d|.", re.S)
#: EM stops when the likelihood of a character grows by less than this, or after so many rounds.
LEAST_GAIN, MOST_ROUNDS = 1e-5, 30


def unquote(s: str, q: str) -> str:
    """The value of a quoted span: doubled quotes and backslash escapes undone."""
    body = s[1:-1].replace(q + q, q)
    return re.sub(r"\\(.)", r"\1", body, flags=re.S) if "\\" in body else body


def open_field(s: str) -> tuple[str, str]:
    """The field without list or array brackets, and its quote character."""
    t = s.strip()
    if len(t) >= 2 and (t[0], t[-1]) in (("[", "]"), ("{", "}")):
        inner = t[1:-1].strip()
        return inner, "'" if t[0] == "[" and inner[:1] == "'" else '"'
    return t, '"'


def chunks(s: str) -> Iterator[list[tuple[str, bool]]]:
    """The chunks of a field: lists of (text, quoted) atoms between sure separators."""
    inner, q = open_field(s)
    if q not in inner:
        for part in re.split(rf"[{HARD}]", inner):
            if part and not part.isspace():
                yield [(part, False)]
        return
    atoms: list[tuple[str, bool]] = []
    for tok in _TOKENS[q].findall(inner):
        if len(tok) == 1 and tok in HARD:
            if atoms:
                yield atoms
            atoms = []
        elif len(tok) > 1 and tok[0] == q and (not atoms or re.search(rf"(?:^|\s)[{SOFT}]?\s*$", atoms[-1][0])):
            atoms.append((unquote(tok, q), True))
        elif atoms and not atoms[-1][1]:
            atoms[-1] = (atoms[-1][0] + tok, False)
        else:
            atoms.append((tok, False))
    if atoms:
        yield atoms


def pieces(atoms: list[tuple[str, bool]]) -> tuple[list[str], list[bool], list[str], list[str]]:
    """Pieces, whether each is quoted, the delimiters between (as written) and their classes.

    Around a quoted piece the cut is sure (class "").
    """
    texts: list[str] = []
    quoted: list[bool] = []
    marks: list[str] = []
    kinds: list[str] = []

    def add(text: str, is_quoted: bool, mark: str, kind: str) -> None:
        if texts:
            marks.append(mark)
            kinds.append(kind)
        texts.append(text)
        quoted.append(is_quoted)

    for text, is_quoted in atoms:
        if is_quoted:
            if text.strip():
                add(text.strip(), True, "", "")
            continue
        mark = kind = ""
        at = 0
        for m in [*_SOFT.finditer(text), None]:
            piece = text[at : m.start() if m else len(text)].strip()
            if piece:
                add(piece, False, mark, "" if texts and quoted and quoted[-1] else kind)
                mark = kind = ""
            if m:
                at = m.end()
                spaced = m.group() != m.group().strip() or m.start() == 0 or m.end() == len(text)
                mark += m.group()
                kind = f" {m.group().strip()} " if spaced or kind.startswith(" ") else m.group()
    return texts, quoted, marks, kinds


#: Pieces that a value of the lattice may always have; longer ones are tried where they fill a chunk, and wherever they are known.
SHORT = 4


#: What is taken from the count of each value and left to the unknown ones.
DISCOUNT = 0.75


class Model:
    """Value frequencies and separator rates; unknown values get a small share that shrinks with their pieces."""

    def __init__(self, counts: dict[str, float], rates: dict[str, float], total: float, discount: float = DISCOUNT):
        self.counts, self.rates, self.total, self.discount = counts, rates, max(total, 1.0), discount
        #: Numbers of pieces a value is tried with at any place: up to SHORT, and those of the known longer ones.
        long = {1 + len(_SOFT.findall(v)) for v, c in counts.items() if c > discount}
        self.lengths = [*range(1, SHORT + 1), *sorted(n for n in long if n > SHORT)]
        #: Whether any value is known, here or in the table that the counts come from.
        self.learned = bool(counts)

    def knowing(self, counts: dict[str, float]) -> Model:
        """The same model with other counts: those of the values of one chunk suffice for that chunk."""
        out = copy(self)
        out.counts = counts
        return out

    def log_value(self, v: str, n: int) -> float:
        c = max(self.counts.get(v, 0.0) - self.discount, 0.0)
        return (math.log(c + 0.05**n) if n < 100 or c else n * math.log(0.05)) - math.log(self.total + 1)

    def spans(self, kinds: list[str]) -> Iterator[tuple[int, int]]:
        """Begin and end of the pieces that may be one value: no sure cut among them, as many as a value may have."""
        n = len(kinds) + 1
        sure = [0, 0]
        for k in kinds:
            sure.append(sure[-1] + (k == ""))
        for i in range(n):
            for size in self.lengths:
                j = i + size
                if j > n or sure[j] > sure[i + 1]:
                    break
                yield i, j

    def candidates(self, atoms: list[tuple[str, bool]]) -> set[str]:
        """The values whose counts the lattice of a chunk asks for."""
        texts, _, marks, kinds = pieces(atoms)
        return {self.join(texts, marks, i, j) for i, j in self.spans(kinds)} if texts else set()

    def lattice(self, atoms: list[tuple[str, bool]], seen: float = 0.0) -> tuple[list[str], list[bool], list[str], list[str], dict[tuple[int, int], float]]:
        texts, quoted, marks, kinds = pieces(atoms)
        n = len(texts)
        # sums over the delimiters before each piece: what it costs to cut nowhere
        kept = [0.0, 0.0]
        for k in kinds:
            kept.append(kept[-1] + (math.log(1 - self.rates.get(k, 0.5)) if k else 0.0))
        edges = {}
        for i, j in self.spans(kinds) if n else ():
            value = self.join(texts, marks, i, j)
            if j - i > SHORT and value not in self.counts:
                continue
            out = math.log(self.rates.get(kinds[j - 1], 0.5)) if j < n and kinds[j - 1] else 0.0
            edges[i, j] = self.log_value(value, j - i) + kept[j] - kept[i + 1] + out
        # a long chunk most of whose pieces are no values by themselves may be one: as often as it was seen
        if seen and n > SHORT and "" not in kinds and (0, n) not in edges and self.learned and 2 * sum(self.counts.get(t, 0.0) <= self.discount for t in texts) > n:
            edges[0, n] = math.log((seen + 0.05**n) / (self.total + 1)) + kept[n] - kept[1]
        return texts, quoted, marks, kinds, edges

    @staticmethod
    def join(texts: list[str], marks: list[str], i: int, j: int) -> str:
        out = texts[i]
        for k in range(i + 1, j):
            out += marks[k - 1] + texts[k]
        return out

    def split(self, atoms: list[tuple[str, bool]]) -> list[str]:
        """The Viterbi path: the likeliest split of a chunk."""
        if len(atoms) == 1 and (atoms[0][1] or not _SOFT.search(atoms[0][0])):
            v = atoms[0][0].strip()
            return [v] if v else []
        texts, _, marks, _, edges = self.lattice(atoms)
        n = len(texts)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for (i, j), s in sorted(edges.items()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
        cuts, j = [], n
        while j:
            cuts.append((back[j], j))
            j = back[j]
        return [self.join(texts, marks, i, j) for i, j in reversed(cuts)]

    @staticmethod
    def asked(s: str) -> set[str]:
        """The chunks of a field that are looked up: those with delimiters that may stand inside values."""
        return {_encode(atoms) for atoms in chunks(s) if _soft(atoms)}

    @staticmethod
    def split_with(s: str, splits: dict[str, list[str]]) -> list[str]:
        """The values of a field by the splits of its chunks."""
        return _split_field(s, lambda atoms: splits[_encode(atoms)])

    def expect(self, atoms: list[tuple[str, bool]], seen: float = 0.0) -> tuple[dict[str, float], dict[str, tuple[float, float]], float]:
        """Expected uses of each value, of each delimiter class expected cuts and occurrences, and the log-likelihood (forward-backward)."""
        texts, quoted, marks, kinds, edges = self.lattice(atoms, seen)
        n = len(texts)
        fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        steps_ = sorted(edges.items())
        for (i, j), s in steps_:
            fwd[j] = _add(fwd[j], fwd[i] + s)
        for (i, j), s in reversed(steps_):
            bwd[i] = _add(bwd[i], bwd[j] + s)
        values: dict[str, float] = defaultdict(float)
        cut_at = [0.0] * (n + 1)
        for (i, j), s in edges.items():
            p = math.exp(fwd[i] + s + bwd[j] - fwd[n])
            if p:
                if not (quoted[i] and j == i + 1 and _SOFT.search(texts[i])):
                    values[self.join(texts, marks, i, j)] += p
                cut_at[j] += p
        classes: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for k, kind in enumerate(kinds):
            if kind:
                classes[kind][0] += cut_at[k + 1]
                classes[kind][1] += 1
        return values, {k: (a, b) for k, (a, b) in classes.items()}, fwd[n]


def _add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _soft(atoms: list[tuple[str, bool]]) -> bool:
    return len(atoms) > 1 or not atoms[0][1] and bool(_SOFT.search(atoms[0][0]))


_KEY = "\x00"


def _encode(atoms: list[tuple[str, bool]]) -> str:
    return _KEY.join(("q" if q else "t") + t for t, q in atoms)


def _decode(s: str) -> list[tuple[str, bool]]:
    return [(x[1:], x[0] == "q") for x in s.split(_KEY)]


#: Characters of the values that are held at once, beside their number.
LEXICON_CHARS = 1 << 25
#: Characters of the candidates in one Arrow batch.
BATCH_CHARS = 1 << 22


class WideModel:
    """A model whose lexicon is a table (valor, a): the counts of a chunk's candidates are looked up by a join."""

    def __init__(self, lexicon: DataFrame, rates: dict[str, float], total: float, lengths: list[int]):
        self.lexicon = lexicon
        self.bare = Model({}, rates, total)
        self.bare.lengths, self.bare.learned = lengths, True

    def with_counts(self, counted: DataFrame) -> DataFrame:
        """A table with the columns id, each row's own, and chunk, and the counts of the chunk's candidates (null: none is known)."""
        bare = self.bare

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], names=["id", "valor"])

            for b in batches:
                ids: list[int] = []
                values: list[str] = []
                size = 0
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    atoms = _decode(s)
                    for v in bare.candidates(atoms) if _soft(atoms) else ():
                        ids.append(i)
                        values.append(v)
                        size += len(v)
                        if size > BATCH_CHARS:
                            yield batch()
                            ids, values, size = [], [], 0
                if ids:
                    yield batch()

        known = counted.select("id", "chunk").mapInArrow(candidates, "id long, valor string").join(self.lexicon, "valor")
        return counted.join(known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("valor", "a"))).alias("known")), "id", "left")

    def answers(self, asked: DataFrame) -> DataFrame:
        """The split (resposta) of each chunk of a table of different ones (chave)."""
        bare = self.bare
        found = cut(asked.select(F.col("chave").alias("chunk"), F.monotonically_increasing_id().alias("id")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = [bare.knowing(dict(k or ())).split(_decode(s)) for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.string()))], names=["chave", "resposta"])

        return self.with_counts(found).select("chunk", "known").mapInArrow(run, "chave string, resposta array<string>")

    def split(self, atoms: list[tuple[str, bool]]) -> list[str]:
        """The split of one chunk, for the driver alone."""
        asked = self.lexicon.sparkSession.createDataFrame([(v,) for v in sorted(self.bare.candidates(atoms))], "valor string")
        return self.bare.knowing({r.valor: r.a for r in asked.join(self.lexicon, "valor").collect()}).split(atoms)


def _forget_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffles of plans that are not used any more: it does when the driver collects its garbage."""
    df.sparkSession._jvm.System.gc()


def _lengths(lexicon: DataFrame) -> list[int]:
    """Numbers of pieces a value is tried with, as in Model, for a lexicon in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array({1 + len(_SOFT.findall(v)) for v in b.column(0).to_pylist()}, pa.int32())], names=["n"])

    long = lexicon.select("valor").mapInArrow(run, "n int").where(F.col("n") > SHORT).distinct().collect()
    return [*range(1, SHORT + 1), *sorted(r.n for r in long)]


def learn(df: DataFrame, column: str, lexicon_limit: int = 200_000) -> Model | WideModel:
    """Learn value frequencies and separator rates from the whole column, until the likelihood stands still.

    Chunks are counted in the tasks before they are shuffled. A lexicon of up to lexicon_limit values and LEXICON_CHARS
    characters (the proven bound of what is broadcast) is held by the driver and the tasks; a larger one stays a table, and
    each round joins it with the values the chunks may hold. Both give the same model: no value loses its count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[str] = Counter()
            for s in b.column(0).to_pylist():
                if s:
                    seen.update(map(_encode, chunks(s)))
            if seen:
                yield pa.RecordBatch.from_pydict({"chunk": list(seen), "n": list(seen.values())}, schema=pa.schema([("chunk", pa.string()), ("n", pa.int64())]))

    spark = df.sparkSession
    kept = scratch(spark)
    with cuts_dropped():
        counted = df.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(count, "chunk string, n long")
        counted = cut(counted.groupBy("chunk").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
        model, last = Model({}, {}, 1.0), -math.inf
        # two tables in turns: a round reads the values of the last one only
        paths = scratch(spark), scratch(spark)
        for turn in range(MOST_ROUNDS):
            wide = isinstance(model, WideModel)
            shared = spark.sparkContext.broadcast(model.bare if wide else model)

            def expect(batches: Iterator[pa.RecordBatch], shared=shared, wide=wide) -> Iterator[pa.RecordBatch]:
                m = shared.value
                for b in batches:
                    values: dict[str, float] = defaultdict(float)
                    classes: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
                    likely = [0.0, 0.0]
                    known = b.column(2).to_pylist() if wide else [None] * b.num_rows
                    for s, n, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), known):
                        atoms = _decode(s)
                        if _soft(atoms):
                            got, sep, score = (m.knowing(dict(counts or ())) if wide else m).expect(atoms, n)
                            likely[0] += score * n
                            likely[1] += len(s) * n
                            for v, p in got.items():
                                values[v] += p * n
                            for k, (a, c) in sep.items():
                                classes[k][0] += a * n
                                classes[k][1] += c * n
                        elif v := atoms[0][0].strip():
                            if not (atoms[0][1] and _SOFT.search(v)):
                                values[v] += n
                    rows = [("v", v, c, 0.0) for v, c in values.items()] + [("d", k, a, c) for k, (a, c) in classes.items()] + [("a", "", *likely)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["kind", "key", "a", "b"])

            given = model.with_counts(counted).select("chunk", "n", "known") if wide else counted.select("chunk", "n")
            made = given.mapInArrow(expect, "kind string, key string, a double, b double").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            made.write.mode("overwrite").parquet(paths[turn % 2])
            stats = spark.read.schema(made.schema).parquet(paths[turn % 2])
            shared.unpersist()
            # values at or under the discount count nothing in the model, but in the total
            value = F.col("kind") == "v"
            counts = value & (F.col("a") > DISCOUNT)
            total, number, chars = stats.agg(F.sum(F.when(value, F.col("a"))), F.count(F.when(counts, 1)), F.sum(F.when(counts, F.length("key")))).first()
            fits = number <= lexicon_limit and (chars or 0) <= LEXICON_CHARS
            rows = stats.where(~value | counts if fits else ~value).collect()
            rates = {r.key: min(max(r.a / r.b, 0.005), 0.995) for r in rows if r.kind == "d" and r.b}
            if fits:
                model = Model({r.key: r.a for r in rows if r.kind == "v"}, rates, total or 0.0)
            else:
                lexicon = stats.where(counts).select(F.col("key").alias("valor"), "a")
                model = WideModel(lexicon, rates, total, _lengths(lexicon))
                made = given = None
                _forget_shuffles(df)
            now = next((r.a / r.b for r in rows if r.kind == "a" and r.b), 0.0)
            if now - last < LEAST_GAIN:
                break
            last = now
        if isinstance(model, WideModel):
            model.lexicon.write.parquet(kept)
            model.lexicon = spark.read.schema(model.lexicon.schema).parquet(kept)
    return model


#: What a head counts that was never seen: values begin in few ways, and go on in many.
NEW_BEGIN, NEW_INSIDE = 1e-6, 1e-3


class HeadModel:
    """How often each head begins a value or goes on with one, and how often each class of delimiters separates."""

    def __init__(self, begins: dict[str, float], goes_on: dict[str, float], rates: dict[str, float]):
        self.begins, self.goes_on, self.rates = begins, goes_on, rates
        self.sums = sum(begins.values()) + 1.0, sum(goes_on.values()) + 1.0
        self.cuts: dict[tuple[str, str], bool] = {}

    @staticmethod
    def asked(s: str) -> set[str]:
        """The heads of a field, whose counts are looked up."""
        return {head for _, _, _, head in steps(bare(s))}

    def split_with(self, s: str, heads: dict[str, dict[str, float]]) -> list[str]:
        """The values of a field by the counts of its heads, with the sums and rates of this model."""
        own = copy(self)
        own.begins, own.goes_on, own.cuts = {h: x["comeca"] for h, x in heads.items()}, {h: x["segue"] for h, x in heads.items()}, {}
        return own.split(s)

    def odds(self, kind: str, head: str) -> tuple[float, float]:
        """Likelihoods of a piece with this head after this delimiter: it begins a value, it goes on with one."""
        rate = self.rates.get(kind, 0.5)
        return rate * (self.begins.get(head, 0.0) + NEW_BEGIN) / self.sums[0], (1 - rate) * (self.goes_on.get(head, 0.0) + NEW_INSIDE) / self.sums[1]

    def split(self, s: str) -> list[str]:
        """The Viterbi path: what follows a delimiter depends on the two alone, so each step takes the likelier side."""
        text = bare(s)
        out: list[str] = []
        start = end = 0
        for a, z, kind, head in steps(text):
            known = self.cuts.get((kind, head))
            if known is None:
                begin, on = self.odds(kind, head)
                known = self.cuts[kind, head] = begin > on
                if len(self.cuts) > 100_000:
                    self.cuts.clear()
            if end and known:
                out.append(text[start:end])
                start = a
            elif not end:
                start = a
            end = z
        return [*out, text[start:end]] if end else []


def bare(s: str) -> str:
    """A field without array brackets and escapes of slashes and quotes."""
    t = s.strip()
    if "\\" in t:
        t = t.replace("\\/", "/").replace('\\"', '"')
    return t[1:-1] if len(t) >= 2 and (t[0], t[-1]) in (("[", "]"), ("{", "}")) else t


def steps(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Begin and end of each piece of a field, the class of the delimiters before it (empty for the first), and its head."""
    at, kind, n = 0, "", len(text)
    m = _RUN.match(text)
    if m:
        at = m.end()
    while at < n:
        m = _RUN.search(text, at)
        end = m.start() if m else n
        yield at, end, kind, _HEAD.match(text, at)[0].lower()
        if not m:
            return
        at = m.end()
        kind = "".join(sorted(set(m[0].replace("\r", "\n"))))


class WideHeadModel:
    """A HeadModel whose heads are a table (chave, resposta): the counts of a field's heads are looked up by a join."""

    def __init__(self, heads: DataFrame, rates: dict[str, float], sums: tuple[float, float]):
        self.heads = heads
        self.bare = HeadModel({}, {}, rates)
        self.bare.sums = sums

    def answers(self, asked: DataFrame) -> DataFrame:
        """How often each head of a table of different ones (chave) begins a value or goes on with one (resposta)."""
        return asked.join(self.heads, "chave")

    def split(self, s: str) -> list[str]:
        """The split of one field, for the driver alone."""
        asked = self.heads.sparkSession.createDataFrame([(h,) for h in sorted(self.bare.asked(s))], "chave string")
        return self.bare.split_with(s, {r.chave: r.resposta.asDict() for r in self.answers(asked).collect()})


def learn_heads(df: DataFrame, column: str, heads_limit: int = 100_000) -> HeadModel | WideHeadModel:
    """Learn heads and separator rates from the whole column.

    The pieces are counted by delimiter class and head in the tasks; these counts say all that EM needs, so its rounds run
    over their table: on the driver up to heads_limit rows (and LEXICON_CHARS characters), else where the table is, with the
    same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for s in b.column(0).to_pylist():
                if s:
                    seen.update((k, h) for _, _, k, h in steps(bare(s)))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([h for _, h in seen]), pa.array(list(seen.values()), pa.int64())], names=["classe", "cabeca", "n"])

    kept = scratch(df.sparkSession)
    with cuts_dropped():
        counted = cut(df.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(count, "classe string, cabeca string, n long").groupBy("classe", "cabeca").agg(F.sum("n").alias("n")))
        number, chars = counted.agg(F.count("*"), F.sum(F.length("classe") + F.length("cabeca"))).first()
        if number > heads_limit or (chars or 0) > LEXICON_CHARS:
            return _learn_wide_heads(counted, kept)
        rows = counted.collect()
    first: dict[str, float] = {r.cabeca: float(r.n) for r in rows if r.classe == ""}
    model = HeadModel(first, {}, {})
    for _ in range(MOST_ROUNDS):
        begins, goes_on = defaultdict(float, first), defaultdict(float)
        classes: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for r in rows:
            if r.classe:
                a, b = model.odds(r.classe, r.cabeca)
                p = a / (a + b)
                begins[r.cabeca] += p * r.n
                goes_on[r.cabeca] += (1 - p) * r.n
                classes[r.classe][0] += p * r.n
                classes[r.classe][1] += r.n
        rates = {k: min(max(a / b, 0.005), 0.995) for k, (a, b) in classes.items()}
        done = all(abs(rates[k] - model.rates.get(k, 0.5)) < LEAST_GAIN for k in rates)
        model = HeadModel(dict(begins), dict(goes_on), rates)
        if done:
            break
    return model


def _learn_wide_heads(counted: DataFrame, path: str) -> WideHeadModel:
    """The rounds of learn_heads over a table of heads, each with its counts by delimiter class; the model's table goes to path."""
    spark = counted.sparkSession
    # n and p, the share of it that begins values, by class; those without delimiters before them always do
    pair = F.when(F.col("classe") != "", F.struct("classe", "n", F.lit(0.0).alias("p")))
    state = cut(
        counted.groupBy("cabeca")
        .agg(F.coalesce(F.sum(F.when(F.col("classe") == "", F.col("n"))), F.lit(0)).cast("double").alias("primeiro"), F.collect_list(pair).alias("pares"))
        .select("cabeca", "primeiro", "pares", F.col("primeiro").alias("comeca"), F.lit(0.0).alias("segue"))
    )
    paths = scratch(spark), scratch(spark)
    rates: dict[str, float] = {}
    sums = state.agg(F.sum("comeca")).first()[0] + 1.0, 1.0
    for turn in range(MOST_ROUNDS):
        known = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]) if rates else None

        def share(x: Column, known: Column | None = known, sums: tuple[float, float] = sums) -> Column:
            rate = F.lit(0.5) if known is None else F.coalesce(F.try_element_at(known, x["classe"]), F.lit(0.5))
            a = rate * (F.col("comeca") + NEW_BEGIN) / sums[0]
            b = (1 - rate) * (F.col("segue") + NEW_INSIDE) / sums[1]
            return F.struct(x["classe"].alias("classe"), x["n"].alias("n"), (a / (a + b)).alias("p"))

        made = state.withColumn("pares", F.transform("pares", lambda x: share(x))).select(
            "cabeca",
            "primeiro",
            "pares",
            F.aggregate("pares", F.col("primeiro"), lambda acc, x: acc + x["p"] * x["n"]).alias("comeca"),
            F.aggregate("pares", F.lit(0.0), lambda acc, x: acc + (1 - x["p"]) * x["n"]).alias("segue"),
        )
        made.write.mode("overwrite").parquet(paths[turn % 2])
        state = spark.read.schema(made.schema).parquet(paths[turn % 2])
        begun, gone = state.agg(F.sum("comeca"), F.sum("segue")).first()
        sums = begun + 1.0, gone + 1.0
        classes = state.select(F.explode("pares").alias("x")).groupBy("x.classe").agg(F.sum(F.col("x.p") * F.col("x.n")).alias("a"), F.sum("x.n").alias("b")).collect()
        last, rates = rates, {r.classe: min(max(r.a / r.b, 0.005), 0.995) for r in classes}
        if all(abs(rates[k] - last.get(k, 0.5)) < LEAST_GAIN for k in rates):
            break
    heads = state.select(F.col("cabeca").alias("chave"), F.struct("comeca", "segue").alias("resposta"))
    heads.write.parquet(path)
    return WideHeadModel(spark.read.schema(heads.schema).parquet(path), rates, sums)


def split_anchored(s: str) -> list[str]:
    """The values of a field by a model that knows that web addresses begin with http."""
    return _ADDRESSES.split(s)


_ADDRESSES = HeadModel({"https:": 1e6, "http:": 1e6}, {}, {})


AnyModel = Model | WideModel | HeadModel | WideHeadModel


def _split_field(s: str, split: Callable[[list[tuple[str, bool]]], list[str]]) -> list[str]:
    """The values of a field; split divides the chunks with delimiters that may stand inside values."""
    out: list[str] = []
    for atoms in chunks(s):
        if _soft(atoms):
            out += split(atoms)
        elif v := atoms[0][0].strip():
            out.append(v)
    return out


def splitter(model: AnyModel) -> Callable[[str], list[str]]:
    """A function that splits one field; with a WideModel or WideHeadModel on the driver only."""
    if isinstance(model, HeadModel | WideHeadModel):
        return model.split
    known: dict[str, list[str]] = {}

    def split(atoms: list[tuple[str, bool]]) -> list[str]:
        key = _encode(atoms)
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = model.split(atoms)
        return known[key]

    return lambda s: _split_field(s, split)


def _with_answers(flat: DataFrame, wide: Mapping[str, WideModel | WideHeadModel]) -> DataFrame:
    """The rows with a map of what they ask the tables of the models for, one for each column of wide, after the other columns."""
    columns = flat.columns
    row = max(columns, key=len) + "_"
    flat = out = cut(flat.withColumn(row, F.monotonically_increasing_id()))
    for k, (c, m) in enumerate(wide.items()):

        def ask(batches: Iterator[pa.RecordBatch], asked=m.bare.asked) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids: list[int] = []
                keys: list[str] = []
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = asked(s) if s else ()
                    ids += [i] * len(own)
                    keys += own
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["linha", "chave"])

        held = cut(flat.select(row, c).mapInArrow(ask, "linha long, chave string"))
        answers = cut(m.answers(held.select("chave").distinct()))
        _forget_shuffles(flat)
        held = held.join(answers, "chave").groupBy("linha").agg(F.map_from_entries(F.collect_list(F.struct("chave", "resposta"))).alias(f"{row}{k}"))
        out = out.join(held.withColumnRenamed("linha", row), row, "left")
    return out.select(*columns, *(f"{row}{k}" for k in range(len(wide))))


def split_packed(df: DataFrame, keys: list[str], fields: dict[str, AnyModel]) -> DataFrame:
    """One row (keys, campo, posicao, valor) per value packed in each of the fields.

    fields maps a column to its model. All fields are split in one pass; what they need of models that are tables is joined before.
    """
    wide = {c: m for c, m in fields.items() if isinstance(m, WideModel | WideHeadModel)}
    shared = df.sparkSession.sparkContext.broadcast({c: wide[c].bare if c in wide else m for c, m in fields.items()})
    names = list(fields)
    flat = df.select(*keys, *names)
    schema = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys) + ", campo string, posicao int, valor string"
    if wide:
        flat = _with_answers(flat, wide)
    at = {c: len(keys) + len(names) + k for k, c in enumerate(wide)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = {c: shared.value[c].split_with if c in at else splitter(m) for c, m in shared.value.items()}
        for b in batches:
            take: list[int] = []
            campo: list[int] = []
            pos: list[int] = []
            val: list[str] = []
            for f, c in enumerate(names):
                known = b.column(at[c]).to_pylist() if c in at else None
                for i, s in enumerate(b.column(len(keys) + f).to_pylist()):
                    if s:
                        vs = splits[c](s) if known is None else splits[c](s, dict(known[i] or ()))
                        n = len(vs)
                        take += [i] * n
                        campo += [f] * n
                        pos += range(1, n + 1)
                        val += vs
            if not val:
                continue
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(rows) for k in range(len(keys))] + [pa.array(names).take(pa.array(campo)), pa.array(pos, pa.int32()), pa.array(val, pa.string())],
                names=[*keys, "campo", "posicao", "valor"],
            )

    return flat.mapInArrow(run, schema)
