import random
from collections import defaultdict

from prumo.llm.packing import Packer, pack


def brute(sizes, capacity, most_open):
    """Best fit with a plain list of open containers."""
    open_, made, out = [], 0, []
    for n in sizes:
        fit = [b for b in open_ if b[0] >= max(n, 1)]
        if fit:
            best = min(b[0] for b in fit)
            b = [x for x in fit if x[0] == best][-1]
            open_.remove(b)
        else:
            if len(open_) >= most_open:
                open_.remove([x for x in open_ if x[0] == min(y[0] for y in open_)][-1])
            b = [capacity, made]
            made += 1
        b = [b[0] - n, b[1]]
        if b[0]:
            open_.append(b)
        out.append(b[1])
    return out


def test_packer_is_best_fit():
    rng = random.Random(1)
    for most in (1, 3, 8):
        sizes = [rng.randint(0, 100) for _ in range(500)]
        p = Packer(100, most)
        got = [p.put(n) for n in sizes]
        assert got == brute(sizes, 100, most)
        fill = defaultdict(int)
        for b, n in zip(got, sizes):
            fill[b] += n
        assert max(fill.values()) <= 100 and p.open <= most


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, 0, 7, 30, 99, 100, 101, 250, 1000])) for i in range(2000)] + [(5, 7), (None, 3), (9, -4)]
    df = spark.createDataFrame(data, "k bigint, n int").withColumn("recipiente", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    out = pack(df, "k", "n", 100, shard_containers=50).collect()
    fill, parts = defaultdict(int), defaultdict(int)
    for r in out:
        fill[r.recipiente] += r.tamanho
        parts[r.k] += r.tamanho
        assert r.inicio == (r.parte - 1) * 100
    assert max(fill.values()) <= 100
    want = defaultdict(int)
    for k, n in data:
        want[k] += max(n or 0, 0)
    assert parts == want
    assert sum(fill.values()) / 100 / len(fill) > 0.93
    split = {r.k for r in out if r.parte > 1}
    assert split == {k for k, n in data if (n or 0) > 100}
    again = pack(df.repartition(7), "k", "n", 100, shard_containers=50).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert pack(df.limit(0), "k", "n", 100).count() == 0
