"""Periodic runs, near-duplicate vectors and divergence of sources against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import divergence, embedding_dedup, periodic_runs, queries, words
from test_text_operators import SCHEMA, WORD, corpus, prose, rows_of, sha

# periodic runs ----------------------------------------------------------------------------------------------------------


def runs_brute(w):
    """Every diagonal in full; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_brute(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed: int) -> list[str]:
    rng, w = random.Random(seed), []
    while rng.random() < 0.8:
        part = [f"w{rng.randrange(rng.choice([1, 2, 3, 60]))}" for _ in range(rng.randrange(1, 10))]
        w += part * rng.randrange(1, 9)
        if rng.random() < 0.2:
            w = (w * rng.randrange(1, 5))[:400]
    return w


def test_runs_of_many_texts_at_once_match_every_diagonal():
    for seed in range(0, 600, 4):
        texts = [repetitive(seed + k) for k in range(4)]
        split = words.split_words(pa.array([" ".join(t) for t in texts]))
        wanted = [(n, *r) for n, t in enumerate(texts) for r in runs_brute(t)]
        assert periodic_runs.find_runs(split.hashes(), split.first) == wanted


def test_runs_of_long_texts():
    rng = random.Random(3)
    for w in (["a"] * 3000, ["a", "b", "a"] * 900, [str(i % 333) for i in range(2500)],
              [rng.choice("ab") for _ in range(2500)], (["x"] * 40 + ["y"]) * 50):
        split = words.split_words(pa.array([" ".join(w)]))
        assert [r[1:] for r in periodic_runs.find_runs(split.hashes(), split.first)] == runs_brute(w)


def test_steps_of_the_search_stay_in_proportion_to_the_words(monkeypatch):
    compared = []
    real = periodic_runs.agreement
    monkeypatch.setattr(periodic_runs, "agreement", lambda a, b: compared.append(n := real(a, b)) or n)
    for w in (["a"] * 20000, ["a", "b"] * 10000, (["x"] * 50 + ["y"]) * 400):
        compared.clear()
        split = words.split_words(pa.array([" ".join(w)]))
        assert periodic_runs.find_runs(split.hashes(), split.first)
        assert sum(compared) < 40 * len(w) and len(compared) < len(w)


def test_runs_of_odd_rows(spark):
    rows = corpus() + [(50, "a b " * 9 + "c", "en", "s", 1), (51, "x x x x x x y y y y y y", "en", "s", 1), (52, "a a a a a", "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("runs", "best", "key", "collapsed", "n_words")})
    found = periodic_runs.periodic_runs(frame.repartition(3))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in found.collect()]
    wanted = []
    for key, text, *_ in rows:
        w = WORD.findall(text or "")
        runs = runs_brute(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        wanted.append((key, len(w), runs, best, collapsed_brute(w, runs)))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert periodic_runs.periodic_runs(frame.where("false")).count() == 0


def test_query_plants_and_digests_runs(spark, tmp_path):
    rows = [(i, prose(i, i % 90, 40), "en", "s", 0) for i in range(300)] + [(None, "a b c", "en", "s", 0), (301, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for key, text, *_ in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_brute(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        wanted.append((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                       sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed_brute(w, runs))))
    found = queries.repeated_runs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert sum(r[1] for r in wanted) > 10


# vectors ----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node long, cell int, digest string"


def vector_rows(seed: int = 0, n: int = 260, width: int = 6) -> list[tuple]:
    """Random vectors of few dimensions (many links at the threshold), dense groups, odd ones, repeated rows, a null key."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[:60] = x[0] + 0.1 * rng.normal(size=(60, width))
    x[60:90] = x[60] + 0.3 * rng.normal(size=(30, width))
    rows = [(i, v, i % 3 if i > 100 else 1) for i, v in enumerate(x.astype(np.float32).tolist())]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * width, [nan] + [1.0] * (width - 1), [inf] * width, [None] + [1.0] * (width - 1),
           [1.0] * (width - 1), [1.0] * width, [2.0] * width, [1e-30] * width, [3e38] * width, [0.0] * (width - 1) + [1.0],
           [-0.0] * (width - 1) + [1.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, x[0].tolist(), None), (None, x[0].tolist(), 1), (None, [5.0] * width, 7)]
    rows += [rows[3], rows[3], (999, rows[3][1], 1)]
    return [(*r, 0, 0, "") for r in rows]


def vectors_brute(rows, cosine=0.93):
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = []
    for _, v, label, *_ in rows:
        if label is None or not sound(v):
            unit.append(None)
            continue
        v = np.array(np.float32(v), float)
        v /= np.abs(v).max()
        unit.append(v / np.linalg.norm(v))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted([(r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)], key=str)


@pytest.mark.parametrize("seed, options", [
    (0, {}), (1, {"cell_rows": 8}), (2, {"cell_rows": 8, "block_rows": 10}), (3, {"cell_rows": 4, "sample_rows": 60}),
    (4, {"cell_rows": 1, "block_rows": 1})])
def test_vectors_match_all_pairs_whatever_the_cells(spark, seed, options):
    rows = vector_rows(seed)
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), **options)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == vectors_brute(rows)


def test_vectors_of_nothing(spark):
    frame = spark.createDataFrame(vector_rows(), VECTORS)
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0
    lone = embedding_dedup.near_vectors(frame.where("label IS NULL OR vec_id = 1000")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lone) == [(1000, 0, 1000, True), (2000, 0, 2000, True)]


def test_dense_group_meets_no_products(spark):
    """Near copies within half the angle of their centre are counted as a whole: the tasks of blocks get none of them."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    x = np.r_[base + 0.02 * rng.normal(size=(3000, 32)), rng.normal(size=(200, 32))]
    rows = [(i, v, 1, 0, 0, "") for i, v in enumerate(x.astype(np.float32).tolist())]
    frame = spark.createDataFrame(rows, VECTORS)
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, cell_rows=400).collect()}
    assert all(found[i].n_links == 2999 and found[i].component_id == 0 for i in range(3000))
    nodes = frame.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("id"), F.lit(1).alias("copies"), "label",
                         F.lit(32).alias("dim"), F.col("embedding").alias("vec"))
    centres = embedding_dedup.fit_centres(nodes.select("vec"), 8, 32, 0.93)
    links, ties = embedding_dedup._linked(nodes, centres, 0.93, 500, 32)
    assert ties.count() <= 3200 and links.count() <= 3400


def test_vectors_without_clusters_go_to_few_blocks(spark):
    """Directions at random lie near many planes between cells; a vector still goes to half the blocks of its label at most."""
    x = np.random.default_rng(3).normal(size=(4000, 48)).astype(np.float32)
    nodes = spark.createDataFrame([(i, "a", 48, 1, v) for i, v in enumerate(x.tolist())],
                                  "node long, label string, dim int, copies long, vec array<float>")
    centres = embedding_dedup.fit_centres(nodes.select("vec"), 40, 48, 0.93)
    placed = nodes.select("node", "label", "dim", "copies", "vec").mapInArrow(embedding_dedup._place(centres, 0.93), (
        "node long, label string, dim int, copies long, home int, best double, core boolean, near array<int>")).drop("near")
    layouts = embedding_dedup._layouts(placed, 1000)
    dealt = placed.drop("best").join(nodes.select("node", "vec"), "node").mapInArrow(
        embedding_dedup._deal(centres, 0.93, layouts, 8),
        "task int, label string, dim int, block int, visits boolean, node long, core int, copies long, vec array<float>")
    seen = dealt.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"),
                                     F.count_if(~F.col("visits")).alias("homes")).collect()
    assert len(seen) == 4000 and all(r.homes == 1 and r.n == r.blocks <= 3 for r in seen)


def test_tight_groups_of_a_block_meet_no_strangers():
    """Links are those of all pairs, and groups far apart are not multiplied with each other."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(20, 32)), 100, axis=0) + 0.05 * rng.normal(size=(2000, 32))
    x = x[rng.permutation(2000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = pa.RecordBatch.from_pydict({"vec": pa.array(x.tolist(), pa.list_(pa.float64())), "core": pa.array([-1] * 2000, pa.int32()),
                                       "copies": pa.array([1] * 2000, pa.int64()), "node": pa.array(range(2000), pa.int64())})
    home, alone = (embedding_dedup._Block(r, 32, 0.93) for r in ([rows.slice(0, 1500)], [rows]))
    home.among()
    visits = [v.to_pandas() for v in home.visit(rows.slice(1500))]
    alone.among()

    def links_at(block):
        return {r.node: r.links for t in block.totals() for r in t.to_pandas().itertuples() if r.node == r.node}

    met = x @ x.T >= 0.93
    np.fill_diagonal(met, False)
    assert links_at(alone) == {i: n for i, n in enumerate(met.sum(axis=1).tolist()) if n}
    met[1500:, 1500:] = False
    visiting = {int(n): int(k) for v in visits for n, k in zip(v["node"], v["links"]) if n == n}
    assert links_at(home) | visiting == {i: n for i, n in enumerate(met.sum(axis=1).tolist()) if n}
    chosen = sum(behind - first for first, behind, middle in alone.tiles if middle >= 0)
    assert chosen >= 1000 and len(alone.tiles) > 10  # groups around one leader; the leaders are drawn, some groups have none


def test_spanning_links_join_all_groups():
    rng = np.random.default_rng(1)
    met = np.triu(rng.random((80, 80)) < 0.03, 1)
    group = np.arange(80)
    tree = embedding_dedup.spanning_links(met, group, 0, 0)
    whole, part = list(range(80)), list(range(80))

    def tie(root, i, j):
        a, b = root[i], root[j]
        return [min(a, b) if r in (a, b) else r for r in root]

    for i, j in zip(*np.nonzero(met)):
        whole = tie(whole, i, j)
    for i, j in tree:
        assert met[i, j]
        part = tie(part, i, j)
    assert whole == part and len(tree) == 80 - len(set(whole))


# divergence -------------------------------------------------------------------------------------------------------------


def divergence_brute(rows, least, top):
    docs = [("" if g is None else g, "" if s is None else s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, g, s, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for g, s, w in docs:
            if g == lang:
                held.update(set(w))
                counts[s].update(w)
        kept = [t for t, n in held.items() if n >= least]
        whole = sum(counts.values(), Counter())
        totals = {s: sum(c[t] for t in kept) for s, c in counts.items()}

        def share(n, total):
            return 1 + 1000000000 * (n + 5) // (total + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(-sum(abs(share(c[t], totals[s]) - share(counts[o][t], totals[o])) for t in kept), o.encode())
                     for o in counts if o != s]
            over = [(share(whole[t], sum(totals.values())) - share(c[t], totals[s]), t.encode()) for t in kept if c[t]]
            over = sorted(x for x in over if x[0] < 0)[:top]
            for part, found in (("pair", sorted(pairs)), ("term", over)):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def spoken() -> list[tuple]:
    rng = random.Random(8)
    rows = list(corpus())
    for i in range(260):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s1", "Ä", None, "s2"])
        w = [f"{rng.choice('abÉx')}{rng.choice('TSü')}{chr(97 + min(25, int(rng.expovariate(0.2))))}" for _ in range(rng.randrange(30))]
        rows.append((100 + i, " ".join(w) + (" 12_3x-Y" if i % 7 else ""), lang, source, None))
    return rows + [(900, "only one", "de", "s0", None), (901, "", "es", "s0", None), (902, None, "es", "s1", None)]


@pytest.mark.parametrize("least, top, spill, width", [(5, 4, 400_000, "4"), (12, 50, 30, "7"), (10_000, 50, 400_000, "4")])
def test_divergence_matches_brute_force(spark, monkeypatch, least, top, spill, width):
    rows = spoken()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("term", "sources", "groups", "item")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    monkeypatch.setattr(divergence, "CELLS", 20)
    found = divergence.source_divergence(frame.repartition(5), least_docs=least, top=top, spill=spill)
    got = sorted(map(tuple, found.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == divergence_brute(rows, least, top)
    assert divergence.source_divergence(frame.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**13)
        n = rng.randrange(0, total + 1)
        assert int(divergence.shares(np.array([n]), total)[0]) == 1 + 1000000000 * n // total


def test_ties_at_the_last_rank_go_to_the_smaller_term():
    audit = divergence._Audit("en", ["a", "b"], [40, 40], 8, 3)
    names = ["h", "c", "b", "f", "a", "d", "g", "e"]
    audit.add(names, [["a"] if i % 2 == 0 else ["b"] for i in range(8)], [[10]] * 8)
    assert [t for _, t in audit.best[0]] == [b"a", b"b", b"g"]
    audit.add(["aa"], [["a"]], [[10]])
    assert [t for _, t in audit.best[0]] == [b"a", b"aa", b"b"]
