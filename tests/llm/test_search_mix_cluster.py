"""Ranked search, source mixing and centroid clustering against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefold.llm import centroids, ranked_search, source_mix

RNG = random.Random(5)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["the", "The", "THE", "a1", "öl", "ÖL", "日本", "x_y", "it's", "end!", "\x00nul", "naïve"] + ["".join(RNG.choice("abcdeé") for _ in range(RNG.randrange(1, 5))) for _ in range(60)]


def prose(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", "\n", "\t", "-", " "]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    same = prose(40)
    texts = [None, "", " .,! ", "the", "the the THE", same, same, same, prose(6000), "é" * 5000] + [prose(RNG.randrange(1, 90)) for _ in range(70)]
    rows = [(i * 5, t, f"s{RNG.randrange(4)}", "clash", 1) for i, t in enumerate(texts)] + [(25, same, "s0", "clash", 2), (25, same, "s0", "clash", 2), (None, same, None, None, None), (None, prose(9), None, None, None)]
    rows += [(1000 + i, prose(RNG.randrange(1, 4)), "hot", "x", 1) for i in range(120)] + [(2000, "one two three", "tiny", "x", 1), (2001, None, "void", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, score long").repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the öl abc"), (2, None), (3, ""), (4, "nothingever"), (5, prose(50)), (5, prose(3)), (None, "THE naïve"), (6, "the the it's the"), (7, "q " * 9000 + "a1")]
    return spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    """Every document scored for every item, as the formula says."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    documents, length = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 90 + (90 * n * documents) // length
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k,parts", [(10, False), (1, True), (500, False)])
def test_ranked_search(docs, items, k, parts, monkeypatch):
    if parts:  # items in several blocks, copied to shards
        monkeypatch.setattr(ranked_search, "ITEM_BYTES", 40)
        monkeypatch.setattr(ranked_search, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(ranked_search, "HELD_ITEMS", 2)
    rows = ranked_search.search(docs, items, k).collect()
    expected = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert Counter(map(tuple, rows)) == expected


def test_index_files_are_small(spark, docs, items, monkeypatch):
    """A file of the index holds a few blocks, however many a task wrote, so readers hold no more at once."""
    monkeypatch.setattr(ranked_search, "INDEX_BYTES", 20)
    files = []
    written = ranked_search.written

    def kept(df, name, **more):
        out = written(df, name, **more)
        if name == "index":
            files.extend(r["count"] for r in out.groupBy("_metadata.file_path").count().collect())
        return out

    monkeypatch.setattr(ranked_search, "written", kept)
    ranked_search.search(docs.coalesce(1), items).count()
    assert len(files) > 1 and max(files) <= ranked_search.BLOCKS_OF_A_FILE


def test_ranked_search_bounds():
    """Bytes bound impacts from above by less than a step, also where products exceed a long."""
    tf, n = np.array([1, 2, 7, 300, 1]), np.array([1, 50, 7, 100000, 10**9])
    exact = ranked_search.impacts(tf, n, 10**12, 10**14)
    assert exact.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(x) * 10**12 // 10**14)) for t, x in zip(tf, n, strict=True)]
    steps = -(-exact // ranked_search.STEP)
    assert (steps * ranked_search.STEP >= exact).all() and (steps * ranked_search.STEP - exact < ranked_search.STEP).all() and steps.max() <= 255
    assert -(-999_999 // ranked_search.STEP) <= 255


def test_ranked_search_empty(docs, items):
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("text is null or text = ''"), items).count() == 0


def brute_seats(shares, caps, total):
    """Seat after seat to the highest quotient."""
    seats = dict.fromkeys(shares, 0)
    for _ in range(total):
        open_ = [p for p in shares if shares[p] > 0 and seats[p] < caps[p]]
        if not open_:
            break
        seats[min(open_, key=lambda p: (-shares[p] / (2 * seats[p] + 1), p))] += 1
    return seats


def brute_mix(rows, shard_docs, weights=(5, 2, 1), repeats=3, block=source_mix.BLOCK, seed=1):
    """The mix by listing all words: (doc_id, size, source_size, target, taken) with repeats."""
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, int(hashlib.md5(f"{seed}:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)) for d, t, s in rows]
    names = sorted({s for *_, s, _ in sizes}, key=lambda s: (s is None, s))
    words, count = Counter(), Counter()
    for _, n, s, _ in sizes:
        words[s] += n
        count[s] += 1
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, rate = set(), 0.0
    while set(names) - capped:
        rate = (sum(words.values()) - sum(words[s] * repeats for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if weight[s] * rate > words[s] * repeats}
        if more <= capped:
            break
        capped |= more
    target = {s: float(words[s] * repeats) if s in capped else weight[s] * rate for s in names}
    seats = brute_seats({i: target[s] for i, s in enumerate(names)}, {i: -(-words[s] * repeats // block) for i, s in enumerate(names)}, sum(words.values()) // block)
    out = []
    for i, s in enumerate(names):
        shards = defaultdict(list)
        for d, n, of, place in sizes:
            if of == s:
                shards[place % max(-(-count[s] // shard_docs), 1)].append((place, d, n))
        runs = {h: sum(n for *_, n in x) for h, x in shards.items()}
        quota = brute_seats(runs, {h: -(-n * repeats // block) for h, n in runs.items()}, seats[i])
        for h, x in shards.items():
            run, wanted = runs[h], min(quota[h] * block, runs[h] * repeats)
            whole, rest = divmod(wanted, run) if run else (0, 0)
            taken, blocks = np.full(run, whole), run // block
            turn = (seed * 7919 + i * 104729 + h * 1299709) % (2**31 - 1)
            order = sorted(range(blocks), key=lambda b: (source_mix.PRIMES[turn % len(source_mix.PRIMES)] * b + turn) % blocks) + [blocks]
            for b in order:
                some = min(rest, block)
                taken[b * block : b * block + some] += 1
                rest -= some
            at = 0
            for _, d, n in sorted(x, key=lambda r: (r[0], r[1] or 0, r[2])):
                out.append((d, n, words[s], target[s], int(taken[at : at + n].sum())))
                at += n
            assert taken.sum() == wanted
    return Counter(out)


@pytest.mark.parametrize("shard_docs", [source_mix.SHARD_DOCS, 7])
def test_source_mix(docs, shard_docs, monkeypatch):
    monkeypatch.setattr(source_mix, "SHARD_DOCS", shard_docs)
    expected = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], shard_docs)
    rows = source_mix.mix(docs).collect()
    assert Counter(map(tuple, rows)) == expected
    assert Counter(map(tuple, source_mix.mix(docs.repartition(2)).collect())) == expected
    taken = Counter()
    for r in rows:
        taken[r.target, r.source_size] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(n - t) <= 2 * source_mix.BLOCK for (t, _), n in taken.items())
    assert source_mix.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in source_mix.mix(docs.where("text is null")).collect())


def test_apportion(spark):
    """The few ranked quotients give what dealing seat by seat gives; odd shares, ties, full parties."""
    rng = random.Random(3)
    rows, expected = [], {}
    for g in range(40):
        n, seats = rng.randrange(1, 12), rng.randrange(0, 60)
        shares = {i: rng.choice([0, 1, 1, 5, rng.randrange(1, 900), rng.randrange(1, 9) / 7]) for i in range(n)}
        total = sum(shares.values())
        caps = {i: rng.choice([seats, max(1, math.ceil(shares[i] * seats / max(total, 1e-9)))]) if total else 3 for i in shares}
        if total:
            expected |= {(g, i): s for i, s in brute_seats(shares, caps, seats).items()}
        rows += [(g if g else None, i, float(s), caps[i], seats if total else 0) for i, s in shares.items()]
        expected |= {(g, i): 0 for i in shares if not total}
    df = spark.createDataFrame(rows, "g long, i long, share double, cap long, wanted long")
    got = {(r.g or 0, r.i): r.seats for r in source_mix.apportion(df, ["g"], "i", "share", F.col("wanted"), "cap").collect()}
    assert got == expected


def brute_clusters(rows, k, dims, scale, rounds, seed=1):
    top = centroids.limit_of(dims)
    kept = []
    for v, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((v, [int(min(max(math.floor(scale * c) if abs(scale * c) < 1e300 else math.copysign(1e300, c), -top), top)) for c in x]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centers = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centers))

    for turn in range(rounds + 1):
        best = [nearest(x) for _, x in kept]
        if turn < rounds:
            for c in range(len(centers)):
                own = [x for (_, x), (_, i) in zip(kept, best, strict=True) if i == c]
                if own:
                    centers[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inertia = Counter()
    for d, i in best:
        inertia[i] += d
    return Counter((v, i, d, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[i])).encode()).hexdigest()) for (v, _), (d, i) in zip(kept, best, strict=True))


def vectors(rng, n, dims, spread):
    middles = [[rng.gauss(0, 4) for _ in range(dims)] for _ in range(9)]
    return [(i * 3, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("k,rounds,spread", [(16, 3, 0.05), (16, 8, 1.5), (40, 6, 0.6), (1, 3, 1.0), (2, 0, 1.0)])
def test_centroids(spark, k, rounds, spread):
    rng = random.Random(k + rounds)
    rows = vectors(rng, 300, 4, spread)
    one = rows[0][1]
    rows += [(0, one), (0, one), (None, one), (None, [9.0] * 4), (901, None), (902, []), (903, [1.0, 2.0, 3.0]), (904, [1.0, None, 3.0, 4.0]), (905, [1.0, float("nan"), 1.0, 1.0]), (906, [float("inf")] * 4), (907, [1e30, -1e30, 0.0, 0.0]), (908, [3e38] * 4)]
    rows += [(1000 + i, [0.0] * 4) for i in range(40)]  # ties: many equal vectors, some of them seeds
    df = spark.createDataFrame([(v, x, "clash", 1) for v, x in rows], "vec_id long, embedding array<double>, cluster string, distance long").repartition(3)
    efforts = []
    got = centroids.report(df, k=k, dims=4, rounds=rounds, efforts=efforts).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows, k, 4, 64, rounds)
    if (k, rounds) == (40, 6):  # settled vectors are not looked at again
        assert efforts[-1] < efforts[0] / 2


def test_centroids_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.report(spark.createDataFrame([], schema)).count() == 0
    assert centroids.report(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    rows = [(i, [float(i), 0.5]) for i in range(5)]  # fewer vectors than centroids
    assert Counter(map(tuple, centroids.report(spark.createDataFrame(rows, schema), dims=2).collect())) == brute_clusters(rows, 16, 2, 64, 3)
