"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from morphspark.llm import embedding_dedup, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, source string, _maybe int, _digest string, _rank int, _hash long, _gone long, h long, n long, tier int, id long, key string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def odd(spark):
    """Nulls anywhere, empty and long texts, repeated rows, columns named as those that operators make."""
    long = words(random.Random(3), 30_000)
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "a b c", None), (None, None, None), (3, "", "y"), (4, "", "y"), (5, " \n\t ", "y"), (6, long, "x"), (7, long, "z"), (8, "ünï cödé 東京 🎅", None)]
    return spark.createDataFrame([(i, t, s, 1, "d", 2, 3, 4, 5, 6, 7, 8, "k") for i, t, s in rows], ODD)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 5 exact dedup


def test_exact_dedup(spark):
    rng = random.Random(1)
    texts = [words(rng, 5, 12) for _ in range(400)]
    rows = [(i, texts[rng.randrange(400)], "s") for i in range(900)]
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(first.values())
    assert got.columns == frame(spark, rows).columns


def test_exact_dedup_small_filter_changes_nothing(spark):
    rows = [(i, f"text {i % 70}", "s") for i in range(3000)]
    got = exact_dedup.exact_dedup(frame(spark, rows), max_filter_bytes=1 << 10)
    assert sorted(r.doc_id for r in got.collect()) == list(range(70))


def test_exact_dedup_odd(spark):
    got = exact_dedup.exact_dedup(odd(spark))
    assert got.columns == odd(spark).columns
    assert Counter((r.doc_id, r.text is None) for r in got.collect()) == Counter([(1, False), (2, True), (None, True), (3, False), (5, False), (6, False), (8, False)])
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# 8 near dedup


def jaccard(a, b):
    pair = lambda t: set(zip(t.split(), t.split()[1:]))
    x, y = pair(a), pair(b)
    return len(x & y) / len(x | y)


def test_near_groups_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        base = words(rng, 80).split()
        for _ in range(rng.choice([1, 2, 3, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(copy), "s"))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = 0
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= near_dedup.THRESHOLD:
                edges += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    want = {i: r for i, r in want.items() if Counter(want.values())[r] > 1}
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert edges > 60 and set(got) <= set(want)
    agree = sum(got.get(i) == r for i, r in want.items())
    assert agree >= 0.95 * len(want)
    kept = {r.doc_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert kept == {i for i in range(len(rows)) if got.get(i, i) == i}


def pairs_at(own, n):
    """n pairs of documents, alike to no others, that share 60 shingles of 61 words and have so many of their own."""
    rows = []
    for k in range(n):
        for side in "ab":
            rows.append((len(rows), " ".join([f"p{k}c{i}" for i in range(61)] + [f"p{k}{side}{i}" for i in range(own)]), "s"))
    return rows


def test_near_recall_at_the_threshold(spark):
    rows = pairs_at(20, 3000)
    assert near_dedup.THRESHOLD <= jaccard(rows[0][1], rows[1][1]) < 0.61
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert all(got[i] == i - i % 2 for i in got)
    assert len(got) / 2 >= 0.9 * 3000


def test_near_odd(spark):
    got = {(r.doc_id, r.group_id, r.keep) for r in near_dedup.near_groups(odd(spark)).collect()}
    assert got == {(6, 6, True), (7, 6, False)}
    out = near_dedup.near_dedup(odd(spark))
    assert out.columns == odd(spark).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 1, 2, None, None, 3, 4, 5, 6, 8])
    assert near_dedup.near_groups(empty(spark)).count() == near_dedup.near_dedup(empty(spark)).count() == 0


def test_near_keys_are_shared_alike():
    col = pa.array(["a b c d e f g h", "A, b c d e f g h!", "z", "a b c d e f g h i j k l m n o p q r s t u v w x y", "a b c d e f g h i j k l m n o p q r s t u v w x z"])
    out = list(near_dedup._keys(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), col], ["id", "text"])])))[0].to_pylist()
    by = {r["id"]: r for r in out}
    assert by[1]["whole"] == by[2]["whole"] and by[2]["twin"] == 1 and by[1]["twin"] is None and not by[2]["keys"]
    assert len(by[3]["keys"]) == near_dedup.U * near_dedup.V
    assert len(by[5]["keys"]) + len(by[5]["shared"]) == near_dedup.U * near_dedup.V and set(by[5]["shared"]) <= set(by[4]["keys"]) and set(by[5]["heads"]) == {4}


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_near_groups_with_a_set_and_a_key_that_most_share(spark, monkeypatch, block):
    """Half of all rows copies of one text, a quarter near copies of it, over many batches; repeated ids; chains that only members link."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(25)
    base = words(rng, 60).split()
    rows = [(i, " ".join(base), "s") for i in range(0, 400, 2)]
    for i in range(1, 200, 2):
        copy = list(base)
        for _ in range(rng.choice([1, 4, 8, 9])):
            copy[rng.randrange(60)] = f"w{rng.randrange(4000)}"
        rows.append((i, " ".join(copy), "s"))
    rows += [(i, words(rng, 60), "s") for i in range(201, 260, 2)] + rows[:20]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {r.doc_id: r.group_id for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {i: t for i, t, _ in rows}
    reps = {t: min(i for i, x in texts.items() if x == t) for t in set(texts.values())}
    root = {t: t for t in reps}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in reps:
        for b in reps:
            if a < b and jaccard(a, b) >= near_dedup.THRESHOLD:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[find(t)].append(i)
    want = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    assert set(got) <= set(want) and all(want[i] <= r for i, r in got.items())
    assert sum(got.get(i) == r for i, r in want.items()) >= 0.98 * len(want) and got[398] == 0


# 3 mixing


def brute_mix(rows, fractions, power):
    import hashlib

    n = lambda t: len((t or "").split())
    h = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((h(i), n(t), i))
    total = {s: sum(x[1] for x in v) for s, v in by.items()}
    weight = {s: t**power for s, t in total.items()}
    out = []
    for s, v in by.items():
        sums = Counter()
        for k, m, _ in v:
            sums[k] += m
        run, upto = 0, {}
        for k in sorted(sums):
            run += sums[k]
            upto[k] = run
        room = [int(f * sum(total.values()) * weight[s] / (sum(weight.values()) or 1) + 1e-6) for f in fractions]
        for k, m, i in v:
            tier = next((j for j, r in enumerate(room) if upto[k] <= r), None)
            if tier is not None:
                out.append((i, s, m, tier))
    return sorted(out, key=repr)


def test_mixing_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i if i % 50 else None, words(rng, rng.randrange(0, 60)) if i % 31 else None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(700)]
    assert rows_of(mixing.mix_tiers(frame(spark, rows))) == brute_mix(rows, mixing.FRACTIONS, mixing.POWER)


def test_mixing_given_weights_and_odd(spark):
    got = mixing.mix_tiers(odd(spark), weights={"x": 1.0})
    assert {r.source for r in got.where("n_tokens > 0").collect()} <= {"x"}
    out = mixing.mix_sources(odd(spark))
    assert out.columns == odd(spark).columns
    assert mixing.mix_tiers(empty(spark)).count() == mixing.mix_sources(empty(spark)).count() == 0


# 6 packing


def test_best_fit_and_bound():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 80))
        bins, used = packing.best_fit(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and used == len(set(bins))
        assert packing.lower_bound(sizes, 100) <= used
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5  # two in a bin, where volume alone says 4


def test_lower_bound_never_exceeds_the_optimum():
    def optimum(sizes, rooms=()):
        if not sizes:
            return len(rooms)
        s, rest, best = sizes[0], sizes[1:], 99
        for k, r in enumerate(rooms):
            if r >= s:
                best = min(best, optimum(rest, (*rooms[:k], r - s, *rooms[k + 1 :])))
        return min(best, optimum(rest, (*rooms, 20 - s)))

    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(7)), reverse=True)
        assert packing.lower_bound(np.array(sizes), 20) <= optimum(sizes)


def test_best_fit_against_the_rule_and_the_optimum():
    def by_rule(sizes, capacity):
        rooms, out = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in rooms if r >= sizes[i]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - sizes[i])
            out[i] = len(rooms)
        return len(rooms)

    def optimum(sizes, rooms=()):
        if not sizes:
            return len(rooms)
        s, rest, best = sizes[0], sizes[1:], 99
        for k, r in enumerate(rooms):
            if r >= s:
                best = min(best, optimum(rest, (*rooms[:k], r - s, *rooms[k + 1 :])))
        return min(best, optimum(rest, (*rooms, 20 - s)))

    rng = random.Random(14)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(7)]
        used = packing.best_fit(np.array(sizes), 20)[1]
        assert used == by_rule(sizes, 20)
        assert optimum(sorted(sizes, reverse=True)) <= used <= 11 / 9 * optimum(sorted(sizes, reverse=True)) + 1


def test_packing_certificates_add_up(spark):
    """Hard sizes in small parts, one id for all rows, so that several turns repack them."""
    rng = random.Random(15)
    rows = [(1, words(rng, rng.choice([700, 683, 1024, 1025, 341, 900, 410, 2048, 4100])), "s") for _ in range(400)]
    got = packing.pack(frame(spark, rows), items_per_partition=20).collect()
    assert sum(r.n_tokens for r in got) == sum(len(t.split()) for _, t, _ in rows)
    bins, sizes, said = defaultdict(set), defaultdict(list), {}
    for r in got:
        p = r.bin_id if r.part is None else r.part
        bins[p].add(r.bin_id)
        sizes[p].append(r.n_tokens)
        assert said.setdefault(p, (r.part_bins, r.part_bound)) == (r.part_bins, r.part_bound)
    for p, (took, least) in said.items():
        assert took == len(bins[p]) and packing.lower_bound(np.array(sizes[p]), packing.CAPACITY) == least <= took
    assert sum(t for t, _ in said.values()) == len({r.bin_id for r in got})
    assert max(Counter(np.repeat([r.bin_id for r in got], [r.n_tokens for r in got])).values()) <= packing.CAPACITY
    assert len({r.part >> 40 for r in got if r.part is not None}) > 1


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([0, 3, 40, 700, 1500, 2048, 5000])), "s") for i in range(300)]
    got = packing.pack(frame(spark, rows), items_per_partition=50).collect()
    n = {i: len(t.split()) for i, t, _ in rows}
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        if r.bin_id is not None:
            load[r.bin_id] += r.n_tokens
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
    assert max(load.values()) <= packing.CAPACITY
    for i, k in n.items():
        at = 0
        for s, m in sorted(pieces[i]):
            assert s == at
            at += m
        assert at == k
    for r in got:
        assert r.bin_id is None or r.part_bound <= r.part_bins
    assert len(load) <= -(-sum(n.values()) // packing.CAPACITY) * 1.1 + 3


def test_packing_odd(spark):
    got = packing.pack(odd(spark)).collect()
    assert Counter(r.doc_id for r in got if r.n_tokens == 0) == Counter([2, None, 3, 4, 5])
    assert sum(r.n_tokens for r in got) == 3 * 3 + 2 * 30_000 + 4
    assert packing.pack(empty(spark)).count() == 0


def test_packing_full_pieces_of_repeated_and_null_ids(spark):
    rng = random.Random(16)
    rows = [(i, words(rng, n), "s") for i, n in ((7, 5000), (7, 5000), (7, 4096), (None, 4096), (None, 6500), (None, 2048), (8, 2048))]
    got = packing.pack(frame(spark, rows + rows[:1])).collect()
    assert all(r.bin_id is not None for r in got)
    pieces = lambda n: [(s, min(packing.CAPACITY, n - s)) for s in range(0, n, packing.CAPACITY)]
    assert Counter((r.doc_id, r.start_token, r.n_tokens) for r in got) == Counter((i, *p) for i, t, _ in rows + rows[:1] for p in pieces(len(t.split())))
    load, parts = Counter(), defaultdict(set)
    for r in got:
        load[r.bin_id] += r.n_tokens
        parts[r.part if r.part is not None else r.bin_id].add((r.bin_id, r.part_bins))
    assert max(load.values()) <= packing.CAPACITY
    assert all(len(p) == n for p in parts.values() for _, n in p)


# 4 line dedup


def brute_lines(rows, run=3, least=25):
    seen, out = set(), []
    for i, t, _ in sorted(rows):
        if t is None:
            out.append((i, None, 0))
            continue
        every, gone = t.split("\n"), set()
        for k in range(len(every)):
            for n in range(1, min(run, len(every) - k) + 1):
                g = tuple(every[k : k + n])
                if n < run and sum(c.isalnum() for c in "".join(g)) < least:
                    continue
                if g in seen:
                    gone.update(range(k, k + n))
                seen.add(g)
        out.append((i, "\n".join(x for k, x in enumerate(every) if k not in gone), len(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    block = ["same one", "same two", "", "same three", "same four"]
    rows = []
    for i in range(120):
        lines = [f"line {rng.randrange(40)}" for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.5:
            lines[2:2] = block[: rng.randrange(2, 6)]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["one line that is long enough to count by itself", "zwölf lange Wörter, äöü", "half as long as need", "thirteen more"]))
        rows.append((i, "\n".join(lines) if i % 17 else None, "s"))
    got = sorted((tuple(r) for r in line_dedup.line_dedup(frame(spark, rows)).collect()), key=lambda r: r[0])
    assert got == brute_lines(rows)


def test_line_dedup_odd(spark):
    got = line_dedup.line_dedup(odd(spark))
    assert got.columns == ["doc_id", "text", "n_deleted"] and got.count() == odd(spark).count()
    long = "\n".join(f"x{k}" for k in range(50_000))
    two = line_dedup.line_dedup(frame(spark, [(1, long, "s"), (2, long, "s"), (2, long, "s")])).orderBy("doc_id").collect()
    assert [r.text for r in two] == [long, "", ""] and two[1].n_deleted == 50_000
    assert line_dedup.line_dedup(empty(spark)).count() == 0


# 7 suffix arrays


def brute_repeats(rows, length):
    where = defaultdict(list)
    for i, t, _ in rows:
        if i is not None and t is not None:
            w = t.split()
            for k in range(len(w) - length + 1):
                where[tuple(w[k : k + length])].append((i, k))
    flags = defaultdict(dict)
    for at in where.values():
        if len(at) > 1:
            for p in at:
                flags[p[0], p == min(at)][p[1]] = True
    out = []
    for (i, first), places in flags.items():
        merged = []
        for k in sorted(places):
            if merged and k <= merged[-1][1]:
                merged[-1][1] = k + length
            else:
                merged.append([k, k + length])
        out += [(i, a, b - a, first) for a, b in merged]
    return sorted(out)


@pytest.mark.parametrize("in_memory", [64 << 20, 0])
def test_suffix_repeats(spark, in_memory):
    rng = random.Random(11)
    passages = [words(rng, rng.randrange(12, 40)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 30), 50 if i % 5 == 0 else 4000)]
        parts += rng.sample(passages, rng.randrange(0, 3)) + [words(rng, 5)]
        rows.append((i, " ".join(parts), "s"))
    rows += [(40, rows[3][1], "s"), (41, "a " * 100, "s"), (42, None, "s")]
    got = sorted(tuple(r) for r in suffix_dedup.repeats(frame(spark, rows), length=10, gram=4, in_memory=in_memory).collect())
    assert got == brute_repeats(rows, 10)


@pytest.mark.parametrize("length", [255, 256, 300])
def test_suffix_repeats_of_long_windows(spark, length):
    rng = random.Random(21)
    shared = words(rng, 400)
    rows = [(i, " ".join([words(rng, 30 + i), shared, words(rng, 20)]), "s") for i in range(3)]
    got = sorted(tuple(r) for r in suffix_dedup.repeats(frame(spark, rows), length=length).collect())
    assert got == brute_repeats(rows, length) and len(got) == 3


@pytest.mark.parametrize("seeds", [suffix_dedup.SEEDS, ()])
def test_suffix_repeats_of_a_frequent_minimiser(spark, monkeypatch, seeds):
    """One phrase in all texts, amid unlike words in most and like ones in some."""
    monkeypatch.setattr(suffix_dedup, "SEEDS", seeds)
    rng = random.Random(22)
    phrase, like = words(rng, 4), [words(rng, 9), words(rng, 9)]
    rows = []
    for i in range(150):
        around = like if i % 7 == 0 else [words(rng, 9), words(rng, 9)]
        rows.append((i, " ".join([words(rng, rng.randrange(5)), around[0], phrase, around[1], words(rng, 3)]).strip(), "s"))
    got = sorted(tuple(r) for r in suffix_dedup.repeats(frame(spark, rows), length=10, gram=4, most_pieces=5).collect())
    assert got == brute_repeats(rows, 10) and len(got) > 20


def test_suffix_array_construction(tmp_path):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 12, 20)
    rows = np.concatenate([[0], np.cumsum(n)])
    s = rng.integers(0, 3, rows[-1])
    piece, offset, lcp, before = suffix_dedup.build(s, rows, 255, str(tmp_path), in_memory=0)
    suffix = [tuple(s[rows[p] + o : rows[p + 1]]) for p, o in zip(piece, offset)]
    assert suffix == sorted(suffix) and len(suffix) == rows[-1] + len(n)
    for k in range(1, len(suffix)):
        a, b = suffix[k - 1], suffix[k]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [int(x) for x in before] == [int(s[rows[p] + o - 1]) if o else -1 for p, o in zip(piece, offset)]


def test_suffix_odd(spark):
    got = {(r.doc_id, r.start_word, r.n_words, r["first"]) for r in suffix_dedup.repeats(odd(spark)).collect()}
    assert got == {(6, 0, 30_000, True), (7, 0, 30_000, False)}
    assert suffix_dedup.repeats(empty(spark)).count() == 0


# 2 embeddings


def test_embedding_groups(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 24))
    vectors = [v for b in base for v in [b, *(b + rng.standard_normal(24) * rng.choice([0.02, 0.05, 0.12]) for _ in range(rng.integers(0, 3)))]]
    x = np.array(vectors, np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= embedding_dedup.THRESHOLD, 1))
    want = np.arange(len(x))
    embedding_dedup.unite(want, a, b)
    want = {i: int(r) for i, r in enumerate(want) if (want == r).sum() > 1}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for options in ({}, {"node": 100, "leaf": 30}):
        got = {r.vec_id: r.group_id for r in embedding_dedup.embedding_groups(df, **options).collect()}
        assert set(got) <= set(want)
        assert sum(got.get(i) == r for i, r in want.items()) >= 0.9 * len(want)


def test_embedding_recall_in_a_crowded_deep_forest(spark):
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, pairs, dim = 20_000, 1000, 64
    x = unit(np.sqrt(0.8) * unit(rng.standard_normal(dim)) + np.sqrt(0.2) * unit(rng.standard_normal((n, dim))))  # one cluster, cosine 0.8
    off = rng.standard_normal((pairs, dim))
    off = unit(off - (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.952 * x[:pairs] + np.sqrt(1 - 0.952**2) * off]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {r.vec_id: r.group_id for r in embedding_dedup.embedding_groups(df, leaf=16, node=6000).collect()}
    assert sum(got.get(i) == got.get(n + i) == i for i in range(pairs)) >= 0.9 * pairs
    assert embedding_dedup.trees_for(10**6, 128, 0.05) > embedding_dedup.trees_for(10**5, 128, 0.05) > embedding_dedup.TREES == embedding_dedup.trees_for(2000, 128, 0.05)


def test_embedding_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, []), (5, None), (None, [1.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (9, [None, 1.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, node int, tree int")
    got = {(r.vec_id, r.group_id, r.keep) for r in embedding_dedup.embedding_groups(df).collect()}
    assert got == {(1, 1, True), (2, 1, False)}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_groups(same, leaf=16, node=100).where("group_id = 0").count() == 500
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


# 1 quality


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    u, trans, rows = rng.standard_normal(7), rng.standard_normal((2, 2)), np.array([0, 3, 3, 7])
    got, pairs = quality.marginals(u, rows, trans, True)
    want, expected = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(rows, rows[1:]):
        total, top = 0.0, np.zeros(b - a)
        cells = np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            p = np.exp(sum(u[a + k] * y[k] for k in range(b - a)) + sum(trans[y[k - 1], y[k]] for k in range(1, b - a)))
            total += p
            top += p * np.array(y)
            for k in range(1, b - a):
                cells[y[k - 1], y[k]] += p
        if b > a:
            want[a:b] = top / total
            expected += cells / total
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.quality(docs, train).join(held.select("doc_id", held.quality.alias("y")), "doc_id").where("quality is not null").collect()
    assert np.mean([r.good == (r.y == 1) for r in got]) >= 0.85


def test_quality_against_enumeration():
    """Document quality, lines and bad lines from all labellings of a small text."""
    from itertools import product

    rng = np.random.default_rng(5)
    f = quality.Field(np.zeros((0, quality.N_OWN)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64))
    f.w, f.trans = rng.standard_normal(len(f.w)), rng.standard_normal((2, 2))
    texts = ["One line.\n\n&&& *** $$$\nanother line, of words\nOne line.", "", " \n\t", "x"]
    got = f.quality(pa.array(texts))
    for k, text in enumerate(texts):
        b = np.frombuffer(text.encode(), np.uint8)
        x, n, rows = quality.features(b, np.array([0, len(b)]))
        each = text.split("\n")
        assert n.tolist() == [len(v.replace(" ", "").replace("\t", "")) for v in each] and got[1][k] == len(each)
        u = quality.with_neighbours(x, rows) @ f.w
        total, top = 0.0, np.zeros(len(each))
        for y in product((0, 1), repeat=len(each)):
            p = np.exp(np.dot(u, y) + sum(f.trans[a, c] for a, c in zip(y, y[1:])))
            total, top = total + p, top + p * np.array(y)
        if n.sum():
            assert abs(got[0][k] - (top / total * n).sum() / n.sum()) < 1e-5
            assert got[2][k] == ((top / total < 0.5) & (n > 0)).sum()
        else:
            assert np.isnan(got[0][k])


def test_quality_tells_lines_of_mixed_documents(spark):
    """Fitted on even ids; junk of unseen bad documents set into unseen good ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").where("text is not null").orderBy("doc_id").collect()
    good, bad = ([r.text.split("\n") for r in held if r.quality == k and r.text.count("\n") >= 4] for k in (1, 0))
    rng = random.Random(4)
    texts, truth = [], []
    for _ in range(200):
        g, j = rng.choice(good), rng.choice(bad)
        k, a = rng.randrange(1, len(g)), rng.randrange(0, len(j) - 3)
        texts.append("\n".join(g[:k] + j[a : a + 4] + g[k:]))
        truth += [1] * k + [0] * 4 + [1] * (len(g) - k)
    said, size = [], []
    for text in texts:
        b = np.frombuffer(text.encode(), np.uint8)
        p, n, _ = field.lines(b, np.array([0, len(b)]))
        said.append(p >= 0.5)
        size.append(n)
    said, truth, some = np.concatenate(said), np.array(truth) == 1, np.concatenate(size) > 0
    assert said[some & truth].mean() >= 0.95 and said[some & ~truth].mean() <= 0.1


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd(spark), labels).collect()
    assert len(got) == odd(spark).count()
    assert all((r.quality is None) == (r.doc_id in (2, 3, 4, 5) or (r.doc_id is None and r.n_lines == 1 and r.quality is None)) for r in got) and not any(r.good for r in got if r.quality is None)
    assert {r.quality for r in quality.quality(odd(spark), labels.limit(0)).where("doc_id = 1").collect()} == {0.5}
    assert quality.quality(empty(spark), labels).count() == 0


# 9 toxicity


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.1
    rate = np.where(np.arange(m) % 2, 0.5, 0.7)
    v = rng.random((n, m)) < np.where(y[:, None], rate, 0.02)
    v[:, 1] = v[:, 0]  # one that only repeats another
    p, c = np.unique(v @ (1 << np.arange(m)), return_counts=True)
    model = toxicity.LabelModel(p, c.astype(float))
    post = dict(zip(p.tolist(), model.posterior((p[:, None] >> np.arange(m)) & 1)))
    score = np.array([post[int(x)] for x in v @ (1 << np.arange(m))])
    assert np.mean((score > 0.5) == y) > 0.99 and abs(model.prior[1] - 0.1) < 0.02
    assert model.parent[1] == 0 or model.parent[0] == 1


def test_toxicity_on_labelled_documents(spark):
    """Labels are noisy: some toxic ones stand on texts without a toxic word."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels=labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").select("toxic", "y").collect()
    assert sum(r.toxic and r.y == 1 for r in got) >= 0.85 * sum(r.y == 1 for r in got)
    assert sum(r.toxic and r.y == 0 for r in got) <= 0.01 * len(got)
    english = docs.where("lang = 'en'").join(labels, "doc_id").select("doc_id", "text", labels.toxic.alias("y"))
    plain = toxicity.toxicity(docs).join(english, "doc_id").select("toxic", "y").collect()  # the written lexicons alone
    assert sum(r.toxic and r.y == 1 for r in plain) >= 0.9 * sum(r.y == 1 for r in plain)


def test_stems_against_brute_force(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        text = words(rng, 60) + "".join(f" zorgl{rng.randrange(90)}" for _ in range(4 if toxic else rng.choice([0, 0, 1])))
        rows.append((i, text, "s"))
        labels.append((i, int(toxic)))
    known = toxicity.stems(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {toxicity.word_hash("zorgl"[:n]) for n in (4, 5)} <= {int(h) for h in known} and len(known) <= 20
    said = {r.doc_id for r in toxicity.toxicity(frame(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, toxic int")).where("toxic").collect()}
    assert len(said & {i for i, y in labels if y}) >= 45 and len(said - {i for i, y in labels if y}) <= 3


def test_toxicity_odd(spark):
    got = toxicity.toxicity(odd(spark)).collect()
    assert len(got) == odd(spark).count() and not any(r.toxic for r in got if r.doc_id in (2, 3, 4, 5))
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd(spark), labels=labels).count() == odd(spark).count()
    out = toxicity.drop_toxic(odd(spark), labels=labels)
    assert out.columns == odd(spark).columns
    assert toxicity.toxicity(empty(spark)).count() == toxicity.drop_toxic(empty(spark)).count() == 0


# 10 personal data


def test_tagger_gradient():
    t = pii.Tagger(3, 3)
    g = np.random.default_rng(0)
    ids, tags = g.integers(0, pii.VOCABULARY, (6, 2)), np.array([[0, 0], [1, 0], [1, 2], [0, 2], [3, 2], [3, 0]])
    for p in t.p:
        t.p[p] = t.p[p].astype(np.float64)
    _, grad = t.gradient(ids, tags)
    for name in ("uf", "ub", "xf", "of", "b", "t"):
        at = tuple(0 for _ in t.p[name].shape) if name != "xf" else (int(ids[2, 0]), 1)
        keep = t.p[name][at]
        step = 1e-3
        t.p[name][at] = keep + step
        up, _ = t.gradient(ids, tags)
        t.p[name][at] = keep - step
        down, _ = t.gradient(ids, tags)
        t.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


def test_pii_held_out_and_long_texts(spark):
    tagger = pii.trained()
    hit = said = want = 0
    for text, tags in pii.labelled(200, 999):
        b = np.frombuffer(text.encode(), np.uint8)
        got = {x[1:4] for x in tagger.spans(b, np.array([0, len(b)]))}
        edge = np.flatnonzero(np.diff(tags, prepend=-1) != 0)
        true = {(int(s), int(e), int(tags[s])) for s, e in zip(edge, np.append(edge[1:], len(tags))) if tags[s]}
        hit, said, want = hit + len(got & true), said + len(got), want + len(true)
    assert hit >= 0.9 * said and hit >= 0.9 * want
    rng = random.Random(2)
    parts, spans = [], []
    at = 0
    for k in range(300):
        w = words(rng, rng.randrange(10, 40)) + " "
        mail = f"anna.{k}@mail{k % 9}.example.com"
        parts += [w, mail, " "]
        spans.append((at + len(w), at + len(w) + len(mail)))
        at += len(w) + len(mail) + 1
    text = "".join(parts)
    found = {(r.start, r.end) for r in pii.find_pii(frame(spark, [(1, text, "s")])).collect()}
    assert len(found & set(spans)) >= 0.9 * len(spans)


def spans_of(tags):
    edge = np.flatnonzero(np.diff(tags, prepend=-1) != 0)
    return {(int(s), int(e), int(tags[s])) for s, e in zip(edge, np.append(edge[1:], len(tags))) if tags[s]}


def test_pii_windows_meet():
    """Reading in windows gives what one window over the whole gives."""
    tagger = pii.trained()
    text = " ".join(t for t, _ in pii.labelled(12, 5))
    b = np.frombuffer(text.encode(), np.uint8)
    parts = {x[1:4] for x in tagger.spans(b, np.array([0, len(b)]))}
    codes = np.array([ord(c) for c in text], np.uint32)
    one = spans_of(tagger.best_tags(tagger.scores(codes, np.array([0]), np.array([len(codes)]))[:, :, 0], np.array([0, len(codes)])))
    assert len(parts & one) >= 0.97 * max(len(parts), len(one))


def test_pii_long_spans_at_seams():
    """A key as long as the overlap is found whole wherever the seam of two windows falls."""
    tagger, rng = pii.trained(), random.Random(6)
    key = "".join(rng.choice("0123456789abcdef") for _ in range(64))
    filler = "".join(rng.choice("abcdefghijklm   ") for _ in range(900))
    for at in range(pii.WINDOW - pii.OVERLAP - 70, pii.WINDOW + 10, 7):
        text = f"{filler[:at]} secret = {key} {filler[at:]}"
        b = np.frombuffer(text.encode(), np.uint8)
        assert key in {x[4] for x in tagger.spans(b, np.array([0, len(b)]))}


def test_pii_best_path_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(8)
    tagger = pii.Tagger()
    for turn in range(30):
        tagger.p["t"] = rng.normal(0, 2, (pii.TAGS, pii.TAGS)).astype(np.float32)
        size = np.array([4, 3, 1])
        e = rng.normal(0, 2, (4, pii.TAGS, 3)).astype(np.float32)
        trans = tagger.p["t"] + pii._FORBIDDEN
        for j, got in enumerate(tagger._best(e, size)):
            score = lambda y: sum(e[i, k, j] for i, k in enumerate(y)) + sum(trans[a, c] for a, c in zip(y, y[1:]))  # noqa: B023, E731
            assert score(tuple(got)) >= max(map(score, product(range(pii.TAGS), repeat=int(size[j])))) - 1e-3


def test_pii_search_between_certain_characters():
    """The best path over whole texts, though only parts of them are searched."""
    rng = np.random.default_rng(9)
    for turn in range(40):
        tagger = pii.Tagger()
        tagger.p["t"] = (pii.trained().p["t"] if turn % 2 else rng.normal(0, 3, (pii.TAGS, pii.TAGS))).astype(np.float32)
        n = np.array([40, 0, 7, 1, 90])
        at = np.concatenate([[0], np.cumsum(n)])
        g = rng.normal(0, 2, (at[-1], pii.TAGS)).astype(np.float32)
        g[:, 0] += rng.choice([0, 3, 6])
        got = tagger.best_tags(g, at)
        trans = (tagger.p["t"] + pii._FORBIDDEN).astype(np.float64)
        for r in range(len(n)):
            e, y = g[at[r] : at[r + 1]].astype(np.float64), got[at[r] : at[r + 1]]
            best = e[0] if len(e) else np.zeros(1)
            for i in range(1, len(e)):
                best = (best[:, None] + trans).max(0) + e[i]
            score = e[np.arange(len(e)), y].sum() + trans[y[:-1], y[1:]].sum()
            assert score >= best.max() - 1e-2


def test_pii_shapes_that_training_has_not():
    """Written by hand, of forms that the generator doesn't make; how many are found, most of each."""
    tagger, rng = pii.trained(), random.Random(3)
    shapes = ["jo+news.list@Sub-Domain.museum", "O.Brien99@x1.y2.z3.org", "first_last@host.travel", "+44 20 7946 0958", "0800 123 4567", "(0)30 1234 5678", "Zx9_kk-31hAqP0sWmE77tYbN2vR4", "AIzaSyD3x8kQ1mZr5tYvLwN0bGhJ2uPqE9", "255.255.255.0", "3782-822463-10005", "078-05-1120"]
    hit = 0
    for x in shapes:
        for _ in range(10):
            before, after = (" ".join(pii._word(rng) for _ in range(20)) for _ in range(2))
            text = f"{before} {x} {after}"
            b, at = np.frombuffer(text.encode(), np.uint8), len(before) + 1
            hit += any(s <= at + len(x) * 0.25 and e >= at + len(x) * 0.75 for _, s, e, _, _ in tagger.spans(b, np.array([0, len(b)])))
    assert hit >= 0.85 * 10 * len(shapes)


def test_pii_training_learns():
    few = pii.train(600, 1, 10)
    loss = lambda t: t.gradient(np.stack([pii._CLASS[[ord(c) for c in x]] for x, _ in held], 1).astype(np.int64), np.stack([k for _, k in held], 1))[0]
    held = pii.labelled(60, 77)
    assert loss(few) < 0.7 * loss(pii.Tagger()) and loss(pii.trained()) < 0.2 * loss(pii.Tagger())


def test_pii_odd(spark):
    got = pii.find_pii(odd(spark))
    assert got.columns == ["doc_id", "start", "end", "kind", "span"] and got.where("doc_id in (2, 3, 4, 5)").count() == 0
    mail = "write to anna.12@mail3.example.com now"
    two = pii.find_pii(frame(spark, [(None, mail, "s"), (1, mail, "s"), (1, mail, "s")])).collect()
    assert len(two) == 3 and {mail[r.start : r.end] for r in two} == {"anna.12@mail3.example.com"} == {r.span for r in two}
    assert pii.find_pii(empty(spark)).count() == 0
