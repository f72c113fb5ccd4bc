import random

import numpy as np
import pytest

from postmill.llm import odd_sketch


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, part=85, whole=100):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and whole * both >= part * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        lowest = min(ids, default=None)
        out.append((own, len(sets[i]), lowest, own == lowest))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, name string, id string, own int").repartition(3)
    return sorted((tuple(r) for r in odd_sketch.near_duplicates(df, **options).collect()), key=str)


def drift(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed, n, length, changes, groups):
    rng = random.Random(seed)
    bases = [[f"v{rng.randrange(500)}" for _ in range(length)] for _ in range(groups)]
    return [(i, " ".join(drift(rng, rng.choice(bases), rng.randrange(changes + 1)))) for i in range(n)]


@pytest.mark.parametrize("seed,n,length,changes,groups", [(1, 200, 120, 6, 20), (2, 150, 100, 4, 1), (3, 300, 40, 2, 3)])
def test_equals_brute_force(spark, seed, n, length, changes, groups, monkeypatch):
    rows = corpus(seed, n, length, changes, groups)
    want = brute(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(odd_sketch, "BUCKET_ROWS", 8)
    monkeypatch.setattr(odd_sketch, "FAMILY_ROWS", 8)
    assert got(spark, rows) == want


def test_a_chain_of_drifting_texts(spark):
    rng, words, rows = random.Random(9), [f"v{i}" for i in range(100)], []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words[(7 * i) % 100] = f"n{i}"
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four five"), (7, "x " * 50), (8, "x " * 5), (9, "É é é é é"), (10, "é é é é é")]
    rows += [(1, "one two"), (None, "one two"), (None, "lone text of a row without id"), (None, None), (11, "lone text of a row without id"), (None, "of no id at all"), (7, "x " * 50)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:0]) == []


def test_ids_repeated_on_different_texts(spark):
    rows = [(i % 7, t) for i, t in corpus(4, 80, 60, 2, 8)] + [(None, t) for _, t in corpus(5, 40, 60, 2, 3)]
    assert got(spark, rows) == brute(rows)


def test_other_similarity(spark):
    rows = corpus(6, 80, 60, 3, 6)
    assert got(spark, rows, similarity=(95, 100)) == brute(rows, 95, 100)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"wörd{i % 300}" for i in range(2000))
    want = odd_sketch.shingle_set(text)
    for size in (3, 64, 1000):
        monkeypatch.setattr(odd_sketch, "CHUNK", size)
        assert [w for part in odd_sketch.words(text, size) for w in part] == text.encode().split()
        assert (odd_sketch.shingle_set(text) == want).all()
    assert len(want) == len(brute_set(text)) == 300
    assert len(odd_sketch.shingle_set("x" * 3_000_000)) == 1


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    errors = []
    for similarity in (0.85, 0.9, 0.97):
        both = int(2000 * 2 * similarity / (1 + similarity))
        for _ in range(30):
            hashes = rng.integers(0, 1 << 63, 2000 + 2000 - both, dtype=np.uint64)
            one, other = (odd_sketch.odd_sketch(odd_sketch.samples(h)) for h in (hashes[:2000], hashes[2000 - both :]))
            apart = np.bitwise_count(np.frombuffer(one, np.uint8) ^ np.frombuffer(other, np.uint8)).sum()
            errors.append(odd_sketch.estimate(apart) - both / len(hashes))
            assert apart <= odd_sketch.most_differing(similarity)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035
