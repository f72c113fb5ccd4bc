import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1):
            if size:
                windows.setdefault(tuple(own[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for i in range(len(own)):
            for size in range(1, window + 1):
                names = windows.get(tuple(own[i : i + size])) if i + size <= len(own) else None
                if names:
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((doc, len(own), len(hit), len(found), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def scanned(spark, docs, items, window):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    rows = dc.scan_documents(d, b, window=window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in rows), key=str)


@pytest.mark.parametrize("window,vocabulary", [(13, 40), (5, 3), (2, 6)])
def test_equals_brute_force(spark, window, vocabulary):
    rng = random.Random(window)
    signs = [f"W{i}" for i in range(vocabulary)] + ["É", "é", "naïve"]
    sep = [" ", ", ", "\n", "--", "_"]

    def text(n):
        return "".join(rng.choice(signs) + rng.choice(sep) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 6, 13, 14, 40, 0])] + [(20, None), (None, text(8)), (3, text(7))]
    docs = [(i, text(rng.choice([0, 3, 30, 200]))) for i in range(25)] + [(90, None), (91, "")]
    docs += [(100 + i, text(30) + (items[rng.randrange(9)][1] or "").upper() + text(9)) for i in range(20)]
    docs += [docs[-1], docs[-1], (None, docs[-1][1])]
    assert scanned(spark, docs, items, window) == brute(docs, items, window)


def test_empty_tables(spark):
    assert scanned(spark, [(1, "a b")], [], 13) == [(1, 2, 0, 0, (), False)]
    assert scanned(spark, [], [(1, "a b")], 13) == []


def test_removal(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"Intro, {passage}; the end.", "a"), (2, "clean text", "b"), (3, None, "c"), (4, passage + " x" * 500, "d"), (1, f"Intro, {passage}; the end.", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, key string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = dc.remove_contamination(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    spans = {r.doc_id: r.text for r in dc.remove_contamination(d, b, spans=True).collect()}
    assert spans == {1: "Intro; the end.", 2: "clean text", 3: None, 4: " x" * 500}


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = dc.scan_documents(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert dc.benchmark_windows(b).select(F.sum("k")).first()[0] == 2


def test_clashing_columns_are_kept(spark):
    item = " ".join(f"w{i}" for i in range(20))
    names = "doc_id long, text string, _key string, _hits int, _n_hit int, _row string, key string"
    rows = [(1, item, "a", 1, 2, "b", "c"), (2, "clean text", "d", 3, 4, "e", "f"), (2, None, "d", 3, 4, "e", "f")]
    docs, bench = spark.createDataFrame(rows, names), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.remove_contamination(docs, bench)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    cut = dc.remove_contamination(docs, bench, spans=True)
    assert cut.schema == docs.schema
    assert sorted(map(tuple, cut.collect()), key=str) == sorted([(1, "", "a", 1, 2, "b", "c"), *rows[1:]], key=str)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_large_tables_are_not_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", most)
    seen = []
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(1) or df)
    item = " ".join(f"w{i}" for i in range(20))
    assert [r[-1] for r in scanned(spark, [(1, item), (2, "other words")], [(1, item)], 13)] == [True, False]
    assert bool(seen) == bool(most)
