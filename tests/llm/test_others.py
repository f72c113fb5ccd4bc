"""Sharding, mixing, top-k search, WARC, HTML text and the quality classifier."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import hamming, html_text, mixing, quality, queries, sharding, warc
from postmill.llm.common import materialise, read_table, salted_rank
from postmill.sources.scratch import scratch_path


def test_salted_rank(spark):
    df = materialise(spark.createDataFrame([(i % 3 or None, i) for i in range(50)], "k long, v long").repartition(4), "ranked")
    rows = salted_rank(df, ["k"], F.pmod(F.col("v"), F.lit(4)).cast("int"), ["v"], "r", 4).collect()
    for key in (None, 1, 2):
        own = sorted((r.v % 4, r.v, r.r) for r in rows if r.k == key)
        assert [r for *_, r in own] == list(range(len(own)))


def sharded(spark, rows, shards=6):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string").repartition(3)
    return sharding.shard_documents(df, shards).collect()


def test_shards_are_even_and_groups_together(spark):
    rng = random.Random(0)
    rows = [(i, f"text {i}") for i in range(200)]
    for g in range(30):
        rows += [(1000 + 10 * g + i, f"copy {g}") for i in range(rng.randrange(2, 5))]
    rows += [(5000 + i, "hot é") for i in range(len(rows) // 2)] + [(1, None), (2, ""), (None, "n"), (7, "text 7"), (7, "text 7")]
    out = sharded(spark, rows)
    texts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == texts
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    homes = {}
    for r in out:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in homes.values()) == 1, "only the group larger than a shard is cut"
    assert len(homes[zlib.crc32("hot é".encode())]) <= 4


def test_sharding_only_copies_few_rows_none(spark):
    out = sharded(spark, [(i, "same") for i in range(17)])
    assert sorted(Counter(r.shard for r in out).values()) == [2, 3, 3, 3, 3, 3]
    assert sorted(r.shard for r in sharded(spark, [(1, "a"), (2, "b")])) == [0, 1]
    assert sharded(spark, []) == []


def least_cut(counts, sizes):
    """Fewest groups that are split, by trying every way to put whole groups into shards."""
    best = len(counts)

    def place(i, room, split):
        nonlocal best
        if split >= best:
            return
        if i == len(counts):
            best = split
            return
        for j in {r: j for j, r in enumerate(room) if r >= counts[i]}.values():
            place(i + 1, [r - counts[i] * (k == j) for k, r in enumerate(room)], split)
        place(i + 1, room, split + 1)

    place(0, list(sizes), 0)
    return best


def split_groups(out):
    homes = {}
    for r in out:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    return sum(len(s) > 1 for s in homes.values())


@pytest.mark.parametrize(
    "size, groups, singles, most",
    [
        (2, 5_000, 0, 8),  # 16 of 24 shards hold 417 rows, an odd number: 8 pairs have to be cut
        (100, 100, 0, 4),  # a shard holds four whole groups
        (5, 1_900, 500, 0),
        (1, 10_000, 0, 0),
    ],
)
def test_groups_stay_whole_where_they_can(spark, size, groups, singles, most):
    total = size * groups + singles
    df = spark.range(total).select(F.col("id").alias("doc_id"), F.when(F.col("id") < size * groups, F.col("id") % groups).otherwise(F.col("id")).cast("string").alias("text"))
    out = sharding.shard_documents(df, 24).collect()
    sizes = Counter(r.shard for r in out)
    assert len({r.id for r in out}) == total == len(out) and max(sizes.values()) - min(sizes.values()) <= 1
    assert split_groups(out) == most


def test_cut_of_small_corpora_against_the_least(spark):
    rng = random.Random(5)
    for _ in range(4):
        counts = [rng.choice([2, 2, 3, 4, 6]) for _ in range(7)]
        rows = [(100 * g + i, f"group {g}") for g, n in enumerate(counts) for i in range(n)] + [(9_000 + i, f"one {i}") for i in range(5)]
        out = sharded(spark, rows, 3)
        sizes = sorted(Counter(r.shard for r in out).values(), reverse=True)
        assert sizes == [len(rows) // 3 + (i < len(rows) % 3) for i in range(3)]
        assert split_groups(out) <= least_cut(sorted(counts, reverse=True), sizes) + 1


def test_pieces_of_large_groups():
    rng = np.random.default_rng(0)
    for _ in range(300):
        room = sharding.Quotas(int(rng.integers(20, 90)), 7).sizes()
        sizes, total = room.copy(), int(room.sum())
        giants = []
        while total > room.max() and rng.random() < 0.7:
            n = int(rng.integers(room.max() + 1, total + 1))
            giants.append((len(giants), n))
            total -= n
        pieces, rests = sharding.fill_whole(giants, room)
        pieces += sharding.cut(rests, room)
        assert (room >= 0).all() and room.sum() == total
        for hub, n in giants:
            spans = sorted((lo, hi) for h, lo, hi, _ in pieces if h == hub)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert Counter({j: int(sizes[j] - room[j]) for j in range(7) if sizes[j] > room[j]}) == sum(
            (Counter({j: hi - lo}) for _, lo, hi, j in pieces), Counter()
        )


def test_period_meets_every_deadline():
    rng = random.Random(0)
    for _ in range(100):
        weights = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 6))}
        total, served = sum(weights.values()), Counter()
        for slot, name in enumerate(mixing.period(weights)):
            served[name] += 1
            assert all(abs(served[k] - (slot + 1) * w / total) < 1 for k, w in weights.items())


def test_phases_place_every_block_once():
    rng = random.Random(1)
    for _ in range(100):
        weights = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 6))}
        blocks = {k: rng.randint(0, 40) for k in weights}
        slots = {}
        for name, first, end, start, length, own in mixing.phases(blocks, weights):
            for block in range(first, end):
                turn, at = divmod(block - first, len(own))
                slots[start + turn * length + own[at]] = name
        assert sorted(slots) == list(range(sum(blocks.values())))
        assert Counter(slots.values()) == Counter({k: n for k, n in blocks.items() if n})
        # While all sources last, each is within one block of its share.
        active = {k: w for k, w in weights.items() if blocks[k]}
        served, total = Counter(), sum(active.values())
        for slot in range(len(slots)):
            served[slots[slot]] += 1
            assert all(abs(served[k] - (slot + 1) * w / total) < 1 for k, w in active.items())
            if served[slots[slot]] == blocks[slots[slot]]:
                break


def test_mixing_rows(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 130 + ["b"] * 40 + ["c"] * 7 + [None] * 3)] + [(5, "a")]
    df = materialise(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, mix_note string").repartition(3), "mix")
    out = mixing.mix_sources(df, {"a": 3, "b": 1}, block=8).orderBy("mix_position").collect()
    assert [r.mix_position for r in out] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    assert {(r.source, r.mix_pool) for r in out} == {("a", "a"), ("b", "b"), ("c", "c"), (None, "*")}
    assert all(max(Counter((r.mix_pool, r.mix_block) for r in out).values()) <= 8 for _ in [0])
    place = {(r.doc_id, r.source): r.mix_position for r in out}
    files = mixing.mixed_order(df, {"a": 3, "b": 1}, block=8).withColumn("_file", F.spark_partition_id()).collect()
    found = [(r._file, place[r.doc_id, r.source]) for r in files if r.doc_id != 5]
    assert len(files) == len(rows) and found == sorted(found)
    assert all(abs(at - i) < 24 for i, (_, at) in enumerate(found)), "files follow one another"
    assert mixing.mix_sources(materialise(df.limit(0), "none"), {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"a": 0})
    with pytest.raises(ValueError):
        mixing.mix_sources(materialise(spark.range(300).selectExpr("id AS doc_id", "string(id) AS source"), "many"), {})


def test_every_source_keeps_its_share_in_every_phase(spark, small):
    docs = read_table(spark, small, "documents")
    out = mixing.mix_sources(docs, queries.WEIGHTS).orderBy("mix_position").collect()
    order = [pool for _, pool in sorted({(r.mix_slot, r.mix_pool) for r in out})]
    blocks = Counter(order)
    assert len(blocks) == docs.select("source").distinct().count() and len(order) == max(r.mix_slot for r in out) + 1
    active, served, left = dict(blocks), Counter(), Counter(blocks)
    weight = {name: queries.WEIGHTS.get(name, queries.WEIGHTS["*"]) for name in blocks}
    for at in order:
        served[at] += 1
        left[at] -= 1
        total, slots = sum(weight[k] for k in active), sum(served.values())
        assert all(abs(served[k] - slots * weight[k] / total) < 1 for k in active)
        if not left[at]:
            del active[at]
            served.clear()


def brute_search(rows, queries, k):
    out = []
    for qid, q in queries:
        near = sorted((int(np.bitwise_count(np.uint64(q) ^ np.uint64(c))), i) for i, c in rows)[:k]
        out += [(qid, place + 1, i, d) for place, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("chunks,small", [(None, False), (2, False), (3, True), (8, True)])
def test_top_k_equals_brute_force(spark, chunks, small, monkeypatch):
    if small:  # values in pieces, queries in blocks, pairs in runs
        for name, size in {"HOT_ENTRIES": 5, "SCAN_QUERIES": 2, "SCAN_CODES": 40, "HELD": 50, "PAIRS": 30}.items():
            monkeypatch.setattr(hamming, name, size)
    rng = np.random.default_rng(chunks or 0)
    bases = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = bases[rng.integers(0, 30, 600)]
    for _ in range(4):
        codes = codes ^ np.where(rng.random(600) < 0.8, np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64), np.uint64(0))
    codes[:200] = codes[0]  # a common code
    rows = [(int(i), int(c)) for i, c in enumerate(codes)]
    vectors = [(i, [1.0 if c >> b & 1 else -1.0 for b in range(64)], "x") for i, c in rows]
    odd = [(1000, None, "x"), (1100, [1.0], "x"), (None, vectors[0][1], "x"), vectors[0]]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, rank string").repartition(4)
    got = hamming.search_vectors(df, F.col("vec_id") % 100 == 0, 10, chunks=chunks).collect()
    want = brute_search(rows, [(i, c) for i, c in rows if i % 100 == 0], 10)
    assert sorted(tuple(r) for r in got) == want


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (7, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = hamming.search_vectors(df, F.col("vec_id") == 0, 10).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 0, 0), (0, 2, 7, 64)]
    assert hamming.search_vectors(df.limit(0), F.col("vec_id") == 0, 10).collect() == []


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    long = "é<p>" * 400
    rows = [(1, "http://a/ b\r\n", long), (2, None, long), (9, "http://c", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (9, "again", long), (None, "n", long), (7, "u", "x" * 999)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(df, folder)
    assert index.count() == len(rows)
    out = warc.read_records(index, folder, payloads=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == Counter(
        [(1, "revisit", 9), (2, "revisit", 9), (None, "revisit", 9), (9, "response", None), (9, "response", None)]
        + [(i, "response", None) for i in (3, 4, 5, 6, 7)]
    )
    texts = {i: t or "" for i, _, t in rows}
    assert all(r.payload == texts[r.page_id] for r in out if r.record_type == "response")
    assert all(r.payload_bytes == len(texts[r.page_id].encode()) for r in out)
    some = warc.read_records(index.where("url = 'u'"), folder).collect()
    assert sorted(r.page_id for r in some) == [3, 4, 5, 6, 7]
    assert warc.read_records(warc.write_archives(df.limit(0), scratch_path(spark, "none")), folder).collect() == []


def test_requests_are_put_together():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 20 + warc.GAP, 5), ("b", 0, warc.READ_BYTES + 1), ("b", warc.READ_BYTES + 1, 4)]
    found = [(name, first, end, len(held)) for name, first, end, held in warc._requests(places)]
    assert found == [("a", 0, 15, 2), ("a", 20 + warc.GAP, 25 + warc.GAP, 1), ("b", 0, warc.READ_BYTES + 1, 1), ("b", warc.READ_BYTES + 1, warc.READ_BYTES + 5, 1)]


ARTICLE = "<h1>Title &amp; more</h1><p>First  long\nparagraph of the text, with a <a href=x>link</a> in it.<p>Second<br>paragraph &lt;b&gt; <b>bold</b> text, long enough to count.<ul><li>one<li>two</ul>"
MAIN = "Title & more\nFirst long paragraph of the text, with a link in it.\nSecond\nparagraph <b> bold text, long enough to count.\none\ntwo"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><a href=/>menu</a></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>", MAIN),
        (f"<body><div class='cookie-notice'>We use <p>cookies</div><div id=main><div class=post>{ARTICLE}</div></div><section id='comments'><p>I like it very much indeed, says a reader.</section>", MAIN),
        (f"<body><header>site</header><aside>side</aside><main>{ARTICLE}</main><form><input>search</form><script>var a='</p>';</script>", MAIN),
        ("plain  text", "plain text"),
        ("<p>a<!-- no --> b", "a b"),
        ("<body><nav>only menu</nav></body>", ""),
        ("<p>cut <b off", "cut"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_mixing_keeps_clashing_columns(spark):
    names = "doc_id long, source string, _salt int, _key long, _rank long, _part int, _row string, _id int, _before int, mix_position string"
    rows = [(i, "ab"[i % 2], 1, 2, 3, 4, "r", 5, 6, "old") for i in range(20)]
    df = spark.createDataFrame(rows, names)
    out = mixing.mix_sources(df, {"a": 1, "b": 1}, block=2)
    assert out.columns == [*df.columns[:-1], *mixing.MIX_COLUMNS]
    got = out.collect()
    assert sorted(tuple(r)[:9] for r in got) == [r[:9] for r in rows]
    assert sorted(r.mix_position for r in got) == list(range(20))


def test_extracted_rows(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (2, None, "old")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999


def labelled(n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "Some text.", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (2000, None)], "doc_id long, quality int")
    model = quality.fit_classifier(docs, labels)
    out = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= s <= 1 for s in out.values())
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.5) == bool(q) for i, q in held) / len(held) > 0.97
    assert out[1000] == out[1001]
    assert {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()} >= {i for i, _ in held}


def test_held_out_labels_are_not_learnt_from(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    changed = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_classifier(docs, labels), quality.fit_classifier(docs, changed)
    assert sorted(a.labels) == sorted(b.labels) and len(a.labels) == docs.where(~quality.held_out("doc_id")).count()


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_classifier(docs, none) is None
    assert quality.score_quality(docs, None).first().score == 0.5
    assert quality.fit_classifier(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None


def test_terms_of_a_long_text_do_not_depend_on_the_block(monkeypatch):
    text = "Some Words, 12 of them!\n" * 200
    found, counts = quality.terms(text)
    monkeypatch.setattr(quality, "TEXT_BLOCK", 7)
    again, same = quality.terms(text)
    assert (found == again).all() and np.allclose(counts, same)


def sentence(n):
    return ("word " * n)[: n - 1] + "."


@pytest.mark.parametrize("wrap", ["article", "div", "main"])
def test_nested_sections_come_whole(wrap):
    first = "".join(f"<p>{sentence(100)}</p>" for _ in range(3))
    second = f"<h2>Next</h2><p>{sentence(50)} <b>bold</b> {sentence(50)}</p><p>{sentence(60)}</p>"
    page = f"<body><nav>menu</nav><{wrap}><section>{first}</section><section>{second}</section></{wrap}><ul><li><a href=x>other</a><li><a href=y>pages</a></ul></body>"
    want = [sentence(100)] * 3 + ["Next", f"{sentence(50)} bold {sentence(50)}", sentence(60)]
    assert html_text.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "tag", [f"div class='{c}'" for c in ("content has-sidebar", "no-comments", "with-nav", "post ad-free", "social-policy", "legal-history", "sidebar")] + ["div id='share-prices'", "form"]
)
def test_wrapping_parts_are_kept(tag):
    name = tag.split()[0]
    for article in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
        page = f"<body><{tag}><input value=x><button>send</button><div class='site-footer'>about</div>{article}</{name}></body>"
        assert html_text.main_text(page) == MAIN


@pytest.mark.parametrize("tag", ["div class='no-comments'", "div class='ad-free'", "section id='share-prices'"])
def test_small_parts_of_like_names_are_kept(tag):
    part = f"<{tag}><p>{sentence(60)}</p></{tag.split()[0]}>"
    assert html_text.main_text(f"<body><article>{ARTICLE}{part}</article></body>") == f"{MAIN}\n{sentence(60)}"


@pytest.mark.parametrize("tag", ["div class='ad-container'", "div id=comments", "div class='x cookie-notice'", "form", "p hidden", "div style='display: none'"])
def test_small_parts_are_dropped(tag):
    page = f"<body><article>{ARTICLE}<{tag}>{sentence(20)}</{tag.split()[0]}></article></body>"
    assert html_text.main_text(page) == MAIN
