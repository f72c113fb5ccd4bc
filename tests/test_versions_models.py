import threading

import pytest
from pyspark.sql import functions as F

from postmill.operators import models
from postmill.sources import versions
from postmill.sources.versions import VersionConflict, VersionedTable


def values(df):
    return sorted(r.id for r in df.collect())


def test_versions_and_snapshots(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.read()
    assert table.write(spark.range(3)) == 1
    first = table.read()
    assert table.write(first.where("id > 0").withColumn("x", F.lit("a")), after=1) == 2
    assert values(first) == [0, 1, 2] and values(table.read(1)) == [0, 1, 2]
    assert values(table.read()) == [1, 2] and table.read().columns == ["id", "x"]
    assert table.write(table.read().limit(0)) == 3 and table.read().columns == ["id", "x"] and values(table.read()) == []
    assert table.versions() == [1, 2, 3] and table.drop_old(keep=2) == [1] and table.versions() == [2, 3]
    with pytest.raises(ValueError):
        table.read(1)


def test_a_writer_that_comes_late_learns_of_it(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "a b" / "t"))
    table.write(spark.range(1))
    table.write(spark.range(2), after=1)
    with pytest.raises(VersionConflict):
        table.write(spark.range(9), after=1)
    assert values(table.read()) == [0, 1]
    assert len(list((tmp_path / "a b" / "t" / "versions").iterdir())) == 2, "the loser's folder is gone"


def test_of_racing_writers_one_wins(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(1))
    start, won, lost, torn = threading.Barrier(5), [], [], []

    def write(n):
        start.wait()
        try:
            won.append((table.write(spark.range(n, n + 50).repartition(4), after=1), n))
        except VersionConflict:
            lost.append(n)

    def read():
        start.wait()
        for _ in range(10):
            seen = values(table.read())
            if seen != [0] and len(seen) != 50:
                torn.append(seen)

    threads = [threading.Thread(target=write, args=(100 * n,)) for n in (1, 2, 3, 4)] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and not torn
    assert won[0][0] == 2 and values(table.read())[0] == won[0][1]


def test_a_writer_that_fails_leaves_no_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(2))
    with pytest.raises(Exception):
        table.write(spark.range(2).select(F.raise_error(F.lit("no")).alias("id")))
    monkeypatch.setattr(versions, "_link", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        table.write(spark.range(5))
    assert table.versions() == [1] and values(table.read()) == [0, 1]


def posts(spark, n):
    rows = [("good gains up" if i % 3 else "bad losses down", int(i % 3 > 0)) for i in range(n)] + [(None, 0), ("no label", None)]
    return spark.createDataFrame(rows, "text string, label int")


def test_the_best_candidate_is_chosen(spark, tmp_path, monkeypatch):
    train, validation = posts(spark, 40), posts(spark, 10).where("text IS NOT NULL")
    grid = [{"features": 64, "max_iter": 1, "regularisation": 1000.0}, {"features": 64, "max_iter": 5}, {"features": 128, "max_iter": 5}]
    fitted, fit = [], models.fit_sentiment_baseline
    monkeypatch.setattr(models, "fit_sentiment_baseline", lambda *a, **k: fitted.append(k) or fit(*a, **k))
    chosen = models.choose_baseline(train, validation, grid[:2], str(tmp_path / "c"))
    assert chosen.candidate == grid[1] and chosen.accuracies == [0.6, 1.0] and len(fitted) == 2
    assert models.choose_baseline(train, validation, grid, str(tmp_path / "c")).accuracies == [0.6, 1.0, 1.0]
    assert fitted == grid, "candidates that are done are not fitted again"
    scored = models.predict_baseline(chosen.model, posts(spark, 4).where("label = 1"))
    assert {r.predicted for r in scored.collect()} == {1}
    with pytest.raises(ValueError):
        models.choose_baseline(train, validation, [], str(tmp_path / "c"))


def test_texts_are_cut_into_words_once_for_all_candidates(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    def watched(df):
        return df.withColumn("text", F.udf(read, "string")("text"))

    train, validation = posts(spark, 40), posts(spark, 10)
    grid = [{"features": 64, "max_iter": 3}, {"features": 128, "max_iter": 5}, {"features": 128, "max_iter": 5, "regularisation": 0.1}]
    chosen = models.choose_baseline(watched(train.where("text IS NOT NULL")), watched(validation), grid, str(tmp_path / "c"))
    # Every row at most once more than it is cut: filters and the words may read the text separately.
    assert seen.value <= 2 * (41 + 12)
    for candidate, share in zip(grid, chosen.accuracies):
        model = models.fit_sentiment_baseline(train, **candidate)
        scored = models.predict_baseline(model, validation).where("label IS NOT NULL")
        assert share == scored.where("label = predicted").count() / scored.count()
