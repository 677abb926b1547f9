"""Bounds on what large tables cost, seen on small ones, and the array forms against plain ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairtide.functions import hashes, metrics
from pairtide.operators import models, monitor, pairs, ranking, resample, windows


def _shuffled(spark, df) -> int:
    """Bytes that writing ``df`` out shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


def test_hash_numbers_are_the_first_digits_of_md5():
    keys = [f"|{k}" for k in (0, 99, 123456, 10**18)] + ["", "|é", "|" + "x" * 48, "|" + "y" * 49, "|" + "z" * 80]
    prefixes = [f"42|{r}" for r in (0, 9, 10, 100, 299)]
    for rows in (keys, keys[:1], []):
        for p, h in zip(prefixes, hashes.hash_numbers(prefixes, pa.array(rows, pa.string())), strict=True):
            assert h.tolist() == [int(hashlib.md5((p + k).encode()).hexdigest()[:8], 16) for k in rows]




def test_draws_travel_packed(spark):
    """A draw was a row of the shuffle: 2 million rows here; now it is two bytes."""
    df = spark.range(20000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 7 < 3).cast("int").alias("y"), (F.col("id") % 1000 / 1000).alias("p"))
    out = resample.bootstrap_metrics(df, ["g"], "id", "y", ["p"], 100)
    assert _shuffled(spark, out) < 8_000_000
    drawn = resample.draws(df.where("id < 3000"), ["g"], "id", ["y", "p"], 3).toPandas()
    got = {(r.g, r.rep): r for r in resample.bootstrap_metrics(df.where("id < 3000"), ["g"], "id", "y", ["p"], 3).collect()}
    for (g, rep), r in got.items():
        rows = drawn[drawn.g == g]
        w = np.array([list(v).count(rep) for v in rows.reps], float)
        assert r.brier == pytest.approx((w * (rows.p - rows.y) ** 2).sum() / w.sum(), rel=1e-12)


@pytest.fixture(scope="module")
def log(spark):
    """Two groups of rows whose scores tie, some without a label, a score or a flag."""
    i = F.col("id")
    score = F.when(i % 61 == 0, None).when(i % 67 == 0, float("nan")).otherwise(i * 7919 % 101 / 101)
    columns = [F.when(i % 5 == 0, None).otherwise("d").alias("g"), i.alias("k"), F.when(i % 53 == 0, None).otherwise((i * 31 % 11 < 4).cast("int")).alias("y"), score.alias("p"), F.when(i % 59 == 0, None).otherwise((i % 3 == 0).cast("int")).alias("f")]
    return spark.range(4000).select(*columns).cache()


def _same(got, want, keys):
    got, want = ({tuple(r[c] for c in keys): r for r in df.collect()} for df in (got, want))
    assert set(got) == set(want) and got
    for key, r in got.items():
        for c in ("n", "window_coverage", "window_auc", "window_ece"):
            assert r[c] == (None if want[key][c] is None else pytest.approx(want[key][c], rel=1e-12)), (key, c)


@pytest.mark.parametrize("sizes", [(20, 50, 100), (97, 101, 103)])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_windows_equal_those_by_rows(spark, log, sizes, batch):
    keys = ["g", "window_size", "window_id"]
    want = metrics.window_summary(ranking.row_windows(log, ["g"], ["k"], *sizes), keys, "y", "p", F.avg(F.col("f").cast("double")).alias("window_coverage"), prefix="window_")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _same(windows.window_summaries(log, ["g"], ["k"], sizes, "y", "p", "f"), want, keys)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_permuted_windows_equal_those_by_rows(spark, log):
    keys = ["g", "permutation_id", "window_size", "window_id"]
    dealt = resample.shuffled_order(log, "k", 4)
    want = metrics.window_summary(ranking.row_windows(dealt, ["g", "permutation_id"], ["perm_order", "k"], 20, 50), keys, "y", "p", F.avg(F.col("f").cast("double")).alias("window_coverage"), prefix="window_")
    _same(windows.permuted_windows(log, ["g"], "k", 4, (20, 50), "y", "p", "f"), want, keys)


def test_windows_of_permutations_and_sizes_travel_once(spark):
    """A row was shuffled once a size and permutation, with all its columns: 2.4 million rows here."""
    i = F.col("id")
    rows = spark.range(40000).select(F.lit("d").alias("domain"), F.lit("ranking_first").alias("mode"), i.alias("event_id"), (i % 3 == 0).cast("int").alias("label"), (i * 7919 % 10007 / 10007).alias("policy_prob"), (i % 2).cast("int").alias("referral_flag")).cache()
    assert _shuffled(spark, monitor.window_metrics(rows, (100, 250, 500))) < 3_500_000
    assert _shuffled(spark, monitor.window_metrics(rows, (250, 500, 1000), permutations=20)) < 18_000_000


def test_small_designs_are_fitted_in_a_task_as_by_steps(spark, monkeypatch):
    """Eighty designs of a few rows beside a large one; all went through every step over all blocks."""
    i = F.col("id")
    x = F.array((i * 7919 % 1009 / 1009).cast("double"), F.when(i % 97 == 0, None).otherwise((i * 31 % 211 / 211).cast("double")))
    rows = spark.range(9000).select(F.when(i < 6600, "large").otherwise(F.concat(F.lit("s"), i % 80)).alias("design"), F.when(i % 83 == 0, None).otherwise((i * 13 % 29 < 11).cast("int")).alias("y"), x.alias("x"), (i % 3 + 1).alias("bits")).cache()
    got = {r.design: r.coefficients for r in models.fit_designs(rows, 2, 3).collect()}
    stepped = []
    monkeypatch.setattr(models, "_summed", lambda width, fits, own=models._summed: stepped.append(1) or own(width, fits))
    models.fit_designs(rows.where("design <> 'large'"), 2, 3)
    assert not stepped
    monkeypatch.setattr(models, "LEAST_FEW", 10**9)
    want = {r.design: r.coefficients for r in models.fit_designs(rows, 2, 3).collect()}
    assert stepped and set(got) == set(want) and len(got) == 81
    for d, line in want.items():
        assert got[d] == [None if v is None else pytest.approx(v, rel=1e-7, abs=1e-9) for v in line], d


def test_models_of_one_row_are_read_off_together(spark):
    """Out-of-fold scores of three models were gathered by a shuffle of three rows each."""
    i = F.col("id")
    df = spark.range(20000).select(F.lit("d").alias("g"), i.alias("k"), (i * 13 % 29 < 11).cast("int").alias("y"), *[(i * p % 1009 / 1009).alias(c) for c, p in (("u", 7919), ("v", 31), ("w", 17))])
    told = models.cross_predict(df, ["g"], "k", "y", {"a": ["u"], "b": ["u", "v"], "c": ["w"]}, 3)
    assert "Generate" not in told._jdf.queryExecution().toString() and told.where("a is null or b is null or c is null").isEmpty()


def test_no_more_negatives_are_drawn_than_needed(spark, monkeypatch):
    """Sixteen draws were made for every positive pair, and some thirteen free pairs written for the three that are wanted; too few draws are doubled."""
    positive = spark.range(400).select((F.col("id") % 100).alias("source"), (F.col("id") * 37 % 1009 + 1000).alias("target"))
    free, settle = [], pairs.settled

    def seen(df, name="table", small=True):
        out = settle(df, name, small)
        if name == "free":
            free.append(out.count())
        return out

    monkeypatch.setattr(pairs, "settled", seen)
    monkeypatch.setattr(pairs, "FIRST_DRAWS", 0)
    got = sorted(map(tuple, pairs.negatives(positive).collect()))
    assert len(got) == 1200 and max(free) < 1600
    monkeypatch.setattr(pairs, "FIRST_DRAWS", -1400)
    assert sorted(map(tuple, pairs.negatives(positive).collect())) == got and len(free) > 3
    monkeypatch.setattr(pairs, "FIRST_DRAWS", 4900)  # as many as before
    assert sorted(map(tuple, pairs.negatives(positive).collect())) == got


def test_nested_scores_are_read_off_without_a_shuffle(spark, monkeypatch):
    """Every row travelled fifteen times, once for each model and outer fold."""
    i = F.col("id")
    df = spark.range(3000).select(i, F.lit("d").alias("g"), (i * 31 % 11 < 4).cast("int").alias("y"), *[(i * m % 997 / 997).alias(c) for c, m in (("c", 7), ("a", 31), ("b", 53))])
    sent, settle = [], models.settled
    monkeypatch.setattr(models, "settled", lambda df, name="table", small=True: (sent.append(_shuffled(spark, df)) if name == "scores" else None) or settle(df, name, small))
    assert models.stacked(df, ["g"], "id", "y", ["c"], ["a"], ["b"]).where("stacked_prob between 0 and 1 and stacked_plain_prob between 0 and 1").count() == 3000
    assert len(sent) == 1 and sent[0] < 50_000


def test_margins_copy_counts_and_not_rows(spark):
    """Each row was copied 32 times (scores, margins, groups) for the counts, and again for the metrics, before anything was summed up."""
    from pairtide import catalog

    plan = catalog.QUERIES["margin_sweep"](spark, "/root/testdata/sf0.001")
    lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("json" in line or "md5" in line for line in lines)  # the rows are read once, for their counts
    assert _shuffled(spark, plan) < 1_350_000
    n = {(r.domain, r.margin, r.model): 0 for r in plan.collect()}
    for r in plan.where("grp <> 'all'").collect():
        n[r.domain, r.margin, r.model] += r.n
    assert len(n) == 48 and all(n[r.domain, r.margin, r.model] == r.n for r in plan.where("grp = 'all'").collect())


def test_permutations_in_rounds_leave_no_shuffle_files(spark, log, monkeypatch):
    """The rows of all permutations lay in shuffle files together, and stayed there."""
    seen, own = [], monitor.windows_of
    monkeypatch.setattr(monitor, "windows_of", lambda rows, groups, permutations, sizes: seen.append(list(permutations)) or own(rows, groups, permutations, sizes))
    df = log.select(F.col("g").alias("domain"), F.lit("ranking_first").alias("mode"), F.col("k").alias("event_id"), F.col("y").alias("label"), F.col("p").alias("policy_prob"), F.col("f").alias("referral_flag")).where("domain is not null")
    summed = lambda out: out.groupBy("permutation_id", "window_size", "domain").agg(F.count("*").alias("n"), F.round(F.avg("auc_drop"), 9).alias("drop"), F.sum(F.col("any_alert").cast("int")).alias("alerts"))
    want = sorted(map(tuple, summed(monitor.window_metrics(df, (20, 50), permutations=7)).collect()))
    monkeypatch.setattr(monitor, "ROUND", 3 * df.count())
    assert sorted(map(tuple, monitor.permuted_metrics(df, (20, 50), 7, summed).collect())) == want and len(want) == 14
    assert seen == [[0, 1, 2], [3, 4, 5], [6]]


def test_a_passed_table_leaves_no_shuffle_files(spark):
    """They lay on disk until the driver's garbage was collected."""
    from pairtide.sources.tables import settled

    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(name)
    df = spark.range(20000).repartition(3, "id").mapInArrow(lambda batches: batches, "id long")
    for passed in (False, True):
        settled(df, small=False, passed=passed)
        tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        seen.append(tracker.shuffleStatuses().size())
    assert seen[1] == seen[0] and spark.conf.get(name) == before


@pytest.mark.parametrize("shuffle", ["label", "feature"])
def test_null_gains_in_blocks_equal_those_of_dealt_rows(spark, monkeypatch, shuffle):
    """A row travelled once for each repeat and model, several times; blocks, chunks, slices and rounds of few rows; holes, a null group and one that is too small."""
    from pairtide.operators import nulls

    i = F.col("id")
    y = F.when(i % 41 == 0, None).otherwise((i * 31 % 11 < 4).cast("int"))
    df = spark.range(500).select(F.when(i < 6, "small").otherwise(F.when(i % 3 == 0, None).otherwise("g")).alias("g"), i.alias("k"), y.alias("y"), (i * 17 % 24 / 24).alias("u"), F.when(i % 37 == 0, None).when(i % 43 == 0, float("nan")).otherwise(i * 7919 % 101 / 101 + i % 11).alias("v")).cache()
    dealt = resample.permuted(df, ["g"], "k", ["y" if shuffle == "label" else "v"], 5).cache()
    keys = ["g", "rep"]
    told = models.guarded_auroc(models.cross_predict(dealt, keys, "k", "y", {"base": ["u"], "plus": ["u", "v"]}), keys, "y", ["base", "plus"])
    want = {(r.g, r.rep): (r.auc_base if shuffle == "label" else None, r.auc_plus) for r in told.collect()}
    for name, size in (("BLOCK", 64), ("CHUNK", 50), ("SLICE", 40), ("ROUND", 2 * df.count())):
        monkeypatch.setattr(nulls, name, size)
    got = {(r.g, r.null_rep): (r.auc_base, r.auc_plus) for r in nulls.null_aurocs(df, ["g"], "k", "y", ["u"], "v", 5, shuffle).collect()}
    assert set(got) == set(want) and len(got) == 15 and any(v[1] is None for v in got.values())
    for key, pair in want.items():
        assert got[key] == tuple(None if v is None else pytest.approx(v, abs=1e-9) for v in pair), key


def test_null_gains_do_not_copy_rows_for_repeats(spark, monkeypatch):
    """40 repeats of 20,000 rows shuffled 0.8 million rows several times; the true gain counted the baseline's features twice."""
    i = F.col("id")
    df = spark.range(20000).select(F.lit("d").alias("g"), i.alias("k"), (i * 13 % 29 < 11).cast("int").alias("y"), *[(i * p % 1009 / 1009).alias(c) for c, p in (("u", 7919), ("v", 31))])
    sent, settle = [], models.settled
    from pairtide.operators import nulls

    monkeypatch.setattr(nulls, "settled", lambda df, *a, **k: sent.append(_shuffled(spark, df)) or settle(df, *a, **k))
    got = models.null_gains(df, ["g"], "k", "y", ["u"], "v", 40, "label").first()
    assert sum(sent) < 40 * 20000 * 45
    one = models.incremental(df, ["g"], "k", "y", ["u"], {"v": ["v"]}).first()
    assert got.true_gain == one.gain_v


def test_packed_records_are_read_some_megabytes_at_a_time(spark, monkeypatch):
    """Up to 4,096 blocks of 160 kB were read at once, and 64 MB of them handed to Python, so a task's memory grew with its file."""
    from pairtide.sources.tables import settled

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(n) for n in names]
    big = spark.range(0, 96, 1, 1).select("id", F.expr("cast(repeat(md5(string(id)), 16000) as binary)").alias("v"))
    read = settled(big, small=False, packed=True)
    seen = settled(read.mapInArrow(sizes, "n long, bytes long"), small=False, packed=True).collect()
    assert sum(r.n for r in seen) == 96 and max(r.bytes for r in seen) < 10_000_000
    assert [spark.conf.get(n) for n in names] == before

    asked, own = [], models.packed
    monkeypatch.setattr(models, "packed", lambda df, name: asked.append(name) or own(df, name))
    rows = spark.range(300).select(F.lit("d").alias("design"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.array((F.col("id") % 7).cast("double")).alias("x"), F.lit(1).alias("bits"))
    models.fit_designs(rows, 1).collect()
    assert asked[:2] == ["blocks", "fits"]
