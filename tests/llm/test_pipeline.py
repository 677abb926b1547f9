"""The pipeline's stages: brute force on a small fixture with planted rows, and properties on the small tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from test_operators import words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _large string, component string, kept string"


def write_stages(spark, docs, sf_dir, folder):
    import corpus_pipeline

    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    return write_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path_factory.mktemp("stages"))


def test_stages_keep_columns_and_shrink(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_packed_tokens_cover_the_documents(stages):
    _, before, pieces = stages[4]
    assert pieces.select("doc_id").distinct().count() == before.count()
    assert pieces.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).where("doc_tokens <> `sum(length)`").count() == 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents with copies, a passage, a benchmark text, junk and toxic words; null and repeated ids and names that operators use themselves."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, bench = text(60), text(30)
    rows, toxic, junk = [], set(), set()
    for i in range(900):
        w = text(90)
        if i % 6 == 1:
            w.insert(5, "vileword")
            toxic.add(i)
        elif i % 6 == 2:
            w = [x + "#$#" for x in w]
            junk.add(i)
        rows.append((i, " ".join(w)))
    labels = [(i, int(i not in junk), int(i in toxic)) for i in range(900)]
    clean = text(100)
    extra = [(1000, clean), (1001, clean), (1002, [*clean[:50], "other", *clean[51:]])]  # copies
    extra += [(1010, [*text(40), *passage, *text(20)]), (1011, [*text(30), *passage, *text(40)])]
    extra += [(1020, [*text(60), *bench, *text(10)]), (1021, text(99))]
    extra += [(1030, [*text(70), "vileword"]), (1031, text(20))]
    extra += [(None, [*text(50), *bench]), (None, text(77)), (None, clean)]
    extra += [(1040, text(80)), (1040, [*text(40), *bench])]  # one id, two documents
    again = text(85)
    extra += [(1050, again), (1050, again)]
    rows += [(i, " ".join(w)) for i, w in extra] + [(1060, None), (1061, ""), (None, None)]
    full = [(i, t, "xx" if k // 6 % 2 else None, "s", len(t or ""), "x", None, "y") for k, (i, t) in enumerate(rows)]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(bench)), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return folder, rows, toxic, junk, " ".join(clean), " ".join(bench), again


def pairs_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_brute_force(spark, planted, tmp_path):
    folder, rows, toxic, junk, clean, bench, again = planted
    done = write_stages(spark, spark.read.parquet(str(folder / "documents.parquet")), str(folder), tmp_path)
    key = lambda i, t: (-1 if i is None else i, t)
    bad = lambda t: "vileword" in t.split() or "#$#" in t
    want = [key(i, t) for i, t in rows if len(words(t)) >= 50 and not bad(t)]
    assert pairs_of(done[0][2]) == sorted(want)  # all toxic and junk rows and nothing else go, besides the short ones

    def shingles(t):
        w = words(t, lower=True)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {x: shingles(x[1]) for x in set(want)}
    near = {x for x in sets for y in sets if x != y and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}
    assert {t for _, t in near} == {clean, next(t for i, t in rows if i == 1002)}
    want = [x for x in want if x not in near or x == (-1, clean)]  # a null id has a negative one, so it is the group's smallest
    assert pairs_of(done[1][2]) == sorted(want)
    first = {}
    spans = [(i, t, s, tuple(words(t)[s : s + 20])) for i, t in want for s in range(len(words(t)) - 19)]
    for i, _, s, window in spans:
        first[window] = min(first.get(window, (i, s)), (i, s))
    gone = {x: set() for x in want}
    for i, t, s, window in spans:
        if first[window] < (i, s):
            gone[i, t] |= set(range(s, s + 20))
    want = [(i, " ".join(w for k, w in enumerate(words(t)) if k not in gone[i, t])) for i, t in want]
    assert pairs_of(done[2][2]) == sorted(want)
    # A null id counts as the smallest: it keeps the benchmark text, and the later documents have lost theirs.
    assert {x[0]: len(g) for x, g in gone.items() if g} == {1011: 60, 1020: 30, 1040: 30}
    want = [x for x in want if bench not in x[1]]
    assert pairs_of(done[3][2]) == sorted(want) and sum(i == 1040 for i, _ in want) == 2 and sum(i == 1050 for i, _ in want) == 2
    pieces = done[4][2]
    assert pieces.where("start = 0").count() == len(want)
    other = done[3][2].where("doc_id = 1011").first()
    assert other.n_chars == len(other.text) and (other["_large"], other["component"], other["kept"]) == ("x", None, "y")


def test_empty_table_and_scratch_tables(spark, planted, tmp_path, monkeypatch):
    import corpus_pipeline
    from pairtide.llm import shared

    folder = planted[0]
    spark.read.parquet(str(folder / "documents.parquet")).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(folder / f"{name}.parquet")).where(F.lit(name == "labels")).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = list(shared._paths)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert shared._paths == before  # the stages' own tables are gone
    assert re.fullmatch(r"[a-z ]+", "".join(n for n, _ in corpus_pipeline.STAGES))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from pairtide.llm import shared

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(session)
