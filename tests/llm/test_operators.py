"""Each operator against a brute-force version, a round trip or held-out accuracy, with the awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairtide.llm import chat, ctw, decontam, dedup, html, langid, neardup, packing, quality, shards
from pairtide.llm.text import string_array, window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(70):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 140))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 20) : 60 - rng.randint(0, 20)]
        out.append((i, ("\n" if i % 2 else " ").join(w), "xx" if i % 2 else None, "s", 0))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(70, 90):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w), "xx", "s", 0))
    out += [(90, None, None, None, None), (91, "", "xx", "s", 0), (92, " \n\t ", "xx", "s", 0), (93, "One", None, "s", 3), (94, "a b c", None, "s", 3), (95, "A B C", None, "s", 3)]
    out += [(96, out[71][1], "xx", "s", 0), (97, out[71][1], "xx", "s", 0), (98, "long " * 30_000, "xx", "s", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The same rows with columns that an operator adds already there."""
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def test_window_hashes_and_slices():
    h = np.array([5, 6, 7, 5, 6, 7, 5, 6], np.uint64)
    for size in range(1, 8):
        got = window_hashes(h, size)
        same = {tuple(h[i : i + size]) for i in range(len(h) - size + 1)}
        assert len(set(got.tolist())) == len(same) and len(got) == len(h) - size + 1
    a = pa.array(["A b", None, "C d e", "F"])
    assert string_array(a.slice(2, 2)).to_pylist() == ["C d e", "F"] and string_array(a.slice(1, 1)).to_pylist() == [""]


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(6)
    source = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER)) for r in rows]
    items = [(i, " - ".join(w[4:30]).upper().replace("É", "é").replace("Ñ", "ñ")) for i, w in enumerate(source) if i % 9 == 0 and len(w) > 34]
    items += [(100, "One"), (101, "b, C"), (102, None), (103, "!!"), (104, " ".join(rng.choice(source[1] or ["q"]) for _ in range(7)) if source[1] else "q"), (105, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(str(i))
    sizes = {len(k) for k in windows}
    want = {}
    for r, w in zip(rows, source, strict=True):
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        want[r[0]] = (len(w), len(hit), sorted(found), bool(hit))
    got = decontam.contamination(clashing(docs, "n_words", "spans"), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got} == want and len(got) == len(rows)
    assert any(v[3] for v in want.values()) and all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in got)
    assert decontam.contamination(empty, bench).count() == 0
    assert not decontam.contamination(docs, bench.where("false")).where("contaminated or n_items > 0").count()


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for r in rows:
        w = words(r[1], lower=True)
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = neardup.near_duplicates(clashing(docs, "kept", "n_shingles")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert sum(not r.kept for r in got) > 10
    assert neardup.near_duplicates(empty).count() == 0
    odd = docs.where("doc_id in (71, 90)").unionByName(docs.where("doc_id = 71").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("k", F.lit("row"))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept, r.k) for r in neardup.near_duplicates(odd, "k").collect()) == [(0, 0, True, "row"), (71, 71, True, "row"), (90, 90, True, "row")]
    twice = neardup.near_duplicates(docs.where("doc_id in (71, 96, 90)").unionByName(docs.where("doc_id in (71, 90)"))).collect()
    assert sorted((r.doc_id, r.kept) for r in twice) == [(71, True), (71, True), (90, True), (90, True), (96, False)]


def test_round_two_links_blocks(spark):
    """Chains whose ends only meet through members that are not a bucket's smallest id."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    chain = [(100 - i, " ".join(base[:100] + base[100 + 8 * i :][:100])) for i in range(8)]
    got = neardup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {93}


def test_round_two_deals_the_minority(spark):
    """Thousands of near copies and one stray: the stray asks every block once, the copies are not dealt against each other."""
    from pairtide.llm.shared import written

    n = 5000
    sig = np.zeros((n + 1, neardup.HASHES), np.uint32)
    sig[n, neardup.LEAST_AGREEING :] = 7
    rows = [(i, sig[i].tobytes()) for i in range(n + 1)]
    reps = written(spark.createDataFrame(rows, "doc_id long, signature binary"), "reps")
    members = spark.createDataFrame([(5, 0, i) for i in range(n + 1)], "bucket long, band int, doc_id long")
    parts = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(n + 1)], "doc_id long, text string")
    got = neardup._round_two(members, parts, reps, docs).collect()
    assert all(n in (r.u, r.v) for r in got) and 0 < len(got) <= 5  # one link for each block at most


def brute_dedup(rows, size=20):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        w = words(text)
        gone = set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone |= set(range(s, s + size))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, rows, empty, batches):
    got = dedup.remove_all(clashing(docs, "n_removed"), batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_dedup(rows)
    assert got[0].asDict().keys() >= {"lang", "source"} and sum(r.n_removed for r in got) > 1000
    assert dedup.remove_all(empty, batches=batches).count() == 0


def test_index_runs_are_compacted(spark, docs):
    index = dedup.FingerprintIndex(spark, max_runs=1)
    first, second = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    dedup.remove_repeats(first, index)
    late = dedup.remove_repeats(second, index, first)
    assert len(index.runs) == 2
    kept = {r.doc_id: r.n_removed for r in late.collect()}
    before = index._read(False, *index.runs).count()
    index.compact()
    assert len(index.runs) == 1 and 0 < index._read(False, *index.runs).count() <= before
    assert kept[96] > 0
    index.bits = 12  # runs of other bucket counts are split as they are read
    index.runs *= 2
    index.max_runs, index.close = 1, lambda: None
    hashes = lambda: sorted(np.concatenate([np.frombuffer(r.fps, np.uint64) for r in index._read(False, *index.runs[:1]).collect()]).tolist())
    old = hashes()
    index.runs = [*index.runs[:1], dedup.new_path(spark, "anchors")]
    spark.createDataFrame([], "bucket int, fps binary, repeated boolean").write.parquet(index.runs[1])
    index.compact()
    assert hashes() == old and index._read(False, *index.runs).agg(F.max("bucket")).first()[0] > 1 << dedup.LEAST_BUCKETS


def test_query_compacts_and_odd_ids_count(spark, docs, rows):
    seen = []
    compact = dedup.FingerprintIndex.compact
    dedup.FingerprintIndex.compact = lambda self: (compact(self), seen.append(self.compactions))
    try:
        got = dedup.remove_all(docs).collect()
    finally:
        dedup.FingerprintIndex.compact = compact
    assert seen == [0, 1] and {r.doc_id: r.n_removed for r in got} == {k: v[1] for k, v in brute_dedup(rows).items()}
    passage = " ".join(f"w{k}" for k in range(25))
    odd = spark.createDataFrame([(None, passage), (None, passage), (5, passage + " x"), (5, passage + " x"), (6, passage)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in dedup.remove_all(odd).collect()) == [(-1, 0), (-1, 0), (5, 25), (5, 25), (6, 25)]


def test_a_group_is_worked_on_in_parts(monkeypatch):
    """All words of a group of 8 MB had arrays at one time, and workers kept what Arrow had freed, so executors ran out of memory in the pipeline."""
    from pairtide.llm import shared

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts = [*texts, *texts[:50], None, "", "a b c d " * 3000, *texts[150:]]
    docs = pa.table({"doc_id": [*range(len(texts) - 20), *range(20)], "text": texts})
    table, seen, anchors_of = np.full(1 << 17, 0x5B, np.uint8), [], dedup._anchors_of
    whole = dedup._candidates(docs, 20, 8, 20, table)
    monkeypatch.setattr(dedup, "_anchors_of", lambda texts, *more: seen.append(texts.nbytes) or anchors_of(texts, *more))
    monkeypatch.setattr(dedup, "PART_BYTES", 2000)
    split = []
    parts = dedup._candidates(docs, 20, 8, 20, table, split)
    assert len(whole[0]) > 1000 and all((a == b).all() for a, b in zip([*whole[:3], *whole[3]], [*parts[:3], *parts[3]], strict=True))
    assert [w for some, _ in split for w in some.to_pylist()] == [w for t in texts for w in words(t)]
    assert len(seen) > 5 and sorted(seen)[-2] < 6000  # the longest text is a part of its own

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    assert list(dedup.batch_anchors(Docs(), 20, 8, 5)(docs.to_batches())) and given == [1]
    assert list(dedup.batch_anchors(Docs(), 20, 8, 5)(iter([]))) == [] and given == [1, 1]


def test_sharding(docs, rows, empty):
    got = shards.assign(clashing(docs, "size", "shard"), 4).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    target, largest = sum(r.size for r in got) / 4, max(r.size for r in got)
    assert all(abs(sum(r.size for r in by.get(s, [])) - target) <= largest for s in range(4))
    assert shards.assign(empty).count() == 0
    assert shards.assign(docs.unionByName(docs)).count() == 2 * len(rows)


def test_closest_fill_and_plan():
    rng = random.Random(2)
    for _ in range(100):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(5)}
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        taken = packing.closest_fill(counts, 37)
        assert sum(a * b for a, b in taken.items()) == max(s for s in sums if s <= 37) and all(taken[k] <= counts[k] for k in taken)
        lengths = np.array([rng.randint(0, 40) for _ in range(rng.randint(0, 25))])
        windows = packing.plan(lengths, 16)
        pieces = sorted(p for w in windows for p in w)
        for doc, n in enumerate(lengths):
            assert [k for d, s, length in pieces if d == doc for k in range(s, s + length)] == list(range(n))
        assert all((t := sum(p[2] for p in w)) == 16 or t & (t - 1) == 0 for w in windows)


def test_packing_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, group_bytes=2000).collect()
    ids = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(ids[p.doc_id]) and p.length == len(p.tokens) // 4 > 0
        ids[p.doc_id] += np.frombuffer(p.tokens, "<u4").tolist()
    for i, text, *_ in rows:
        assert ids[i] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for part in windows.values():
        at = 0
        for p in sorted(part, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    assert packing.pack(empty, path).count() == 0


def test_groups_are_turned_into_ids_in_lots(monkeypatch):
    """Every group of 1 MB looked its words up anew, and every task read the tokenizer's file; the pieces are the same."""
    import public_tokenizers

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    path, asked = public_tokenizers.path("word_bpe_49k.json"), []
    texts = [None, "", "a b " * 700, *(f"word{i % 7} other{i}" for i in range(300)), "long " * 3000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tokens = packing.WordTokenizer.__call__
    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing.WordTokenizer, "__call__", lambda self, column, end: asked.append((id(self), len(column))) or tokens(self, column, end))
    run = packing.pack(Docs(), path, group_bytes=1000)
    whole = pa.Table.from_batches(run([batch, batch.slice(5, 0), batch.slice(7)])).to_pylist()
    assert [n for _, n in asked] == [len(texts), len(texts) - 7] and len({i for i, _ in asked}) == 1
    monkeypatch.setattr(packing, "LOT_BYTES", 1)
    assert pa.Table.from_batches(run([batch, batch.slice(7)])).to_pylist() == whole
    assert len(asked) > 12


def test_a_worker_gives_the_tokenizer_up(monkeypatch):
    """A worker that had packed kept the tokenizer and its words for ever, so later stages of the pipeline ran out of memory."""
    import gc
    import time
    import weakref

    import public_tokenizers

    from pairtide.llm import shared

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    used, tokens = [], packing.WordTokenizer.__call__
    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(shared, "IDLE", 1.5, raising=False)
    monkeypatch.setattr(packing.WordTokenizer, "__call__", lambda self, column, end: used.append(weakref.ref(self)) or tokens(self, column, end))
    run = packing.pack(Docs(), public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", "c"]})
    first, second = (pa.Table.from_batches(run([batch])).to_pylist() for _ in range(2))
    assert first == second and used[0]() is used[1]() is not None  # a stage's tasks share it
    time.sleep(2.5)
    gc.collect()
    assert used[1]() is None
    assert pa.Table.from_batches(run([batch])).to_pylist() == first


def test_tokenizer_words_are_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["  Hi <|endoftext|> x y\x1cq\x85w ", "it's we'll é ́a ISN'T", "", "ÀÉİİ ǅ ﬁ ΣΑΣ ß× ª1½", "don''t 12a3 __a__ 漢字かな"]
    ids, starts = packing.WordTokenizer(path)(string_array(pa.array(texts)), 2)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2]


def test_language_id(spark, empty):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ein", "ung", "der"], "cc": ["éau", "oux", "ment", "çon"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(15)), lang) for i, (lang, s) in enumerate(sorted(syllables.items()) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    held = langid.predict(clashing(df.where("doc_id % 4 = 2"), "score"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (None, "kato" * 20_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()} == {1: "und", 2: "und", 3: "und", None: "aa"}
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_quality_counts(docs, rows, empty):
    extra = [(200, "a b c\na b c\n\n x\na b c", "xx", "s", 0), (201, "# * $% a|b <c> &\n" * 3, None, "s", 0)]
    df = docs.unionByName(docs.sparkSession.createDataFrame(extra, SCHEMA))
    got = {r.doc_id: r for r in quality.apply(clashing(df, "n_words", "kept"), quality.QualityModel()).collect()}
    for i, text, *_ in [*rows, *extra]:
        w = words(text)
        threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {t for t, n in collections.Counter(threes).items() if n > 1}
        covered = {k + d for k, t in enumerate(threes) if t in twice for d in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.apply(empty, quality.QualityModel()).count() == 0
    assert quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("false")).cutoffs == {}


def test_bounds_are_exact():
    assert abs(quality.upper_bound(0, 10, 0.05) - (1 - 0.05**0.1)) < 1e-9
    assert abs(quality.upper_bound(1, 2, 0.05) - 0.95**0.5) > 0 and quality.upper_bound(3, 3, 0.05) == 1.0
    p = quality.upper_bound(4, 50, 0.01)
    from math import comb

    assert abs(sum(comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(5)) - 0.01) < 1e-9


def test_quality_rules_catch_junk(spark):
    rng = random.Random(4)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows, labels = [], []
    for i in range(1500):
        kind = i % 5
        text = clean()
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            text = text + " vileword"
        rows.append((i, text, "xx"))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.kept for r in quality.apply(docs, model).collect()}
    assert all(got[i] == (i % 5 > 1) for i in got)
    assert all(r["bound"] <= 0.02 for r in model.report)


def test_cutoffs_equal_brute_force_and_hold():
    """The chosen level against a plain search with binomial sums, and the guarantee by simulation."""
    from math import comb

    def bound(k, n, level):
        low, high = k / n, 1.0
        for _ in range(50):
            p = (low + high) / 2
            low, high = (p, high) if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > level else (low, p)
        return high

    rng, broken = random.Random(7), 0
    for trial in range(60):
        docs = {s: [(1, min(200, int(rng.expovariate(1 / 25)))) for _ in range(n)] + [(0, rng.randint(0, 200)) for _ in range(n // 3)] for s, n in (("a", 600), ("b", 260), ("c", 90))}
        counts = [(s, k, c, 1 - c) for s, rows in docs.items() for c, k in rows]
        chosen, report = quality.choose_cutoffs(counts, 0.02, 0.05)
        want = {}
        for s in "ab":  # c has too few clean documents, so two strata share delta
            clean, bad = ([k for c, k in docs[s] if c == x] for x in (1, 0))
            best = None
            for k in range(200, 0, -1):
                wrong, right = sum(x >= k for x in clean), sum(x >= k for x in bad)
                if bound(wrong, len(clean), 0.025) > 0.02:
                    break
                gain = right / len(bad) - 10 * wrong / len(clean)
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = gain, wrong, right
            want[s] = best and best[1:]
        got = {r["stratum"]: (r["clean_rejected"], r["bad_rejected"]) if r["level"] else None for r in report}
        assert got == want | {"c": None} and {r["stratum"]: r["n_clean"] for r in report} == {"a": 600, "b": 260, "c": 90}
        broken += any(np.exp(-k / 25) > 0.02 for k in chosen.values())
    assert broken <= 60 * 0.05 + 3


def test_quality_certifies_on_all_labels(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(2000):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
        rows.append((i, text.upper() if i % 4 == 0 else text, "xx"))
        labels.append((i, int(i % 4 != 0), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_learnt=100)
    assert set(model.cutoffs["xx"]) == {"capitals"} and all(r["n_clean"] + r["n_bad"] >= 1800 for r in model.report)
    assert all(r.kept == (r.doc_id % 4 != 0) for r in quality.apply(docs, model).collect())
    odd = docs.where("doc_id < 3").select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    got = quality.apply(docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).unionByName(odd), model).collect()
    assert sorted((r.doc_id, r.lang or "", r.kept) for r in got) == sorted([(i, "xx", i > 0) for i in range(3)] * 2 + [(i, "", True) for i in range(3)])


def test_quality_certifies_a_null_stratum(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, text().upper() if i % 4 == 0 else text(), None if i % 2 else "xx") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(2400)] + [(None, 1, 0), (7, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 8 < 4, F.col("lang"))), labels)
    assert {"", "xx"} == {r["stratum"] for r in model.report} and "" in model.cutoffs

def test_tone_tells_by_the_share_of_words(spark):
    """Beginnings that every text has by chance, but toxic ones ten times as often, in a language of few toxic rows."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [rng.choice(("zork", "mulp")) + "".join(rng.choices("aeiou", k=3)) if rng.random() < (0.05 if toxic else 0.002) else "".join(rng.choices("bcdfghjklm", k=5)) for _ in range(rng.randint(150, 400))]
        rows.append((i, " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words), "xx", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"zork*", "mulp*"} <= set(model.tones) and all(t[:3] in ("zor", "mul") for t in model.tones)
    got = {r.doc_id: r for r in quality.apply(docs, model).collect()}
    assert sum(not got[i].kept for i in range(0, 900, 9)) >= 95 and sum(not got[i].kept for i in range(900) if i % 9) <= 8
    for i, text, *_ in rows[:60]:
        values = []
        for word in text.split():
            bare = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            values.append(max([model.tones.get(bare, 0.0)] + [model.tones.get(bare[:n] + "*", 0.0) for n in (3, 4, 5, 6, 7) if len(bare) > n]))
        share = sum(values) / len(values)
        assert abs(got[i].tone_score - share / (share + quality.EVEN_TONE)) < 1e-9
    odd = docs.limit(1).select("doc_id", "lang", F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("?! ..."))).alias("text"))
    assert [r.tone_score for r in quality.apply(odd, model).collect()] == [0.0, 0.0, 0.0]


def test_ctw_is_a_distribution_and_learns(spark, docs, rows, empty):
    keys = np.unique(np.frombuffer(np.random.default_rng(0).integers(97, 101, 8 * 4000, dtype=np.uint8).tobytes(), ">u8") >> np.uint64(40))
    counts = np.arange(len(keys)) % 5
    tree = ctw.Subtrees(keys, counts, 2, [np.zeros(0, np.uint64)] * 2)
    top = ctw.top_levels(*tree.top(), 2)
    for context in (0x6161, 0x6463, 0x7A7A):
        every = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert abs((10 ** tree.log10(every, top)).sum() - 1) < 1e-9
    got = {r.doc_id: r for r in ctw.score(clashing(docs.withColumn("train", F.col("doc_id") % 5 != 1), "score")).collect()}
    c = collections.Counter()
    for r in rows:
        if r[0] % 5 != 1:
            c.update([*words(r[1], lower=True), "\n"])
    n, v = sum(c.values()), len(c)
    for i, text, *_ in rows:
        w = [*words(text, lower=True), "\n"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * max(1, len(w)) and r.score < 0
    assert sum(got[i].score for i in range(71, 90, 5)) > sum(got[i].base_score for i in range(71, 90, 5))
    assert ctw.score(empty.withColumn("train", F.lit(True))).count() == 0
    assert ctw.score(docs.withColumn("train", F.lit(False))).where("train_tokens <> 0 or n_known <> 0").count() == 0


def brute_ctw(train, texts, depth):
    """Context trees by the recursive definition with exact sums of the Krichevsky-Trofimov products."""
    from math import lgamma, log, pi

    stream = lambda text: b"\n" * depth + " ".join(words(text, lower=True)).encode() + b"\n"
    counts = collections.defaultdict(lambda: [0, 0])
    for text in train:
        s = stream(text)
        for i in range(depth, len(s)):
            for t in range(8):
                node, bit = (s[i] | 256) >> (8 - t), s[i] >> (7 - t) & 1
                for j in range(depth + 1):
                    counts[s[i - j : i], node][bit] += 1
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
    children, log_pw, own = collections.defaultdict(float), {}, {}
    for (context, node), (a, b) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        mine = kt(a, b)
        log_pw[context, node] = mine if len(context) == depth else np.logaddexp(mine, children[context, node]) - log(2)
        own[context, node] = 1.0 if len(context) == depth else np.exp(mine - log(2) - log_pw[context, node])
        children[context[1:], node] += log_pw[context, node]
    out = []
    for text in texts:
        s, total = stream(text), 0.0
        for i in range(depth, len(s)):
            for t in range(8):
                node, bit, p = (s[i] | 256) >> (8 - t), s[i] >> (7 - t) & 1, None
                for j in range(depth, -1, -1):
                    key = s[i - j : i], node
                    if key in counts:
                        a = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                        p = a if p is None else own[key] * a + (1 - own[key]) * p
                total += np.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_ctw_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "then", "é", "a", "Other"]) for _ in range(rng.randint(0, 12))) for _ in range(30)] + ["", None, "the " * 40]
    df = spark.createDataFrame([((i + 2) // 2 if i else None, t, None if i == 3 else i % 3 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    for n in (3, 5):
        want = brute_ctw([t for i, t in enumerate(texts) if i % 3 and i != 3], texts, n)
        hot = ctw.hot_contexts(df, 10**3, n, 40)
        assert [len(h) > 0 for h in hot] == [False, False] + [True] * (n - 2)  # subtrees of several lengths, folded into the top
        got = sorted((r.doc_id or -1, round(r.score, 4)) for r in ctw.score(df, depth=n).collect())
        expected = sorted(((i + 2) // 2 if i else -1, round(float(w), 4)) for i, w in enumerate(want))
        assert [x[0] for x in got] == [x[0] for x in expected] and np.allclose([x[1] for x in got], [x[1] for x in expected], atol=2e-3)


TEXTS = ["hi", "", None, "</s>[INST] ok [/INST]", "[\\INST] x <\\\\/s>", "a\n[/OUT]</s><s>[INST]user\nhey[/INST]</s>", "[NL]", "é" * 3000]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", None, "as\nsistant", "[NL]", "assistant[/INST]"]
    for role in roles:
        for text in TEXTS:
            segment = chat.render(role or "", text or "")
            assert [t[:2] for t in chat.parse(segment)] == [(role or "", text or "")]
    rows = [(c, t, roles[(c + t) % len(roles)], TEXTS[(3 * c + t) % len(TEXTS)]) for c in range(9) for t in range(c)]
    df = spark.createDataFrame([*rows, (None, 0, "user", "x"), (3, 1, "user", "tie")], "conv_id long, turn long, role string, text string").repartition(3)
    full = {r.conv_id: r for r in chat.formatted(df).collect()}
    short = {r.conv_id: r for r in chat.digests(chat.segments(df)).collect()}
    assert full.keys() == short.keys() == {*range(1, 9), None}
    for c in (5, 8):
        turns = [((r or ""), (t or "")) for k, _, r, t in rows if k == c]
        assert [x[:2] for x in chat.parse(full[c].formatted)] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        assert chat.unescape("".join(full[c].formatted[a:b] for a, b in full[c].loss_spans)) == loss
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (short[c].n_turns, short[c].turns_sha256, short[c].loss_chars, short[c].formatted_chars) == (len(turns), want, len(loss), len(full[c].formatted))
        assert short[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.segments(df.where("false"))).count() == 0


def test_html(spark):
    kinds = lambda page: [t for k, t in html.blocks(page) if k == html.MAIN]
    assert kinds("<nav>m</nav><article><header><h1>T</h1></header><p>x&amp;y <b>z</b>w<br>v<section class='comments'><p>c</p></section><aside>s</aside><p>&eacute;&lt;p&gt;</p></article><footer>f</footer>") == ["T", "x&y zw v", "é<p>"]
    assert kinds("<main><p>cut &am<b") == ["cut &am"] and html.blocks("") == [] and html.blocks("<script>var a='</p>';") == []
    main = lambda body: kinds(f"<article>{body}</article>")
    assert kinds("<script>if(i<n)x()</script><article><p>real</p></article>") == ["real"]
    assert main("<script>for(i=0;i<n;i++){f()}</script><p>real text</p><script>y()</script><p>tail</p>") == ["real text", "tail"]
    for raw in ("script", "style", "textarea", "title"):
        assert main(f"<p>a</p><{raw} x='1'>b<c d </p> '</{raw.upper()} ><p>e</p>") == ["a", "e"]
        assert main(f"<p>a</p><{raw}>b</{raw}x><p>c") == ["a"]
    assert main("<h2 id='notice-period'>n</h2><p id='share-prices'>s</p><div id='share-prices'>t</div><p class=ad>u <span class='ad'>v</span></p>") == ["n", "s", "t", "u v"]
    assert main("<div class='x ad-slot-2'>a</div><ul id=share_buttons><li>b</ul><div class='user-comments'><p>c</p></div><p>d</p>") == ["d"]
    assert main("<p>if a<b then c</p><p>x < y <3</p><p title='1>2'>z</p>") == ["if a<b then c", "x < y <3", "z"]
    menu = "home about contact news archive help search login legal terms"
    pages = [(i, "http://h.example/x", f"<div>{menu}</div><p>{i}th tale {i}</p>") for i in range(3)]
    pages += [(7, None, None), (8, "http://o.example/", f"<body><div>{menu}</div>"), (9, "http://h.example/y", "<article><p>kept</p></article>" + menu)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {**{i: f"{i}th tale {i}" for i in range(3)}, 7: "", 8: menu, 9: "kept"}
    assert html.extract(df.where("false")).count() == 0


def test_repeats_decide_in_articles_and_beside_them(spark):
    words_of = lambda seed, n: " ".join(f"w{seed}x{k}" for k in range(n))
    bio, teaser = words_of("bio", 12), words_of("t", 5)
    page = lambda i, text, url="http://a.example/": (i, url, f"<nav>{words_of('nav', 3)}</nav><article><p>{text}</p><p>{bio}</p></article>")
    pages = [page(i, words_of(i, 30)) for i in range(6)]
    pages += [page(6, words_of(0, 30))]  # the article of page 0 once more
    pages += [(7, "http://a.example/b", f"<nav>{words_of('nav', 3)}</nav><article>{teaser}</article><div>{words_of(7, 40)}</div><div>{bio}</div>")]
    pages += [(8 + i, "http://c.example/", f"<p>{words_of('same', 80)}</p>") for i in range(2)]  # one body twice, without a landmark
    pages += [(10 + i, "http://d.example/", f"<p>{words_of('near', 80)} end{i}</p>") for i in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    want = {i: words_of(i, 30) for i in range(6)} | {6: words_of(0, 30), 7: f"{teaser}\n\n{words_of(7, 40)}"}
    want |= {8 + i: words_of("same", 80) for i in range(2)} | {10 + i: f"{words_of('near', 80)} end{i}" for i in range(2)}
    assert got == want


def test_repeats_equal_brute_force(spark):
    """Contents and places of every repeated suffix, over hosts with few words, against a dictionary of all of them."""
    rng = random.Random(8)
    block = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
    pages = [(i, f"http://{'abc'[i % 3]}.example/", f"<nav>{block()}</nav><p>{block()}</p><article><p>{block()}</p><p>{block()}</p></article>") for i in range(150)]
    pages += [(160 + i, *pages[i][1:]) for i in range(5)] + [(170, "http://a.example/", " ".join(f"{k % 977}" for k in range(60_000)))]
    parsed = spark.createDataFrame(html.parsed(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect(), f"page_id long, url string, {html.PARSED}")
    contents, outside, opened = collections.defaultdict(set), set(), set()
    for r in parsed.collect():
        tokens = " ".join(r.texts).split(" ")
        marks = html._marks(r.texts, r.kinds)
        for i in range(len(tokens) - html.LENGTH + 1):
            key = (r.host, *tokens[i : i + html.LENGTH])
            contents[key].add(r.content)
            if marks[i] != html.FRAME:
                outside.add(key)
            if marks[i] == html.OPEN:
                opened.add(key)
    hosts = parsed.groupBy("host").agg(F.countDistinct("content").alias("contents")).cache()
    total = {r.host: r.contents for r in hosts.collect()}
    keys = {k for k, c in contents.items() if k in outside and (len(c) >= max(3, -(-total[k[0]] // 10)) or (len(c) > 1 and k in opened))}
    want = sorted((k[0], len(contents[k])) for k in keys)
    known = spark.sparkContext.broadcast(html.repeat_filter(parsed, hosts))
    got = html.repeated_suffixes(parsed.repartition(3), hosts, known)
    assert sorted((r.host, r.n) for r in got.collect()) == want and len(want) > 50
    at = html.places(parsed, known).join(got, "key").groupBy("row").count().collect()
    n = {}
    for r in parsed.collect():
        tokens, marks = " ".join(r.texts).split(" "), html._marks(r.texts, r.kinds)
        n[r.row] = sum((r.host, *tokens[i : i + html.LENGTH]) in keys and marks[i] != html.FRAME for i in range(len(marks)))
    assert {r.row: r["count"] for r in at} == {k: v for k, v in n.items() if v}


def test_text_helpers_do_not_depend_on_batching(spark, docs, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = dedup.remove_all(docs, batches=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_dedup(rows)
