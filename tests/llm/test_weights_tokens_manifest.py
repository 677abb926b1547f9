"""Importance resampling, prefix token counts and the manifest against brute force, with the awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairtide.llm import importance, manifest, tokens
from pairtide.llm.text import string_array

P = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_importance(rows, items, buckets, least, percent):
    found = [(key, *features(text)) for key, text in rows]
    s, t = (collections.Counter(c % buckets for f in each for c in f) for each in ([f for _, _, f in found], [features(x)[1] for x in items]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    out = []
    for key, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in f)
        out.append([key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéßñ漢7") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["x" * 300, "Ä" * 90]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    out += [out[3]] * 70 + ["", None, " \n ", "One", "A b", "a B c.d'e", "long words " * 20_000]
    return out


def test_importance_equals_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[6]), (None, None)]
    items = [texts[7], texts[8], None, "a B c d e"]
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t in rows], "doc_id long, text string, digest string, weight double").repartition(5)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    for least, percent, buckets in ((20, 30, 10_000), (1, 100, 7)):
        got = importance.resample(docs, target, least_words=least, percent=percent, n_buckets=buckets).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_importance(rows, items, buckets, least, percent)


def test_importance_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    got = importance.resample(some, empty, least_words=1, percent=100).first()
    assert (got.n_features, got["rank"]) == (3, 1)
    with pytest.raises(ValueError, match="n_buckets"):
        importance.resample(some, some, n_buckets=1 << 17)


def test_importance_features_are_made_once_a_text(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    once = importance.collapsed(docs).collect()
    assert len(once) == len({t or "" for t in texts}) and sum(r.copies for r in once) == len(texts)
    assert max(r.copies for r in once) == 71


def test_run_hashes_cover_long_words():
    words = ["a", "é" * 5000, "漢", "b" * 257, "a"]
    for k, got in enumerate(importance.run_hashes(pa.array(words, pa.large_string()))):
        assert got.tolist() == [zlib.crc32(" ".join(words[i : i + k + 1]).encode()) for i in range(len(words) - k)]


ALPHABET = [*"ab'sretvlmd  \n\t0123!?.éñ漢字  🙂\x1c\x85<|>", "<|endoftext|>", "'re", "'ll", " the", "and", "  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(library):
    rng, counter = random.Random(3), tokens.counter(P.path("byte_bpe_50k.json"))
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 25)))
        assert counter.prefixes(text) == [library(text[:i]) for i in range(1, len(text) + 1)]


def test_each_two_neighbours_decide(library):
    """The dynamic programme against plain merging of bytes."""
    rng, counter = random.Random(4), tokens.counter(P.path("byte_bpe_50k.json"))
    for _ in range(200):
        raw = bytes(rng.choice(b"aaabetinrs ") for _ in range(rng.randint(1, 14)))
        assert counter.bytes_prefixes(raw) == [0] + [len(counter.merged(raw[:i])) for i in range(1, len(raw) + 1)]


def test_segments_add_up(library):
    rng, counter = random.Random(5), tokens.counter(P.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    parts, bounds = tokens.segments(string_array(pa.array(texts)), counter.special)
    counts = [counter.count(s) for s in parts.cast(pa.large_binary()).to_pylist()]
    assert [sum(counts[a:b]) for a, b in itertools.pairwise(bounds.tolist())] == [library(t) for t in texts]


def test_token_counts_of_awkward_rows(spark, library):
    texts = [None, "", " ", "a" * 30_000, "many words, " * 5_000, "<|endoftext|>", "x<|endoftext|>  y", "It's  it'll\n\n ok", "It's  it'll\n\n ok"]
    rows = [(None if i == 4 else i, t, "kept", -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string, n_tokens int").repartition(3)
    got = tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=10)
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        n = library(r.text or "")
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.other) == (len((r.text or "").encode()), n, n > 10, "kept")
    assert got.count() == len(texts) and tokens.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_budgets_are_answered_from_prefixes(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = tokens.with_prefixes(docs, P.path("byte_bpe_50k.json"))
    got = kept.select("text", tokens.tokens_at(7).alias("at"), tokens.longest_within(5).alias("most"), F.size("prefix_tokens").alias("n")).collect()
    for r in got:
        text = r.text or ""
        assert r.n == len(text) and r["at"] == library(text[:7])
        assert r.most == max((i for i in range(1, len(text) + 1) if library(text[:i]) <= 5), default=0)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.PrefixCounter(P.path("word_bpe_49k.json"))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (key, group, leaf, seen).  All levels of all trees as lists."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            i //= 8

    order = sorted({g for _, g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] or r[2])) for g in order}
    trees = {g: levels([r[2] for r in members[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for i, (key, _, leaf, seen) in enumerate(members[g]):
            path = [*steps(trees[g], i), *steps(top, number)]
            fold = seen or leaf
            for lo, hi in path:
                fold = sha(lo, fold, hi)
            out.append((key, g, leaf, trees[g][-1][0], top[-1][0], sha(*(lo + hi for lo, hi in path)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9, "": 1, "é": 65, "z": 64, "b": 2, "c": 1, "d": 1, "e": 3, "f": 1}, {"one": 700, "two": 3}])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes):
    rng, rows = random.Random(8), []
    for g, n in sizes.items():
        for _ in range(n):
            leaf = sha(str(rng.random()))
            rows.append((rng.choice([None, *range(10_000)]), g, leaf, sha("other") if rng.random() < 0.3 else None))
    rows.append(rows[0])  # a repeated row
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, leaf string, seen string, node string").repartition(6)
    for depth in (1, 4):
        monkeypatch.setattr(manifest, "DEPTH", depth)
        got = manifest.manifest(df).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_of_no_rows_and_leaves_of_nulls(spark):
    assert manifest.manifest(spark.createDataFrame([], "doc_id long, lang string, leaf string, seen string")).collect() == []
    got = spark.createDataFrame([(1, None, "é")], "a long, b string, c string").select(manifest.leaf(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert got == sha("1:1", "-", "2:é")


def test_height():
    assert [manifest.height(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
    assert np.all(np.diff([manifest.height(n) for n in range(1, 5000)]) >= 0)
