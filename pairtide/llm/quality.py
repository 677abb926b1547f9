"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a score between 0 and 1 (symbols, capitals, separators, repeated
phrases, repeated lines, insulting words, the share of words that begin as those of toxic documents do).  A bounded sample of the labelled documents teaches what scores mean: a rule's
risk at a score is the share of bad documents among those with that score or more, made monotone.  A rule rejects a document if its risk reaches the risk cutoff of the document's
stratum (its language), so one number for each stratum fixes the cutoffs of all rules.

The risk cutoffs come from all other labelled documents that pass the base rules.  In each stratum candidates are tested from the highest risk down; a cutoff is
valid while the exact (Clopper-Pearson) upper bound on the share of clean documents that any rule rejects
stays at or below ``alpha``.  Testing stops at the first failure, so one level is spent on the whole sequence; it is ``delta`` divided by the
number of strata that have enough clean documents to pass with none rejected (sizes say nothing about outcomes).  With probability ``1 - delta`` no
stratum loses more than ``alpha`` of its clean documents to the rules.  Of the valid
cutoffs the one with the largest gain is used: the share of labelled bad
documents rejected less ten times the share of clean ones.  A stratum with too few labels to certify
anything rejects nothing beyond the fixed base rules; the report says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, written
from .text import (
    appended,
    chunks,
    encode_words,
    raw_bytes,
    rows_of,
    split_words,
    starts_of,
    string_array,
    sums_by_text,
    widened,
    without,
)

RULES = ("symbols", "capitals", "separators", "marks", "repeats", "lines", "insults", "tone")
BINS = 200
#: Terms that may insult: whole words (0) and first letters of words, which endings leave alone.
STEMS = (0, 3, 4, 5, 6, 7)
#: Share of words with a toxic beginning at which the tone is 1/2.
EVEN_TONE = 0.02
#: How often a term must be found in toxic documents, against the same number of words of others, to count for the tone.
LEAST_RATIO = 4.0
#: Weight of clean documents rejected against bad ones when a valid cutoff is chosen.
CLEAN_WEIGHT = 10.0
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = COUNTS + ", " + ", ".join(f"{r}_score double" for r in RULES)


@dataclass
class QualityModel:
    """Word risks, rule risks by bin of the score, and certified cutoffs: ``cutoffs[stratum][rule]``; a missing entry rejects nothing."""

    insults: dict[str, float] = field(default_factory=dict)
    tones: dict[str, float] = field(default_factory=dict)
    risks: dict[str, list[float]] = field(default_factory=dict)
    cutoffs: dict[str, dict[str, float]] = field(default_factory=dict)
    report: list[dict] = field(default_factory=list)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LETTER, _MARK = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _table(b"!?")


def _repeat_words(codes: np.ndarray, bounds: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in that text."""
    n = len(codes)
    if n < size:
        return np.zeros(len(bounds) - 1, np.int64)
    width = int(codes.max()) + 1
    pairs = pd.factorize(codes[:-1] * width + codes[1:])[0]
    threes = pd.factorize(pairs[:-1].astype(np.int64) * width + codes[2:])[0].astype(np.int64)
    at = np.flatnonzero(starts_of(bounds, size)[: n - size + 1])
    rows = rows_of(bounds)
    keys = pd.factorize(rows[at] * (int(threes.max()) + 1) + threes[at])[0]
    twice = at[np.bincount(keys)[keys] > 1] if len(at) else at
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[twice + k] = True
    return sums_by_text(covered, bounds)


def _dup_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line, of each text."""
    lists = pc.split_pattern(texts, "\n")
    bounds = np.asarray(lists.offsets, np.int64)
    codes, distinct = encode_words(lists.flatten())
    worded = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(distinct)), np.int64) > 0
    rows = rows_of(bounds - bounds[0])
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    lines = np.bincount(rows[keep], minlength=len(texts))
    keys = pd.unique(rows[keep] * max(1, len(distinct)) + codes[keep])
    return lines, lines - np.bincount(keys // max(1, len(distinct)), minlength=len(texts))


def _bare(words: pa.Array) -> pa.Array:
    """Lower-cased words without ASCII punctuation at their ends."""
    return pc.ascii_trim(pc.utf8_lower(words), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _terms(words: pa.Array, at: int) -> pa.Array:
    """Bare words (``at`` 0), or the first ``at`` characters of longer ones with an asterisk; null for the others."""
    if not at:
        return words
    longer = pc.greater(pc.utf8_length(words), at)
    return pc.if_else(longer, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, at), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string()))


def _of_words(bare: pa.Array, terms: dict[str, float]) -> np.ndarray:
    """The largest value of each bare word's terms, 0 for words without any."""
    values = np.append(np.fromiter(terms.values(), float, len(terms)), 0.0)
    known = pa.array(list(terms), pa.large_string())
    return np.max([values[np.asarray(pc.fill_null(pc.index_in(_terms(bare, n), value_set=known), len(terms)))] for n in STEMS], axis=0)


def _features(texts: pa.Array, insults: dict[str, float], tones: dict[str, float]) -> dict[str, np.ndarray]:
    data, spans = raw_bytes(texts)
    words, bounds = split_words(texts)
    codes, distinct = encode_words(words)
    n_words = np.diff(bounds)
    chars = np.asarray(pc.utf8_length(distinct), np.int64)
    word_chars = sums_by_text(chars[codes] if len(codes) else codes, bounds)
    symbols = sums_by_text(_SYMBOL[data], spans)
    lines, dup_lines = _dup_lines(texts)
    repeats = _repeat_words(codes, bounds)
    risk, tone = np.zeros(len(texts)), np.zeros(len(texts))
    if (insults or tones) and len(codes):
        bare = _bare(distinct)
        if insults:
            of_word = _of_words(bare, insults)
            hit = np.flatnonzero(of_word[codes] > 0)
            np.maximum.at(risk, rows_of(bounds)[hit], of_word[codes[hit]])
        if tones:
            tone = sums_by_text(_of_words(bare, tones)[codes], bounds) / np.maximum(n_words, 1)
    some = np.maximum(word_chars, 1)
    letters = np.maximum(sums_by_text(_LETTER[data], spans), 1)
    alone = np.asarray(pc.equal(distinct, "|"), bool) if len(distinct) else np.zeros(0, bool)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "symbols_score": np.minimum(symbols / some, 1),
        "capitals_score": sums_by_text(_UPPER[data], spans) / letters,
        "separators_score": sums_by_text(alone[codes] if len(codes) else codes, bounds) / np.maximum(n_words, 1),
        "marks_score": np.minimum(sums_by_text(_MARK[data], spans) / some, 1),
        "repeats_score": repeats / np.maximum(n_words, 1),
        "lines_score": dup_lines / np.maximum(lines, 1),
        "insults_score": risk,
        "tone_score": tone / (tone + EVEN_TONE),
    }



def upper_bound(rejected: int, n: int, level: float) -> float:
    """The exact one-sided binomial upper bound: the largest p at which ``rejected`` or fewer of ``n`` have probability ``level``."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if _at_most(rejected, n, p) > level else (low, p)
    return high


def _at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial; terms are added from the largest down until they no longer count."""
    lp, lq = math.log(p), math.log1p(-p) if p < 1 else -math.inf
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)
        total += term
        if i < n * p and term < 1e-18 * max(total, 1e-300):
            break
        i -= 1
    return total


def lower_bound(hits: int, n: int, level: float) -> float:
    """The exact one-sided binomial lower bound."""
    return 1 - upper_bound(n - hits, n, level)


def fit_terms(labelled: DataFrame, level: float = 0.02, least: float = 0.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and first letters of words (``STEMS``) of toxic documents: insults, and terms that are only more frequent there.

    ``labelled`` has (text, toxic).  An insult has an exact lower bound on the share of documents with it that are
    toxic of ``least`` or more.  A term counts for the tone if its places, not its documents, are in toxic documents more often than
    in as many words of others: by the exact lower bound on the share of its places, at ``level / 100`` as places of one document are not
    independent, ``LEAST_RATIO`` times as often; it must stand in three toxic documents, and its value is the part of its places that the bound
    leaves to them.  So a beginning that any text may have by chance tells by its share of the words, and
    few toxic documents of a language are enough.  The size is bounded by the terms of the labelled sample."""

    def bare_words(batches):
        for batch in batches:
            for part in chunks(batch, most=2 << 20):
                words, bounds = split_words(string_array(part.column("text")))
                bare, rows = _bare(words), rows_of(bounds)
                for stem in STEMS:
                    terms = _terms(bare, stem)
                    there = np.asarray(terms.is_valid(), bool)
                    codes, distinct = encode_words(terms.filter(pa.array(there)))
                    keys, times = np.unique(rows[there] * max(1, len(distinct)) + codes, return_counts=True)
                    toxic = np.asarray(part.column("toxic"))[keys // max(1, len(distinct))]
                    yield pa.RecordBatch.from_arrays([distinct.take(pa.array(keys % max(1, len(distinct)))).cast(pa.string()), pa.array(toxic, pa.int32()), pa.array(times, pa.int64())], names=["word", "toxic", "times"])

    known = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+"))
    total = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.sum(words).alias("n")).collect()}
    odds = total.get(True, 0) / max(1, total.get(False, 0))
    counted = (
        known.mapInArrow(tidy(bare_words), "word string, toxic int, times long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"), F.sum(F.col("times") * F.col("toxic")).alias("places"), F.sum("times").alias("times"))
        .where("word <> ''")
        .where(((F.col("hits") >= 4) & (F.col("hits") >= least * F.col("n"))) | ((F.col("hits") >= 3) & (F.col("places") >= LEAST_RATIO * odds * (F.col("times") - F.col("places")))))
        .collect()
    )
    insults = {r.word: lower_bound(r.hits, r.n, level) for r in counted if r.hits >= 4 and r.hits >= least * r.n}
    tones = {}
    for r in counted:
        share = lower_bound(r.places, r.times, level / 100)
        if r.hits >= 3 and share >= LEAST_RATIO * odds * (1 - share):
            tones[r.word] = share / (share + odds * (1 - share))
    return {w: round(p, 6) for w, p in sorted(insults.items()) if p >= least}, {w: round(p, 6) for w, p in sorted(tones.items())}


def rule_risks(counts) -> dict[str, list[float]]:
    """``counts``: (rule, bin, clean, bad) rows. For each rule the share of bad documents at or above each bin, no smaller than at a lower bin."""
    seen = {rule: np.zeros((2, BINS + 1), np.int64) for rule in RULES}
    for rule, b, clean, bad in counts:
        seen[rule][:, b] += (clean, bad)
    out = {}
    for rule, (clean, bad) in seen.items():
        above = np.cumsum(np.stack([clean, bad])[:, ::-1], axis=1)[:, ::-1]
        risk = np.maximum.accumulate(np.append(0.0, (above[1] / (above.sum(axis=0) + 1))[1:]))
        out[rule] = risk.round(6).tolist()
    return out


def least_clean(alpha: float, level: float) -> int:
    """Clean documents that are needed to certify a cutoff that rejects none of them."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def choose_cutoffs(counts, alpha: float, delta: float) -> tuple[dict[str, int], list[dict]]:
    """``counts``: (stratum, level, clean, bad) rows. Returns each stratum's certified level (documents at or above it are rejected) and a report of all strata."""
    table: dict[str, np.ndarray] = {}
    for stratum, k, clean, bad in counts:
        table.setdefault(stratum, np.zeros((2, BINS + 1), np.int64))[:, k] += (clean, bad)
    clean_of = {s: int(seen[0].sum()) for s, seen in table.items()}
    tested = 0
    while (n := sum(c >= least_clean(alpha, delta / max(1, tested + 1)) for c in clean_of.values())) > tested:
        tested += 1
    level = delta / max(1, tested)
    chosen, report = {}, []
    for stratum, seen in sorted(table.items()):
        n_clean, n_bad = (int(x) for x in seen.sum(axis=1))
        clean_at, bad_at = (np.cumsum(x[::-1])[::-1] for x in seen)
        best = None
        if n_clean >= least_clean(alpha, level):
            for k in range(BINS, 0, -1):
                if k < BINS and clean_at[k] == clean_at[k + 1] and bad_at[k] == bad_at[k + 1]:
                    continue
                if upper_bound(int(clean_at[k]), n_clean, level) > alpha:
                    break
                gain = bad_at[k] / max(1, n_bad) - CLEAN_WEIGHT * clean_at[k] / max(1, n_clean)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, k)
        row = {"stratum": stratum, "n_clean": n_clean, "n_bad": n_bad, "level": None, "clean_rejected": 0, "bad_rejected": 0, "bound": None}
        if best:
            k = chosen[stratum] = best[1]
            row |= {"level": k / BINS, "clean_rejected": int(clean_at[k]), "bad_rejected": int(bad_at[k]), "bound": upper_bound(int(clean_at[k]), n_clean, level)}
        report.append(row)
    return chosen, report


def rule_cutoffs(risks: dict[str, list[float]], level: int) -> dict[str, float]:
    """The score above which each rule's risk reaches the level; rules that never do are left out."""
    first = {rule: next((b for b in range(1, BINS + 1) if _level(r[b]) >= level), None) for rule, r in risks.items()}
    return {rule: (b - 1) / BINS for rule, b in first.items() if b}


def _level(risk: float) -> int:
    return int(risk * BINS + 1e-6)


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bins():
    return F.array(*[F.least(F.lit(BINS), F.ceil(F.col(f"{r}_score") * BINS)).cast("int") for r in RULES])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    stratum: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
    max_learnt: int = 20_000,
) -> QualityModel:
    """Learn the toxic terms and the rules' risks on one part of the labelled documents and certify the cutoffs on the rest.

    ``labels`` has (doc_id, quality, toxic); a document is clean if its quality
    is 1 and it is not toxic, bad otherwise.  Rows of ``labels`` with a null id or
    null quality are ignored, and of several rows of one id the worst counts.  The words and risks are
    learnt from a hash sample of a sixth of the labelled documents, at most about ``max_learnt``, whose
    ids are small enough to be broadcast by that bound.  The cutoffs are certified on all other labelled
    documents, however many: every document is reduced to its level before the labels are joined by a shuffle.
    Rows of ``docs`` with equal ids count one by one; a null stratum is the stratum ''.
    Without labels no cutoff is certified."""
    ids = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .withColumn("clean", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    )
    share = min(1 / 6, max_learnt / max(1, ids.count()))
    ids = ids.withColumn("learn", F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    sample = written(picked.join(F.broadcast(ids.where("learn").select("doc_id", "toxic", "clean")), "doc_id"), "learnt")
    model = QualityModel(*fit_terms(sample.select("text", "toxic")))
    learnt = score(sample, model).where(~_base_failed()).select("clean", F.posexplode(_bins()).alias("at", "bin")).groupBy("at", "bin").agg(F.sum("clean").alias("clean"), F.sum(1 - F.col("clean")).alias("bad"))
    model.risks = rule_risks((RULES[r["at"]], r.bin, r.clean, r.bad) for r in learnt.collect())
    for rule, terms in (("insults", model.insults), ("tone", model.tones)):
        if not terms:
            del model.risks[rule]
    levels = [F.element_at(F.array(*[F.lit(_level(x)) for x in model.risks[r]]), F.element_at("bins", i + 1) + 1) for i, r in enumerate(RULES) if r in model.risks]
    level = score(picked, model).where(~_base_failed()).select("doc_id", "stratum", _bins().alias("bins")).select("doc_id", "stratum", F.greatest(*levels).alias("level"))
    counts = level.join(ids.where("not learn").select("doc_id", "clean"), "doc_id").groupBy("stratum", "level").agg(F.sum("clean").alias("clean"), F.sum(1 - F.col("clean")).alias("bad"))
    chosen, model.report = choose_cutoffs(((r.stratum, r.level, r.clean, r.bad) for r in counts.collect()), alpha, delta)  # BINS + 1 rows a stratum
    model.cutoffs = {s: rule_cutoffs(model.risks, k) for s, k in chosen.items()}
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with the counts and rule scores; columns of the same names are replaced.

    A null or empty text has zero words and all scores 0."""
    docs = without(docs, [f.split()[0] for f in FEATURES.split(", ")])
    insults, tones = model.insults, model.tones

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=2 << 20):
                yield appended(part, **_features(string_array(part.column("text")), insults, tones))

    return docs.mapInArrow(tidy(run), widened(docs, FEATURES))


def apply(docs: DataFrame, model: QualityModel, *, stratum: str = "lang") -> DataFrame:
    """``docs`` with counts, scores and the verdict: base_failed, rejected_by (the first rule that rejects, or null), kept.

    Rows are judged one by one, so ties, repeated rows and repeated ids change
    nothing.  A null stratum is the stratum ''; one without certified cutoffs rejects nothing beyond the base rules."""
    scored = without(score(docs, model), ["base_failed", "rejected_by", "kept"])
    key = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    by = [
        F.when((key == s) & (F.col(f"{r}_score") > c), F.lit(r))
        for r in RULES
        for s, c in sorted((s, rules[r]) for s, rules in model.cutoffs.items() if r in rules)
    ]
    out = scored.withColumn("base_failed", _base_failed()).withColumn("rejected_by", F.coalesce(*by) if by else F.lit(None).cast("string"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
