"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) with single spaces between them and one
end byte.  Each byte is eight binary decisions; a decision's node is the bits of the
byte so far, and its contexts are the last 0 to ``DEPTH`` bytes.  Every context keeps a Krichevsky-Trofimov
estimate from its training counts, and contexts of all depths are mixed by the
context-tree weights ``Pw = (Pe + product of the children's Pw) / 2``, which are
worked out exactly from the counts.  A context that training never saw hands over to the next shorter one.
The score is log10 of the probability of the text with its end.

The counts grow with the corpus and stay distributed:

* tree nodes are dealt by their last two context bytes, so whole subtrees meet in one task; a pair of bytes with too many
  strings is dealt by three bytes, a triple with too many by four, and so on.  What stands above the subtrees (the root, 256
  contexts, and at most ``MOST_HOT`` hot ones for each length) is folded into one small table, which is broadcast;
* documents are dealt into groups of bounded size; a group asks for each distinct byte string
  and word it holds once, is told their log-probabilities and counts, and adds them up per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grouped, text_bytes
from .text import chunks, encode_words, from_planes, from_rising_planes, hash_words, mix, planes, rising_planes, split_words, string_array, sums_by_text

DEPTH = 6
GROUP_BYTES = 8 << 20
#: Text that is coded in one step.
STEP_BYTES = 4 << 20
#: Text of which the hot contexts are taken; they only decide which task has which subtree.
HOT_SAMPLE_BYTES = 64 << 20
MOST_HOT = 8192
_END = 10
_END_WORD = hash_words(pa.array(["\n"], pa.large_string()))[0]


def _keys(texts: pa.Array, depth: int):
    """The key of each byte of each text, the texts' bounds among them, and (words, bounds).

    A key has the nearest context byte highest and the byte itself lowest."""
    words, bounds = split_words(pc.ascii_lower(texts))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words), pa.scalar(" ", pa.large_string()))
    scalar = lambda s: pa.scalar(s, pa.large_string())
    padded = pc.binary_join_element_wise(scalar("\n" * depth), joined, scalar("\n"), scalar(""))
    starts = np.frombuffer(padded.buffers()[1], np.int64)[: len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[: starts[-1]]
    keys = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        keys |= data[depth - back : len(data) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    own = np.ones(len(data), bool)
    for k in range(depth):
        own[starts[:-1] + k] = False
    return keys[own[depth:]], starts - depth * np.arange(len(starts)), (words, bounds)


def _word_codes(words: pa.Array, bounds: np.ndarray):
    """Codes, hashes and bounds of the words with an end after each text."""
    word_codes, vocabulary = encode_words(words)
    hashes = np.append(hash_words(vocabulary), _END_WORD)
    word_codes = np.insert(word_codes, bounds[1:], len(vocabulary))
    return word_codes, hashes, bounds + np.arange(len(bounds))


def _streams(texts: pa.Array, depth: int):
    """Codes and keys of the byte strings and of the words of each text, with each text's bounds among them."""
    keys, byte_bounds, words = _keys(texts, depth)
    codes, distinct = pd.factorize(keys)
    return (codes.astype(np.int32), distinct, byte_bounds), _word_codes(*words)


def _distinct(values: np.ndarray):
    """The distinct values in order, and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def _is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _parts(keys: np.ndarray, grams: bool, depth: int, n_parts: int, hot) -> np.ndarray:
    """The part of each of the sorted keys: by the nearest context bytes, two or as many as end the hot contexts, or by the word's hash.

    ``hot[j]``: the hot contexts of j bytes, sorted."""
    if grams:
        length = np.zeros(len(keys) + 1, np.int8)
        for j in range(2, depth):  # keys are sorted, so those below a context are a range; hot contexts lie in hot ones
            shift = np.uint64(8 * (depth + 1 - j))
            np.add.at(length, np.searchsorted(keys, hot[j] << shift), 1)
            np.add.at(length, np.searchsorted(keys, (hot[j] + np.uint64(1)) << shift), -1)
        keys = mix(keys >> np.uint64(8 * (depth - 1)) if not any(map(len, hot)) else keys >> (8 * (depth - 1 - np.cumsum(length[:-1]).astype(np.int64))).astype(np.uint64))
    parts = (keys >> np.uint64(32)).astype(np.int64) * n_parts >> 32
    return parts.astype(np.uint16 if n_parts <= 1 << 16 else np.int32)  # short numbers are sorted fastest


def hot_contexts(docs: DataFrame, total_bytes: int, depth: int, n_parts: int) -> list[np.ndarray]:
    """For each number of bytes the contexts whose distinct strings are more than a quarter of an average part, MOST_HOT at most; from a hash sample."""
    share, most = min(1.0, HOT_SAMPLE_BYTES / max(1, total_bytes)), min(MOST_HOT, 4 * n_parts)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=STEP_BYTES):
                keys = _distinct(_keys(string_array(part.column("text")), depth)[0])[0]
                rows = []
                for j in range(2, depth):
                    context, n = np.unique(keys >> np.uint64(8 * (depth + 1 - j)), return_counts=True)
                    often = n * 2 * most > len(keys)  # half the share that counts, so few tasks hide one
                    rows += [(j, c, k, len(keys)) for c, k in zip(context[often].view(np.int64).tolist(), n[often].tolist(), strict=True)]
                rows.append((0, 0, 0, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([0 if r[0] else r[3] for r in rows], pa.int64())], names=["j", "context", "n", "of"])

    picked = docs.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = picked.mapInArrow(run, "j long, context long, n long, of long").groupBy("j", "context").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    every = counts.where("j = 0").agg(F.sum("of")).first()[0] or 0
    found = counts.where((F.col("j") > 0) & (F.col("n") * most > every)).collect()  # fewer than MOST_HOT for each of depth - 2 lengths
    out = [np.sort(np.array([r.context for r in found if r.j == j], np.int64).view(np.uint64)) for j in range(depth)]
    for j in range(3, depth):  # a context is only told apart below hot ones
        out[j] = out[j][_is_in(out[j] >> np.uint64(8), out[j - 1])]
    return out


class _Tally:
    """Distinct keys with their training counts, in ascending order; merged when enough have come."""

    def __init__(self):
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, distinct: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((distinct, counts))
        if sum(len(k) for k, _ in self.new) > 2 << 20:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        counts = np.concatenate([self.counts, *(c for _, c in self.new)])
        self.keys, counts = _summed(keys, counts)
        self.counts, self.new = counts.astype(np.int64), []

    def rows(self, kind: int, depth: int, n_parts: int, hot):
        """(kind, part, keys, counts) with the keys in ascending order in each part."""
        self.merge()
        part = _parts(self.keys, kind == 0, depth, n_parts, hot)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            yield kind, int(p), rising_planes(self.keys[at]), planes(self.counts[at].astype(np.uint32))


def _tally(parts, depth: int) -> tuple[_Tally, _Tally]:
    grams, words = _Tally(), _Tally()
    for part in parts:
        train = np.asarray(part.column("train"), bool)
        keys, bounds, split = _keys(string_array(part.column("text")), depth)
        learnt = np.repeat(train, np.diff(bounds))
        grams.add(*_distinct(keys[learnt]))
        if not train.all():
            others = _distinct(keys[~learnt])[0]
            grams.add(others, np.zeros(len(others), np.int64))
        codes, hashes, bounds = _word_codes(*split)
        words.add(hashes.astype(np.uint64), np.bincount(codes[np.repeat(train, np.diff(bounds))], minlength=len(hashes)))
    return grams, words


def _request_rows(tallies, gid, depth: int, n_parts: int, hot) -> pa.RecordBatch:
    rows = [r for kind, t in enumerate(tallies) for r in t.rows(kind, depth, n_parts, hot)]
    return pa.RecordBatch.from_arrays(
        [pa.array([gid] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
        names=["gid", "kind", "part", "keys", "counts"],
    )


REQUEST = "gid int, kind int, part int, keys binary, counts binary"


def _gather(table: pa.Table):
    """All keys of a part with their summed counts, and each row's keys as places among them."""
    rows = [from_rising_planes(k.as_buffer(), np.uint64) for k in table.column("keys")]
    counts = np.concatenate([from_planes(c.as_buffer(), np.uint32) for c in table.column("counts")])
    keys, total = _summed(np.concatenate(rows), counts)
    return keys, total.astype(np.int64), rows


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, stepped down."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


#: log Gamma at n + 1/2 and n + 1 for the counts n below 65536; nearly all are.
_HALVES, _WHOLES = (_log_gamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    n = a + b
    large = np.flatnonzero(n >= len(_WHOLES))
    x, y, z = (np.minimum(v, len(_WHOLES) - 1).astype(np.int32) for v in (a, b, n))
    out = _HALVES[x] + _HALVES[y] - _WHOLES[z]
    out[large] = _log_gamma(a[large] + 0.5) + _log_gamma(b[large] + 0.5) - _log_gamma(n[large] + 1.0)
    return out - np.log(np.pi)


def _weigh(a, b, children):
    """log Pw of nodes, and the weight of their own estimate in the mixture."""
    own = _log_kt(a, b)
    log_pw = np.logaddexp(own, children) - np.log(2)
    return log_pw, np.exp(own - np.log(2) - log_pw)


def _up(ids: np.ndarray) -> np.ndarray:
    """The nodes with the farthest context byte left out."""
    return (ids >> np.uint64(16) << np.uint64(8)) | (ids & np.uint64(255))


def _summed(ids: np.ndarray, *values: np.ndarray):
    """Distinct ids in order with the sums of their values.  The ids come in runs of rising order, so each is looked up near the one before."""
    distinct = _distinct(ids)[0]
    at = np.searchsorted(distinct, ids)
    return (distinct, *(np.bincount(at, weights=x, minlength=len(distinct)) for x in values))


class Subtrees:
    """The nodes over the byte strings of one part, with ``depth`` context bytes down to the two or more by which they were dealt.

    ``levels[j]``: (ids, zeros, ones, own weight) of the nodes with j context bytes; an id is the context, nearest byte first, and the bits so far."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, hot):
        self.depth, self.levels, self.tops = depth, {}, []
        seen = counts > 0
        ids, total, one = _decisions(keys[seen], counts[seen])
        below = None
        for j in range(depth, 1, -1):
            zeros = total - one
            log_pw, own = (_log_kt(zeros, one), np.ones(len(ids))) if below is None else _weigh(zeros, one, below)
            self.levels[j] = ids, zeros, one, own
            ends = _is_in(ids >> np.uint64(16), hot[j - 1]) if j > 2 else np.ones(len(ids), bool)
            if ends.any():
                self.tops.append((j - 1, *_summed(_up(ids[ends]), zeros[ends], one[ends], log_pw[ends])))
            if j > 2:
                on = ~ends
                ids, total, one, below = _summed(_up(ids[on]), total[on], one[on], log_pw[on])

    def top(self):
        """(context bytes, id, zeros, ones, log Pw) sums for the nodes right above the subtrees."""
        parts = [(np.full(len(ids), j), ids, *rest) for j, ids, *rest in self.tops]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0)] * 3)

    def log10(self, keys: np.ndarray, top: dict) -> np.ndarray:
        """log10 probability of each byte string's last byte, the strings in order; ``top``: see :func:`top_levels`.

        From the top down every node gets the probabilities of a zero and a one with itself as the deepest context, so
        a string only looks for its deepest node."""
        mixed = {}
        for j in sorted(self.levels):
            mixed[j] = _mixed(*self.levels[j], [m for m in (mixed.get(j - 1), top.get(j - 1)) if m])
        out = np.zeros(len(keys))
        byte, context = keys & np.uint64(255), keys >> np.uint64(8)
        for t in range(8):
            node = (byte | np.uint64(256)) >> np.uint64(8 - t)
            bit = ((byte >> np.uint64(7 - t)) & np.uint64(1)) == 1
            p, left = np.full(len(keys), 0.5), np.arange(len(keys))
            for j in range(self.depth, -1, -1):
                for levels in (mixed, top):
                    if j not in levels or not len(left):
                        continue
                    ids, zero, one, *_ = levels[j]
                    at, seen = _places(ids, (context[left] >> np.uint64(8 * (self.depth - j)) << np.uint64(8)) | node[left])
                    here = left[seen]
                    p[here] = np.where(bit[here], one[at[seen]], zero[at[seen]])
                    left = left[~seen]
            out += np.log10(p)
        return out


def _decisions(keys: np.ndarray, counts: np.ndarray):
    """For the eight decisions of the strings, which are in order: the distinct nodes under the whole context, their counts and ones, by node."""
    byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
    parts = []
    for t in range(8):
        ids = context | ((byte | np.uint64(256)) >> np.uint64(8 - t))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
        bits = ((byte >> np.uint64(7 - t)) & np.uint64(1)).astype(np.int64)
        parts.append((ids[first], *(np.add.reduceat(x, first) if len(first) else x for x in (counts, counts * bits))))
    ids, n, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    return ids[order], n[order].astype(float), ones[order].astype(float)


def _places(ids: np.ndarray, wanted: np.ndarray):
    """Where each wanted id is among the sorted ids, and whether it is there."""
    if not len(ids):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _mixed(ids, zeros, ones, own, above: list):
    """(ids, P(0), P(1) with the node as the deepest, P(0) and P(1) that the node and those above it give to deeper ones, the weight that is left to them).

    ``above``: tables of this form of the nodes with one context byte less; none for the root."""
    n = zeros + ones + 1
    kt, rest = np.stack([(zeros + 0.5) / n, (ones + 0.5) / n]), np.ones(len(ids))
    given = np.zeros_like(kt)
    for up, _, _, given_0, given_1, left in above:
        at, seen = _places(up, _up(ids))
        given[0, seen], given[1, seen], rest[seen] = given_0[at[seen]], given_1[at[seen]], left[at[seen]]
    return ids, *(given + rest * kt), *(given + rest * own * kt), rest * (1 - own)


def top_levels(level: np.ndarray, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_pw: np.ndarray, depth: int) -> dict:
    """The nodes above the subtrees by their number of context bytes, down to the root's 0, as tables of :func:`_mixed`."""
    out, empty = {}, np.zeros(0)
    came = np.zeros(0, np.uint64), empty, empty, empty
    for j in range(depth - 1, -1, -1):
        at = level == j
        if not at.any() and not len(came[0]):
            continue
        ids_, z, o, below = _summed(*(np.concatenate([x[at], c]) for x, c in zip((ids, zeros, ones, log_pw), came, strict=True)))
        up, own = _weigh(z, o, below)
        out[j] = ids_, z, o, own
        came = _up(ids_), z, o, up
    for j in sorted(out):
        out[j] = _mixed(*out[j], [out[j - 1]] if j else [])
    return out


def score(docs: DataFrame, *, depth: int = DEPTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text, train).

    Rows with ``train`` true teach both models, all rows are scored.  A null text
    is empty: one end token.  Without training rows every probability is even.  Rows with equal ids
    are scored each for itself; a null ``train`` is false; other columns are ignored.  The base
    model is ``log10((c + 0.5) / (N + 0.5 (V + 1)))`` over tokens."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be between 2 and 7")
    total = text_bytes(docs)
    n_parts = max(32, -(-total // (12 << 20)))
    hot = hot_contexts(docs, total, depth, n_parts)
    docs = grouped(docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train")), total, group_bytes)

    def count(batches):
        def parts():
            for batch in batches:
                yield from chunks(batch, most=STEP_BYTES)

        yield _request_rows(_tally(parts(), depth), None, depth, n_parts, hot)

    def summarise(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts, _ = _gather(table)
        if key[0].as_py() == 0:
            level, ids, zeros, ones, log_pw = Subtrees(keys, counts, depth, hot).top()
        else:
            level, ids, zeros, ones, log_pw = (np.array([x]) for x in (-1, np.uint64(0), float(counts.sum()), float((counts > 0).sum()), 0.0))
        return pa.table({"level": pa.array(level, pa.int32()), "id": pa.array(ids.view(np.int64)), "zeros": zeros, "ones": ones, "log_pw": log_pw})

    trained = docs.where("train").select("text", "train").mapInArrow(count, REQUEST)
    sums = trained.groupBy("kind", "part").applyInArrow(summarise, "level int, id long, zeros double, ones double, log_pw double")
    # 255 rows for each of 256 contexts and of the hot ones at most
    rows = sums.groupBy("level", "id").agg(F.sum("zeros"), F.sum("ones"), F.sum("log_pw")).collect()
    above = [r for r in rows if r[0] >= 0]
    top = top_levels(np.array([r[0] for r in above], np.int64), np.array([r[1] for r in above], np.int64).view(np.uint64), *(np.array([r[i] for r in above], float) for i in (2, 3, 4)), depth)
    n, v = next(((r[2], r[3]) for r in rows if r[0] < 0), (0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_request_rows(_tally(chunks(table, most=STEP_BYTES), depth), key[0].as_py(), depth, n_parts, hot)])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts, rows = _gather(table)
        if key[0].as_py() == 0:
            told = Subtrees(keys, counts, depth, hot).log10(keys, shared.value).astype(np.float32)
        else:
            told = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"gid": table.column("gid"), "kind": table.column("kind"), "part": table.column("part"), "told": pa.array([planes(told[np.searchsorted(keys, r)]) for r in rows], pa.binary())})

    def settle(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(chunks(left, most=STEP_BYTES))
        streams = [_streams(string_array(p.column("text")), depth) for p in parts]
        rows = list(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("told"), strict=True))
        sums = [[] for _ in parts]
        for kind, form in enumerate((np.float32, np.uint32)):
            each = [s[kind][1].astype(np.uint64) for s in streams]
            keys = _distinct(np.concatenate(each))[0]
            order = np.argsort(_parts(keys, kind == 0, depth, n_parts, hot), kind="stable")
            told = [from_planes(raw.as_buffer(), form) for _, _, raw in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1])]
            values = np.empty(len(keys))
            values[order] = np.concatenate(told)
            for out, (codes, _, bounds), some in zip(sums, (s[kind] for s in streams), each, strict=True):
                of = values[np.searchsorted(keys, some)]
                if kind == 0:
                    out.append(sums_by_text(of[codes], bounds))
                else:
                    out += [np.diff(bounds), sums_by_text((of > 0)[codes], bounds), sums_by_text(np.log10((of + 0.5) / (n + 0.5 * (v + 1)))[codes], bounds)]
        return pa.concat_tables(
            pa.table({"doc_id": p.column("doc_id"), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(tokens), int(n)), "base_score": base, "score": total})
            for p, (total, tokens, known, base) in zip(parts, sums, strict=True)
        )

    asked = docs.groupBy("gid").applyInArrow(ask, REQUEST)
    told = asked.groupBy("kind", "part").applyInArrow(answer, "gid int, kind int, part int, told binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(settle, schema)
