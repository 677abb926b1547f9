"""Packing token streams into fixed windows by minimum bin slack.

A document's ids (with an end id) are cut into full windows and one rest.  The
rests of a group of documents fill further windows: for each window a bitset
subset-sum dynamic program over the multiset of remaining lengths finds the
sum closest to the capacity, and walking back through the bitsets tells how
often each length is used.  If the closest sum leaves slack, one more rest is
cut to fill it.  What a group cannot fill to the end becomes windows whose
lengths are powers of two, which need no padding.

Groups are runs of rows of one partition with a bounded number of tokens, so nothing is
shuffled, memory is bounded and a lost task is repeated alone.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import lent, tidy
from .text import chunks, encode_words, split_words, string_array

CAPACITY = 4096
#: Bytes of text in one group; a single longer row is a group of its own.
GROUP_BYTES = 1 << 20
#: Bytes of text that are turned into ids together, so that a word of several groups is looked up once.
LOT_BYTES = 8 << 20
PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``capacity`` as possible without exceeding it.

    Bit s of ``reach`` says that s is a sum of the lengths seen so far.  A count is split into
    binary powers, so a length costs a logarithmic number of shifts; the walk back adds the parts that were used.
    The longest lengths come first and win ties."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> best & 1:  # only this step reaches the sum
            taken[length] += take
            best -= length * take
    return dict(taken)


def plan(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length) over all documents' lengths; empty documents have no piece."""
    windows, rests = [], defaultdict(list)
    for doc, n in enumerate(lengths.tolist()):
        full = n - n % capacity
        windows += [[(doc, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            rests[n - full].append((doc, full))
    total = sum(length * len(x) for length, x in rests.items())

    def pop(length: int) -> tuple[int, int]:
        piece = rests[length].pop()
        if not rests[length]:
            del rests[length]
        return piece

    while total >= capacity:
        window, room = [], capacity
        for length, times in sorted(closest_fill({k: len(v) for k, v in rests.items()}, capacity).items(), reverse=True):
            for _ in range(times):
                window.append((*pop(length), length))
                room -= length
        if room:  # no multiset fits exactly: cut the longest rest that remains
            length = max(rests)
            doc, start = pop(length)
            window.append((doc, start, room))
            rests[length - room].append((doc, start + room))
        windows.append(window)
        total -= capacity
    queue = [(*piece, length) for length in sorted(rests, reverse=True) for piece in rests[length]]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            doc, start, length = queue.pop()
            take = min(room, length)
            window.append((doc, start, take))
            if take < length:
                queue.append((doc, start + take, length - take))
            room -= take
        windows.append(window)
    return windows


#: Fixed values of the tokenizer file: how it splits and normalises text.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of ASCII and Latin-1 letters are already in NFC and split by ``_PLAIN_SPLIT`` as by the file's own pattern.
_PLAIN_WORD = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+| ")


class WordTokenizer:
    """Ids of texts by a tokenizer of the library ``tokenizers`` that never joins characters across white space.

    Each distinct word is encoded once.  Words of plain letters are split here
    and their distinct pieces are encoded together, which saves the library's
    slow splitting; all other words go through the whole tokenizer."""

    def __init__(self, path: str, known: int = 400_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        if spec["normalizer"].get("normalizers") != _NORMALIZER or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _SPLIT}:
            raise ValueError(f"{path} may join characters across white space")
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = known
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids, self.word_sizes = {}, np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.known, self.piece_ids, self.piece_sizes = {" ": 0}, np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _pieces_of(self, split: list[str]) -> np.ndarray:
        """The number in the store of each piece; unseen pieces are encoded together and added."""
        codes, distinct = encode_words(pa.array(split, pa.large_string()))
        listed = distinct.to_pylist()
        numbers = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(numbers < 0)
        unseen = [listed[i] for i in new.tolist()]
        ids = []
        for at in range(0, len(unseen), 500):
            ids += self.pieces.encode_batch_fast([" ".join(unseen[at : at + 500])], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(unseen):
            raise ValueError("a piece without an end")
        numbers[new] = np.arange(len(self.known), len(self.known) + len(unseen))
        self.known.update(zip(unseen, numbers[new].tolist(), strict=True))
        self.piece_ids = np.concatenate([self.piece_ids, ids])
        self.piece_sizes = np.concatenate([self.piece_sizes, np.diff(ends, prepend=-1).astype(np.int32)])
        return numbers[codes]

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Append the ids of new words to the store; their numbers in it."""
        plain = pc.and_not(pc.match_substring_regex(fresh, _PLAIN_WORD), pc.match_substring(fresh, "<|"))
        odd, even = fresh.filter(pc.invert(plain)).to_pylist(), fresh.filter(plain).to_pylist()
        found = [self.whole.encode(w, add_special_tokens=False).ids for w in odd]
        pieces = self._pieces_of(_PLAIN_SPLIT.findall(" ".join(even).lower()))
        sizes = self.piece_sizes[pieces]
        word = np.cumsum(pieces == 0)
        per_word = np.bincount(word, weights=sizes, minlength=len(even)).astype(np.int32) if even else np.zeros(0, np.int32)
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(found), np.uint32), runs(self.piece_ids, self.piece_sizes, pieces)])
        self.word_sizes = np.concatenate([self.word_sizes, np.fromiter(map(len, found), np.int32, len(found)), per_word])
        numbers = np.arange(len(self.words), len(self.words) + len(fresh))
        self.words.update(zip(chain(odd, even), numbers.tolist(), strict=True))
        return numbers[np.argsort(np.argsort(np.asarray(plain), kind="stable"))]

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end_id`` after each text, and each text's first id."""
        words, bounds = split_words(texts)
        codes, distinct = encode_words(words)
        if len(self.words) > self.most:
            self._forget()
        listed = distinct.to_pylist()
        at = np.fromiter(map(self.words.get, listed, repeat(-1)), np.int64, len(listed))
        new = at < 0
        if new.any():
            at[new] = self._learn(distinct.filter(pa.array(new)))
        # The end id is one more word, after each text's own.
        sequence = np.insert(at[codes], bounds[1:], len(self.word_sizes))
        sizes = np.append(self.word_sizes, np.int32(1))
        upto = np.concatenate([[0], np.cumsum(sizes[sequence])])
        return runs(np.append(self.word_ids, np.uint32(end_id)), sizes, sequence), upto[bounds + np.arange(len(bounds))]


def _tokenizer(path: str):
    """One for all tasks of a worker, which read the file once and share the words they know; it goes when the worker packs no more."""
    return lent(f"tokenizer of {path}", lambda: WordTokenizer(path))


def _lots(batch: pa.RecordBatch, group_bytes: int, most: int):
    """Groups of rows of up to ``group_bytes`` of text, in lots of some ``most`` bytes: a lot's rows and where its groups begin and end."""
    first, ends, size = 0, [0], 0
    for part in chunks(batch, most=group_bytes):
        own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if size and size + own > most:
            yield batch.slice(first, ends[-1]), ends
            first, ends, size = first + ends[-1], [0], 0
        ends.append(ends[-1] + part.num_rows)
        size += own
    if ends[-1]:
        yield batch.slice(first, ends[-1]), ends


def runs(flat: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The picked runs of ``flat``, which holds runs of ``sizes`` back to back."""
    firsts = np.cumsum(sizes, dtype=np.int32) - sizes
    per = sizes[picked]
    upto = np.cumsum(per, dtype=np.int32)
    return flat[np.repeat(firsts[picked] - (upto - per), per) + np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32)]


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 2, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (ids as little-endian uint32), doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id.  Every id of every row lies
    in exactly one piece; rows with equal or null ids are packed each for itself.  An empty table
    gives no piece.  ``sequence_id`` holds the partition in its upper half and
    counts windows in its lower half.  The tokenizer file is read where the task runs."""

    def run(batches):
        with _tokenizer(tokenizer_path) as tokenize:
            yield from packed(batches, tokenize)

    def packed(batches, tokenize):
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lot, ends in _lots(batch, group_bytes, LOT_BYTES):
                ids, firsts = tokenize(string_array(lot.column("text")), end_id)
                raw = memoryview(ids).cast("B")
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    part, starts = lot.slice(a, b - a), firsts[a : b + 1]
                    lengths = np.diff(starts)
                    windows = plan(lengths, capacity)
                    rows = np.array([(doc, start, length, sequence + w) for w, window in enumerate(windows) for doc, start, length in window], np.int64).reshape(-1, 4)
                    sequence += len(windows)
                    doc, start, length, seq = rows.T
                    upto = np.cumsum(length)
                    first = np.concatenate([[True], seq[1:] != seq[:-1]]) if len(rows) else np.zeros(0, bool)
                    base = (upto - length)[first]
                    offset = upto - length - np.repeat(base, np.diff(np.append(np.flatnonzero(first), len(rows))))
                    at = (starts[doc] + start) * 4
                    tokens = [bytes(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                    for lo in range(0, len(rows), 2000):
                        s = slice(lo, lo + 2000)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(doc[s])).cast(pa.int64()), pa.array(start[s]), pa.array(length[s]), pa.array(tokens[s], pa.binary()), pa.array(lengths[doc[s]]), pa.array(seq[s]), pa.array(offset[s])],
                            names=["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"],
                        )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)
