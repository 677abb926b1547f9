"""Exact token counts of every prefix, for byte-level BPE tokenizers.

A byte-pair encoding is the only sequence of tokens in which each two neighbours encode to themselves.  So
the last token of every prefix of a pre-token follows from the last tokens of shorter ones: of the tokens that end
there, found by an Aho-Corasick automaton, one agrees with the last token of what is before it.  A prefix then has one token more than the prefix before its last token.

A text is cut where no pre-token can cross, so counts of the segments add up, and each distinct segment is worked out once a worker.
Inside a segment, prefixes that end in white space or in a contraction are cut differently from the whole text; these are counted as texts of their own.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept
from .text import appended, chunks, from_bytes, raw_bytes, string_array, sums_by_text, widened, without

#: What ``\\s`` matches.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Segments up to this many bytes are remembered, MOST of them a worker.
SHORT, MOST = 64, 1 << 20

#: A segment that is one pre-token.
_ONE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+)")

#: Kinds of ASCII bytes: 1 white space, 2 letters, 3 digits, 4 other signs but the quote, which may begin a contraction, 5 the quote; 0 any other byte.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[ord("'")] = 5


def _alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts by the tokenizer file at ``path``; other kinds than plain byte-level BPE are refused."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or any(odd):
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word ends are not supported")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        byte = _alphabet()
        raw = lambda token: bytes(byte[c] for c in token)
        self.tokens = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.ends = ahocorasick.Automaton()
        for i, token in self.tokens.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.agreed: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain byte-pair encoding: the pair of lowest rank first, the leftmost of equal ones."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: int, b: int) -> bool:
        """Whether tokens a and b, in this order, encode to themselves; a = -1: b alone."""
        own = [self.tokens[b]] if a < 0 else [self.tokens[a], self.tokens[b]]
        ok = self.agreed[a, b] = self.merged(b"".join(own)) == own
        return ok

    def bytes_prefixes(self, raw: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token, by bytes from 0."""
        last, count, agreed = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), self.agreed
        for end, (token, size) in self.ends.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                a = last[end - size]
                if (ok := agreed.get((a, token))) is None:
                    ok = self.agree(a, token)
                if ok:
                    last[end], count[end] = token, count[end - size] + 1
        return count

    def _characters(self, text: str) -> list[int]:
        """Tokens of each prefix of one pre-token, by characters from 1."""
        count = self.bytes_prefixes(text.encode())
        if len(count) == len(text) + 1:
            return count[1:]
        return [count[end] for end in np.cumsum([len(c.encode()) for c in text]).tolist()]

    def plain_prefixes(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special strings, by characters from 1."""
        out: list[int] = []
        for _, (start, end) in self.cut(text):
            own, base = self._characters(text[start:end]), out[-1] if out else 0
            if end - start == 3 and text[start] == "'" and text[start:end] in ("'re", "'ve", "'ll"):
                own[1] = 2  # not yet a contraction: a quote and a letter
            out += [base + n for n in own]
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in SPACES:
                end += 1
            if end - at > 1:  # up to here white space is one pre-token, whatever follows
                base = out[at - 1] if at else 0
                out[at:end] = [base + n for n in self._characters(text[at:end])]
            at = max(end, at + 1)
        return out

    def prefixes(self, text: str) -> list[int]:
        """Tokens of each prefix of a text, by characters from 1; a special string counts as one token once it is whole."""
        out, base, at = [], 0, 0
        while True:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                return out + [base + n for n in self.plain_prefixes(text[at:])]
            i, _, special = min(found)
            out += [base + n for n in self.plain_prefixes(text[at : i + len(special) - 1])]
            base = (out[i - 1] if i > at else base) + 1
            out.append(base)
            at = i + len(special)

    def count(self, raw: bytes) -> int:
        """Tokens of a segment: the count of its longest prefix."""
        if (n := self.known.get(raw)) is None:
            n = self.bytes_prefixes(raw)[-1] if _ONE.fullmatch(raw) else self.prefixes(raw.decode())[-1]
            if len(raw) <= SHORT:
                if len(self.known) >= MOST:
                    self.known.clear()
                self.known[raw] = n
        return n


def counter(path: str) -> PrefixCounter:
    """One counter a worker process."""
    return kept(f"counter of {path}", lambda: PrefixCounter(path))


def segments(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces that no pre-token crosses, for all texts in order, and each text's first piece (one entry more than texts).

    Cuts lie before white space, and where letters, digits and other ASCII signs meet; not inside special strings.  A cut is left out
    after characters that may be white space themselves and beside other characters; longer pieces have the same counts."""
    data, bounds = raw_bytes(texts)
    kind = _KIND[data]
    before, after = kind[:-1], kind[1:]
    at = np.flatnonzero((after == 1) & (before != 1)) + 1
    b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    safe = kind[at - 1] > 1
    safe |= (b1 >= 0x80) & ((b2 >= 0xC3) & (b2 < 0xE0) | (b2 >= 0x80) & (b2 < 0xC0) & (b3 >= 0xE4) & (b3 < 0xF0))
    meet = np.flatnonzero((before >= 2) & (before < 5) & (after >= 2) & (before != after) & ~((before == 4) & (after == 5))) + 1
    cuts, raw, whole = np.concatenate([at[safe], meet]), data.tobytes(), np.zeros(len(data), bool)
    for s in map(str.encode, special):
        place = raw.find(s)
        while place >= 0:
            whole[place + 1 : place + len(s)] = True
            place = raw.find(s, place + 1)
    cuts = cuts[~whole[cuts]]
    first = bounds[:-1][np.diff(bounds) > 0]
    starts = np.unique(np.concatenate([first, cuts]))
    return from_bytes(data, np.append(starts, len(data))), np.searchsorted(starts, bounds)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    Special strings inside a text are special tokens; none is added.  A null text is empty: 0 bytes, 0 tokens.  Each row is counted for itself, so repeated rows and null keys are kept; an empty table stays empty."""
    rows = without(docs, ("n_bytes", "n_tokens", "over_limit"))

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            for part in chunks(batch, text):
                parts, bounds = segments(string_array(part.column(text)), tokens.special)
                coded = parts.dictionary_encode()
                counts = np.array([tokens.count(s) for s in coded.dictionary.cast(pa.large_binary()).to_pylist()] or [0], np.int64)
                own = counts[np.asarray(coded.indices)] if len(parts) else np.zeros(0, np.int64)
                yield appended(part, n_tokens=sums_by_text(own, bounds))

    out = rows.mapInArrow(run, widened(rows, "n_tokens long"))
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def with_prefixes(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: entry i is the exact token count of the text's first i characters (empty for a null or empty text).

    Written once, the table answers questions of budgets and cuts by :func:`tokens_at` and :func:`longest_within` without a tokenizer.  A column of this name is replaced."""
    rows = without(docs, ("prefix_tokens",))

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            for part in chunks(batch, text, 1 << 20):
                parts, bounds = segments(string_array(part.column(text)), tokens.special)
                coded = parts.dictionary_encode()
                each = [np.array(tokens.prefixes(s), np.int32) for s in coded.dictionary.to_pylist()]
                codes, out = np.asarray(coded.indices).tolist(), []
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    mine, base = [], 0
                    for code in codes[a:b]:
                        mine.append(each[code] + base)
                        base += int(each[code][-1])
                    out.append(np.concatenate(mine) if mine else np.zeros(0, np.int32))
                yield appended(part, prefix_tokens=pa.array(out, pa.list_(pa.int32())))

    return rows.mapInArrow(run, widened(rows, "prefix_tokens array<int>"))


def tokens_at(n_chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first ``n_chars`` characters; of the whole text if it is shorter."""
    counts, n = F.col(prefix_tokens), F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.when((n <= 0) | (F.size(counts) == 0), 0).otherwise(F.get(counts, F.least(n, F.size(counts)) - 1))


def longest_within(budget: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """The largest number of leading characters whose tokens fit into ``budget``; counts may fall again as a text goes on, so the last that fits decides."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.filter(F.transform(F.col(prefix_tokens), lambda n, i: F.when(n <= budget, i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(fits), F.lit(0))
