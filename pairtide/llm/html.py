"""Main text of web pages: landmarks of the markup, and token runs that a host's pages share.

A page becomes blocks of text.  Blocks inside an article landmark are its main text, blocks inside menus, footers,
adverts and the like are its frame, and the rest is open.  The tokens of all blocks form the page's stream.  The suffixes of a host's streams are
grouped by their first ``LENGTH`` tokens: the classes that a suffix array would hold as neighbours with a common prefix of that length, found by hashes and without the order between
classes, so no task holds a host.  Longer repeats are unbroken runs of such places.  Suffixes are dealt by a hash of the host and their first LENGTH tokens.  Equal suffixes have equal anchors (the smallest hash of
their ``GRAM``-token windows), and a bit table of the anchors that occur often enough outside frames keeps all others out of the shuffle.

Frames go; in all other blocks, article or open, the repeats decide.  A page's content is its text outside frames, and pages of a host
with equal content count once, so an article that a host carries twice is no repeat.  A repeated run is boilerplate

* in open blocks if two contents carry it, in article blocks if half of the host's contents do, three at least;
* if it is ``COPIED`` tokens long or longer, which a copied article with small changes is as well, only if half of them carry it, three at least.

Names of classes and ids only speak about containers, and only if they consist of frame words and filler (``ad-slot-2``, not ``share-prices``).
A landmark ends the frame of a form, menu or header around it, which may span a page or lack its end tag; ``main`` ends any.  A page of which nothing would be left is read again without regard to names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import anchors
from .shared import written
from .text import chunks, encode_words, hash_words, mix, rows_of, starts_of, window_hashes

LENGTH, GRAM = 8, 4
#: Tokens from which a repeated run may be a copied article.
COPIED = 64
#: Tables of repeats up to this many rows are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Text that one numpy step works on.
STEP_BYTES = 4 << 20

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+|[^<>]*)>|<[!?][^<>]*>|<[/!?a-zA-Z][^<>]*\Z", re.DOTALL
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content is no text of the page; it ends at their own end tag, whatever looks like a tag inside.
_RAW = frozenset("script style noscript template textarea title iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in _RAW}
_FRAME = frozenset("nav footer aside form menu dialog select button object svg math canvas".split())
_MAIN = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that class and id may make a frame; headings, paragraphs and inline elements never are.
_CONTAINER = frozenset("div section ul ol dl header fieldset details figure".split())
_FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_FILLER = frozenset(
    "a area article articles bar block bottom box btn button buttons col container content form group header icons inner item items left link links list main outer page panel post posts "
    "primary reader right row secondary section site slot text thread title top unit user wrap wrapper".split()
)
_FRAME_NAMES = frozenset(["site-header", "site_header"])
#: Words that make a frame outside articles only, where they hold the page's heading; words that make a paragraph or a span one.
_HEAD_WORDS = frozenset("header topbar".split())
_NOTE_WORDS = frozenset("advert adverts advertisement consent cookie cookies gdpr sponsored".split())
#: Elements around a whole page or without an end tag more often than not.
_SOFT = frozenset("form nav header".split())
_SOFT_ROLE = frozenset("form navigation banner".split())
_FRAME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

MAIN, OPEN, FRAME = 0, 1, 2
#: While parsing: a frame that an article ends.
_SOFT_FRAME = 3


def frame_name(value: str, words: frozenset = _FRAME_WORDS) -> bool:
    """Whether one of the names of a class or id attribute consists of frame words, filler and numbers, with one of ``words`` at least."""
    for name in value.lower().split():
        parts = [w for w in re.split(r"[-_]+|\d+", name) if w]
        if name in _FRAME_NAMES and words is _FRAME_WORDS or any(w in words for w in parts) and all(w in words or w in _FRAME_WORDS or w in _FILLER for w in parts):
            return True
    return False


def _kind(tag: str, attributes: str, parent: int, names: bool) -> int:
    """What a new element makes of the text inside it."""
    said = [(name.lower(), html.unescape("".join(values))) for name, *values in _NAMES.findall(attributes)] if attributes and "=" in attributes else []
    roles = {value.lower() for name, value in said if name == "role"}
    landmark = tag in _MAIN or bool(roles & _MAIN)
    if parent == FRAME:
        return MAIN if tag == "main" or "main" in roles else FRAME
    if landmark and parent == _SOFT_FRAME:
        return MAIN
    if tag in _FRAME - _SOFT or roles & (_FRAME_ROLE - _SOFT_ROLE):
        return FRAME
    for name, value in said if names else []:
        if name == "role":
            continue
        if (tag in _CONTAINER or tag == "article" and parent == MAIN) and (frame_name(value) or parent != MAIN and frame_name(value, _HEAD_WORDS)):
            return FRAME
        if tag in ("p", "span") and frame_name(value, _NOTE_WORDS):
            return FRAME
    if tag in ("form", "nav") or (tag == "header" and parent != MAIN) or roles & _SOFT_ROLE:
        return _SOFT_FRAME
    return MAIN if landmark else parent


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order; character references are decoded and white space is one space.

    A ``<`` that starts no tag, or whose tag is not closed before the next ``<``, is text."""
    found = _blocks(page, True)
    if found and all(kind == FRAME for kind, _ in found):
        again = _blocks(page, False)
        found = again if any(kind != FRAME for kind, _ in again) else found
    return found


def _blocks(page: str, names: bool) -> list[tuple[int, str]]:
    out, parts, kinds, tags, at = [], [], [OPEN], [], 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((min(kinds[-1], FRAME), text))

    while m := _TAG.search(page, at):
        closing, tag = m[1], (m[2] or "").lower()
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if tag in _BLOCK:
            close()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag in tags:
                if tag not in _BLOCK and kinds[-1] != kinds[len(tags) - 1 - tags[::-1].index(tag)]:
                    close()
                while tags.pop() != tag:
                    kinds.pop()
                kinds.pop()
        elif tag in _RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag not in _VOID:
            if tag in _BLOCK and tags[-1:] == ["p"]:  # a block ends an open paragraph
                tags.pop()
                kinds.pop()
            kind = _kind(tag, m[3], kinds[-1], names)
            if kind != kinds[-1]:
                close()
            if tag in _BLOCK or kind != kinds[-1]:
                tags.append(tag)
                kinds.append(kind)
    parts.append(page[at:])
    close()
    return out


def _marks(found: list[str], kinds: list[int]) -> np.ndarray:
    """What each place's LENGTH tokens lie in: MAIN if one of them is of the article, else OPEN if one is open, else FRAME."""
    of_token = np.repeat(np.array(kinds, np.int8), [text.count(" ") + 1 for text in found])
    n = max(0, len(of_token) - LENGTH + 1)
    return np.min([of_token[k : k + n] for k in range(LENGTH)], axis=0) if n else np.zeros(0, np.int8)


PARSED = "row long, host long, content long, texts array<string>, kinds array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with a row number, hashes of the host and of the text outside frames, and the blocks."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "html"):
                found = [blocks(page or "") for page in part.column("html").to_pylist()]
                contents = [xxhash.xxh3_64_intdigest("\0".join(text for kind, text in f if kind != FRAME)) - (1 << 63) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), part.column("url"), pa.array(np.arange(row, row + part.num_rows)), part.column("host"), pa.array(contents, pa.int64()),
                        pa.array([[text for _, text in f] for f in found], pa.list_(pa.string())), pa.array([[kind for kind, _ in f] for f in found], pa.list_(pa.int32())),
                    ],
                    names=["page_id", "url", "row", "host", "content", "texts", "kinds"],
                )
                row += part.num_rows

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    picked = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"page_id {kind}, url string, {PARSED}")


def _streams(part: pa.RecordBatch):
    """The suffixes of LENGTH tokens of some pages: their page, place in its stream, mark (see :func:`_marks`), key, and anchor's hash and place."""
    lists = part.column("texts")
    of_block = np.asarray(pc.list_parent_indices(lists), np.int64)
    tokens = pc.split_pattern(lists.flatten().cast(pa.large_string()), " ")
    codes, distinct = encode_words(tokens.flatten())
    empty = np.zeros(0, np.int64)
    if len(codes) < LENGTH:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty
    hashes = hash_words(distinct)[codes]
    sizes = np.asarray(pc.list_value_length(tokens), np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of_block, weights=sizes, minlength=part.num_rows).astype(np.int64))])
    kinds = np.repeat(np.asarray(part.column("kinds").flatten()), sizes)
    windows = window_hashes(hashes, LENGTH)
    best, at = anchors(hashes, LENGTH, GRAM)
    ok = np.flatnonzero(starts_of(bounds, LENGTH)[: len(windows)])
    has = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kinds == kind)])[np.stack([ok, ok + LENGTH])], axis=0)[0] > 0
    mark = np.where(has(MAIN), MAIN, np.where(has(OPEN), OPEN, FRAME))
    page = rows_of(bounds)[ok]
    host = mix(np.asarray(part.column("host"), np.int64).view(np.uint64))[page]
    return page, ok - bounds[page], mark, mix(windows[ok] + host), mix(best[ok] ^ host), at[ok]


def least(contents):
    """Contents of a host that must carry a run of its articles: half of them, three at least."""
    return np.maximum(3, -(-contents // 2))


#: Hosts whose number of contents the tasks know; of the others they only know that a run must occur three times.
LARGEST_HOSTS = 1 << 16


def _large_hosts(hosts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The LARGEST_HOSTS hosts with the most contents, in ascending order, and their needs: four times the binary logarithm of ``least``."""
    rows = hosts.where("contents > 6").orderBy(F.desc("contents"), "host").limit(LARGEST_HOSTS).collect()
    rows = np.array(sorted((r.host, r.contents) for r in rows), np.int64).reshape(-1, 2)
    return rows[:, 0].copy(), np.minimum(63, (4 * np.log2(least(rows[:, 1])) + 1e-9).astype(np.int64)).astype(np.uint8)


_LEAST_NEED = int(4 * np.log2(3))


def _address(fps: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit tail of each anchor."""
    return ((fps >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), fps.astype(np.uint32)


def repeat_filter(pages: DataFrame, hosts: DataFrame) -> tuple[int, int, np.ndarray]:
    """(buckets, bits, table): a bit table that holds the anchors of all suffixes that may be boilerplate, and a few others.

    An anchor may be one if it is found outside frames, and as often as articles of its host need, or twice and in an open block.
    Four bytes of an anchor, its count and its host's need are shuffled, dealt evenly by hash.  The table has at most 64 MB;
    at more anchors it lets more others pass, which are told apart later."""
    total = pages.select(F.sum(F.expr("aggregate(texts, 0L, (n, t) -> n + length(t) - length(replace(t, ' ', '')) + 1)"))).first()[0] or 0
    buckets = min(2048, max(1, total >> 17))
    bits = min(18, max(10, (total // buckets).bit_length() - 1))
    large = pages.sparkSession.sparkContext.broadcast(_large_hosts(hosts))

    def emit(batches):
        def packed(held):
            keys, facts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, facts = keys[order], facts[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            n = np.minimum(np.diff(np.append(first, len(keys))), 65535).astype("<u2")
            keys, facts = keys[first], np.bitwise_or.reduceat(facts, first)  # a key has one host, so one need
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            columns = [[x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for x in (keys.astype("<u4"), n, facts)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "tails", "n", "facts"])

        known, needs = large.value
        held, n = [], 0
        for batch in batches:
            for part in _steps(batch):
                page, _, mark, _, fps, at = _streams(part)
                if not len(at):
                    continue
                host = np.asarray(part.column("host"), np.int64)
                place = np.minimum(np.searchsorted(known, host), max(0, len(known) - 1))
                need = np.where(known[place] == host, needs[place], _LEAST_NEED) if len(known) else np.full(len(host), _LEAST_NEED)
                first = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(page, prepend=-1))  # windows that share an anchor follow each other
                bucket, tail = _address(fps[first], buckets)
                found = np.bitwise_or.reduceat(np.array([64, 128, 0], np.uint8)[mark], first)
                held.append((bucket.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64), need[page[first]].astype(np.uint8) | found))
                n += len(first)
                if n > 4_000_000:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def reduce(table: pa.Table) -> pa.Table:
        tails, n, facts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("tails", "<u4"), ("n", "<u2"), ("facts", np.uint8)))
        order = np.argsort(tails, kind="stable")
        first = np.flatnonzero(np.diff(tails[order].astype(np.int64), prepend=-1))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        facts = facts[order]
        need, found = np.minimum.reduceat(facts & 63, first), np.bitwise_or.reduceat(facts & 192, first)
        pick = ((found > 0) & (n >= np.floor(2 ** (need / 4) + 1e-9))) | ((found & 128 > 0) & (n > 1))
        on = np.zeros(1 << bits, np.uint8)
        on[tails[order][first][pick] & np.uint32((1 << bits) - 1)] = 1
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    dealt = pages.select("host", "texts", "kinds").mapInArrow(emit, "bucket int, tails binary, n binary, facts binary")
    out = np.zeros((buckets, 1 << (bits - 3)), np.uint8)
    for r in dealt.groupBy("bucket").applyInArrow(reduce, "bucket int, bits binary").toLocalIterator():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return buckets, bits, out.ravel()


def _steps(batch: pa.RecordBatch):
    """Slices of a batch of parsed pages of about STEP_BYTES of text each; a longer page is one of its own."""
    sizes = pc.binary_length(batch.column("texts").flatten())
    by_page = np.bincount(np.asarray(pc.list_parent_indices(batch.column("texts")), np.int64), weights=np.asarray(sizes), minlength=batch.num_rows)
    step = (np.cumsum(by_page) // STEP_BYTES).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        part = batch.slice(i, j - i)
        yield pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(len(c)))) if pa.types.is_list(c.type) else c for c in part.columns], names=part.schema.names)


def _passing(part: pa.RecordBatch, buckets: int, bits: int, table: np.ndarray):
    """Page, place, mark, and key of the suffixes whose anchor the table holds."""
    page, place, mark, keys, fps, _ = _streams(part)
    bucket, tail = _address(fps, buckets)
    slot = (bucket << bits) + (tail & np.uint32((1 << bits) - 1))
    on = (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
    return page[on], place[on], mark[on], keys[on].view(np.int64)


def repeated_suffixes(pages: DataFrame, hosts: DataFrame, known) -> DataFrame:
    """(key, host, n, contents): the suffixes that ``n`` of the host's contents carry, enough to be boilerplate in a block where they occur."""

    def run(batches):
        for batch in batches:
            for part in _steps(batch):
                page, _, mark, keys = _passing(part, *known.value)
                found = np.array([1, 2, 0])[mark]
                content = np.asarray(part.column("content"), np.int64)[page]
                order = np.lexsort((content, keys))
                first = np.flatnonzero(np.diff(keys[order], prepend=0) | np.diff(content[order], prepend=0) | (np.arange(len(order)) == 0))
                at = order[first]
                found = np.bitwise_or.reduceat(found[order], first) if len(first) else found
                host = np.asarray(part.column("host"), np.int64)[page[at]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(host), pa.array(content[at]), pa.array(found, pa.int32())], names=["key", "host", "content", "found"])

    entries = pages.select("host", "content", "texts", "kinds").mapInArrow(run, "key long, host long, content long, found int")
    once = entries.groupBy("key", "host", "content").agg(F.bit_or("found").alias("found"))
    counted = once.groupBy("key", "host").agg(F.count("*").cast("int").alias("n"), F.bit_or("found").alias("found")).where("n > 1 and found > 0")
    enough = F.greatest(F.lit(3), F.ceil(F.col("contents") / 2))
    return counted.join(hosts, "host").where((F.col("n") >= enough) | (F.col("found") >= 2)).select("key", "host", "n", "contents")


def places(pages: DataFrame, known) -> DataFrame:
    """(row, key, at) of the suffixes outside frames whose anchor the table holds."""

    def run(batches):
        for batch in batches:
            for part in _steps(batch):
                page, place, mark, keys = _passing(part, *known.value)
                row = np.asarray(part.column("row"), np.int64)[page]
                yield pa.RecordBatch.from_arrays([pa.array(x[mark != FRAME]) for x in (row, keys, place.astype(np.int32))], names=["row", "key", "at"])

    return pages.select("row", "host", "texts", "kinds").mapInArrow(run, "row long, key long, at int")


def boilerplate(marks: np.ndarray, carriers: dict[int, int], contents: int) -> list[int]:
    """The places whose tokens go: ``carriers`` has the number of contents at each repeated place of a page, ``contents`` that of the host."""
    common = least(contents)
    enough = {OPEN: 2, MAIN: common}
    out, run = [], []
    for i in [*sorted(i for i, n in carriers.items() if n >= enough[int(marks[i])]), None]:
        if run and (i is None or i > run[-1] + 1):
            out += [k for k in run if len(run) + LENGTH - 1 < COPIED or carriers[k] >= common]
            run = []
        run.append(i)
    return out


def unique_runs(found: list[str], kinds: list[int], places: list[int]) -> list[str]:
    """The blocks outside frames without the tokens of the places; empty ones are left out."""
    out, at = [], 0
    gone = {i + k for i in places for k in range(LENGTH)}
    for text, kind in zip(found, kinds, strict=True):
        tokens = text.split(" ")
        kept = [t for k, t in enumerate(tokens) if at + k not in gone]
        at += len(tokens)
        if kept and kind != FRAME:
            out.append(" ".join(kept))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks are joined by two newlines.  A null or empty page has an empty text; markup that is cut
    off at the end is dropped, text before it stays.  A null url belongs to the host ''.  Repeated rows, and pages of a host with
    equal text outside frames, don't make each other boilerplate."""
    pages = written(parsed(pages), "pages", compression="zstd")
    hosts = written(pages.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents")), "hosts")
    known = pages.sparkSession.sparkContext.broadcast(repeat_filter(pages, hosts))
    repeated = written(repeated_suffixes(pages, hosts, known).select("key", "n", "contents"), "repeats")
    found = places(pages, known).join(_small(repeated), "key").groupBy("row").agg(F.first("contents").alias("contents"), F.collect_list(F.struct("at", "n")).alias("places"))
    covered = written(found, "places")

    def run(batches):
        for batch in batches:
            texts = [
                "\n\n".join(unique_runs(found, kinds, boilerplate(_marks(found, kinds), {p["at"]: p["n"] for p in places}, contents) if places else []))
                for found, kinds, places, contents in zip(*(batch.column(c).to_pylist() for c in ("texts", "kinds", "places", "contents")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = pages.join(_small(covered), "row", "left").select("page_id", "url", "texts", "kinds", "places", "contents")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
