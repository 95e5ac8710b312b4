"""Main text of web pages: a host suffix array proposes the boilerplate among all blocks of text, the markup checks what it proposes.

A page becomes blocks of text in page order; scripts, styles and other elements without text have none. All of them, menus and
articles alike, go through the host suffix array: the blocks of a page make one token stream, and the pages of a host are one text.
Its suffixes are dealt by (host, first RUN tokens) instead of being sorted in one place, so that equal beginnings meet, and a suffix
whose beginning at least SHARE percent of the host's pages have (two at least) is part of a repeated substring of at least RUN tokens.
Blocks of which repeated substrings cover at least COVERED percent are proposed as boilerplate, all others as text.

Hardly any suffix is repeated, so two passes find which have to be dealt. The first counts, for each page, the smallest hash among
the runs of GRAM tokens in each RUN tokens: equal beginnings have equal ones, on as many pages. The counts go into a sketch of fixed
size, in which a count can only be too high. The second deals the suffixes whose smallest hash may be on enough pages; they are
counted exactly. So no repeated substring is lost, and a sketch that is too small for a corpus costs shuffle, not results.

The check behind it: repeats alone would give wrong results, as passages of articles recur on pages of one host and have to stay,
and menus may differ from page to page. So each proposal is held against the markup, which overrules it both ways:

* menus, headers, footers, sidebars, forms, adverts, notices and comment sections (by tag, role, class or id) go;
* what is inside an article or main element stays, where there is one, and the page's other blocks go;
* everywhere else the markup says nothing, and the proposal stands. Pages without such an element stand by it throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import materialize
from evidencelake.llm.hashing import Powers, Slice, mix, odd, slices

#: Tokens of the shortest repeated substring that counts as boilerplate.
RUN = 12
#: Percent of a host's pages that have it, and percent of a block's tokens that such substrings cover.
SHARE, COVERED = 10, 80
#: Tokens of the runs of which a suffix has a smallest hash.
GRAM = 6
#: The sketch has 2^SKETCH_BITS counters, which move in chunks of 2^CHUNK_BITS.
SKETCH_BITS, CHUNK_BITS = 20, 12
_PLACE = odd(RUN, 401)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROP = frozenset("head script style noscript template nav header footer aside form menu dialog iframe svg object button select textarea input title".split())
NO_TEXT = frozenset("head script style noscript template iframe svg object".split())
KEEP = frozenset(("article", "main"))
DROP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_NAMES = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widgets?)(?:$|[-_ ])", re.I)
#: Of these, the ones that inside an article belong to it: its own headline block.
_OWN = re.compile(r"(?:^|[-_ ])(?:header|masthead|banner)(?:$|[-_ ])", re.I)
#: An opening tag of the key closes an open one of the values, as browsers do.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
NO_BLOCK, DROPPED, OPEN, KEPT = -1, 0, 1, 2
_WHITE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    def __init__(self, structure: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.structure = structure
        self.stack: list[tuple[str, int]] = []  # tag, state
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.beside: list[str] = []  # what is dropped inside a block, such as a link to share it
        self.state = self.told = OPEN

    def flush(self) -> None:
        for state, parts in ((self.told, self.parts), (DROPPED, self.beside)):
            if parts:
                text = _WHITE.sub(" ", "".join(parts)).strip()
                if text:
                    self.blocks.append((state, text))
        self.parts, self.beside = [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in BLOCK:
            self.flush()
            if tag != "p" or self.stack:
                self.close_implied(tag)
        if tag in VOID:
            return
        state = self.state
        if tag in NO_TEXT:
            state = NO_BLOCK
        elif self.structure and state in (OPEN, KEPT):
            a = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
            inside = state == KEPT
            if tag in DROP and not (inside and tag == "header") or a.get("role", "").lower() in DROP_ROLE or "hidden" in a or a.get("aria-hidden") == "true" or self.named(tag, a, inside):
                state = DROPPED
            elif tag in KEEP or a.get("role", "").lower() == "main":
                state = KEPT
        self.stack.append((tag, state))
        self.state = state

    @staticmethod
    def named(tag: str, attrs: dict[str, str], inside: bool) -> bool:
        """Whether class or id says that this isn't the article's text."""
        if tag in ("html", "body", "article", "main"):
            tokens = [t for t in attrs.get("class", "").split() if tag == "article" and t.lower() in ("comment", "teaser", "promo", "ad", "advert")]
            return bool(tokens)
        names = [*attrs.get("class", "").split(), attrs.get("id", "")]
        return any(_NAMES.search(_OWN.sub(" ", n) if inside else n) for n in names)

    def close_implied(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0]
            if t == "p" or t in CLOSES.get(tag, ()):
                del self.stack[i:]
                break
            if t in BLOCK:
                break
        self.state = self.stack[-1][1] if self.stack else OPEN

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                break
        self.state = self.stack[-1][1] if self.stack else OPEN

    def handle_data(self, data: str) -> None:
        if self.state == DROPPED:
            self.beside.append(data)
        elif self.state != NO_BLOCK:
            self.parts.append(data)
            if not data.isspace():
                self.told = self.state


def page_blocks(html: str, structure: bool = True) -> list[tuple[int, str]]:
    """(state, text) of all blocks of text, in page order; the state is what the markup says of it. Without structure it says nothing: all are open."""
    p = _Blocks(structure)
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


def checked(states: list[int], repeated: list[bool]) -> list[bool]:
    """Which blocks stay: the proposal of the suffix array, overruled where the markup says something."""
    article = KEPT in states
    return [s == KEPT or s == OPEN and not article and not r for s, r in zip(states, repeated, strict=True)]


def _parse(structure: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each page's blocks, a line each with the state in front."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                lines = ["\n".join(f"{s}{t}" for s, t in page_blocks(html, structure)) if html else "" for html in part.column("html").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in ("id", "row", "page_id", "url", "host")), pa.array(lines, pa.string())], ["id", "row", "page_id", "url", "host", "lines"])

    return rows


def _blocks(lines: str) -> tuple[list[int], list[str]]:
    """The states and the texts of a page's blocks."""
    found = lines.split("\n") if lines else []
    return [int(x[0]) for x in found], [x[1:] for x in found]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines compressed, as they are about to move."""
    codec = pa.Codec("zstd", compression_level=6)
    for batch in batches:
        raw = [x.encode() for x in batch.column("lines").to_pylist()]
        yield pa.record_batch([*(batch.column(c) for c in ("row", "page_id", "url")), pa.array(list(map(len, raw)), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], ["row", "page_id", "url", "size", "packed"])


def _suffixes(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of the pages in a slice: its page, its first token, hashes of its first RUN tokens and the smallest of their runs of GRAM. A page of fewer tokens is one suffix."""
    counts = np.diff(s.bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(s.word) - RUN + 1)
    at = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
    grams = np.zeros(max(0, len(s.word) - GRAM + 1), np.uint64)
    for k in range(GRAM if len(grams) else 0):
        grams += s.word[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams)
    whole, least = np.zeros(n, np.uint64), grams[:n].copy()
    for k in range(RUN if n else 0):
        whole += s.word[k : k + n] * _PLACE[k]
        if 0 < k <= RUN - GRAM:
            np.minimum(least, grams[k : k + n], out=least)
    short = np.flatnonzero((counts > 0) & (counts < RUN))
    alone = counts[short].astype(np.uint64)
    for k in range(RUN - 1):
        longer = counts[short] > k
        alone[longer] += s.word[s.bounds[short[longer]] + k] * _PLACE[k]
    alone = mix(alone)
    return np.concatenate((owner[at], short)), np.concatenate((at, s.bounds[short])), np.concatenate((mix(whole[at]), alone)), np.concatenate((least[at], alone))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Suffixes of pages (site, lines): their row in the batch, first token in the page, and the two hashes, told apart by host."""
    powers = Powers()
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch, first = whole.slice(i, 500), 0
            site = mix(batch.column("site").to_numpy().astype(np.int64).view(np.uint64))
            for s in slices(pa.array(["\n".join(_blocks(x)[1]) for x in batch.column("lines").to_pylist()], pa.large_string()), powers):
                page, at, key, least = _suffixes(s)
                at = at - s.bounds[page]
                page = page + first
                first += len(s.bounds) - 1
                yield batch, page, at, mix(key + site[page]), mix(least + site[page])


def _firsts(page: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of each hash's first occurrence in its page."""
    return np.unique(h ^ mix(page.astype(np.uint64) + np.uint64(1)), return_index=True)[1]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_CHUNKS = "chunk int, counts binary"


def _chunks(counts: np.ndarray) -> pa.RecordBatch:
    parts = counts.reshape(-1, 1 << CHUNK_BITS)
    some = np.flatnonzero(parts.any(1))
    return pa.record_batch([pa.array(some, pa.int32()), pa.array([pa.compress(parts[c].tobytes(), codec="zstd", asbytes=True) for c in some], pa.binary())], ["chunk", "counts"])


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts, 8 << CHUNK_BITS, codec="zstd", asbytes=True), np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of a task: per slot, on how many pages its smallest hashes are."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, page, _, _, least in _dealt(batches):
        counts += np.bincount(_slots(least[_firsts(page, least)]), minlength=len(counts))
    yield _chunks(counts)


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            total += _unpacked(counts)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["chunk", "counts"])


def _sketch(pages: DataFrame) -> np.ndarray:
    """Counters of all pages: 2^SKETCH_BITS of them, whatever the number of pages."""
    found = pages.select("site", "lines").mapInArrow(_count, _CHUNKS).groupBy("chunk").applyInArrow(_sum, _CHUNKS).toArrow()
    counts = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for chunk, packed in zip(found.column("chunk").to_pylist(), found.column("counts").to_pylist(), strict=True):
        counts[chunk] = _unpacked(packed)
    return np.minimum(counts.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


_SUFFIX = "row long, at int, suffix long, first int, least long"


def _likely(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The suffixes that may be on enough pages of their host. first: 1 at a beginning's first place in the page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, page, at, key, smallest in _dealt(batches):
            least = batch.column("least").to_numpy()
            on = np.flatnonzero(counts[_slots(smallest)] >= least[page])
            page, at, key = page[on], at[on], key[on]
            first = np.zeros(len(on), np.int32)
            first[_firsts(page, key)] = 1
            yield pa.record_batch([pa.array(batch.column("row").to_numpy()[page]), pa.array(at, pa.int32()), pa.array(key.view(np.int64)), pa.array(first), pa.array(least[page])], ["row", "at", "suffix", "first", "least"])

    return rows


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks that stay. Counted: its blocks, those proposed as boilerplate, and those where the check overruled the proposal."""
    for batch in batches:
        texts, n_blocks, n_repeated, n_overruled = [], [], [], []
        for size, packed, places in zip(*(batch.column(c).to_pylist() for c in ("size", "packed", "repeated")), strict=True):
            states, blocks = _blocks(pa.decompress(packed, size, codec="zstd", asbytes=True).decode() if size else "")
            repeated = _covered(blocks, places) if places else [False] * len(blocks)
            stays = checked(states, repeated)
            texts.append("\n".join(b for b, keep in zip(blocks, stays, strict=True) if keep))
            n_blocks.append(len(blocks))
            n_repeated.append(sum(repeated))
            n_overruled.append(sum(keep == r for keep, r in zip(stays, repeated, strict=True)))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(n, pa.int64()) for n in (n_blocks, n_repeated, n_overruled))], ["page_id", "url", "text", "n_blocks", "n_repeated", "n_overruled"])


def _covered(blocks: list[str], places: list[int]) -> list[bool]:
    """Whether repeated substrings, RUN tokens from each place on, cover most of a block."""
    ends = np.cumsum([0, *(len(b.split()) for b in blocks)])
    covered = np.zeros(int(ends[-1]) + RUN, np.int64)
    for k in range(RUN):
        covered[np.array(places) + k] = 1
    sums = np.concatenate(([0], np.cumsum(covered)))[ends]
    return (100 * np.diff(sums) >= COVERED * np.diff(ends)).tolist()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, structure: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_repeated, n_overruled for every row of pages (page_id, url, html). Without structure, nothing checks the proposals.

    n_blocks: blocks of text; n_repeated: those that the suffix array proposes as boilerplate; n_overruled: those where the markup
    overrules it, either way. Null and empty html gives an empty text. Broken markup is read as a browser would, roughly; nothing fails. Null urls are
    one host. Rows that repeat a page_id or url are pages of their own, told apart by a hash of their content; the same
    page twice isn't a repeat between distinct pages. An empty table gives an empty result.
    """
    source = pages.select(F.monotonically_increasing_id().alias("id"), F.xxhash64("url", "html").alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    parsed = materialize(source.mapInArrow(_parse(structure), "id long, row long, page_id long, url string, host string, lines string"), "blocks", compression="zstd")
    repeats = parsed.groupBy("row").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(parsed.select("row", "id").join(repeats, "row").where("id <> kept").select("id"), "copies")
    hosts = materialize(parsed.groupBy("host").agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("row") * SHARE / 100)).cast("long").alias("least")), "hosts")
    streams = parsed.where("lines <> ''").join(copies, "id", "left_anti").join(hosts, "host").select("row", F.xxhash64("host").alias("site"), "least", "lines")
    suffixes = materialize(streams.mapInArrow(_likely(_sketch(streams)), _SUFFIX), "suffixes")
    shared = suffixes.groupBy("suffix").agg(F.sum("first").alias("pages"), F.max("least").alias("least")).where("pages >= least").select("suffix")
    repeated = suffixes.join(shared, "suffix", "left_semi").groupBy("row").agg(F.collect_list("at").alias("repeated"))
    packed = parsed.select("row", "page_id", "url", "lines").mapInArrow(_pack, "row long, page_id long, url string, size long, packed binary")
    found = packed.join(repeated, "row", "left").select("page_id", "url", "size", "packed", "repeated").mapInArrow(_decided, "page_id long, url string, text string, n_blocks long, n_repeated long, n_overruled long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_repeated", "n_overruled")
