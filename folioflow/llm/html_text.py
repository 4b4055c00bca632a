"""Main text of HTML pages: mark-up cuts pages into blocks, and a suffix array over each host's pages finds boilerplate.

Blocks inside an article or main element are the page's text; navigation, headers, footers, forms, scripts, notices,
adverts, sidebars and comments never are. On pages without such an element all other blocks are open. The token streams
of all pages of a host are concatenated (a block's end counts as a token), their suffixes are sorted by prefix doubling
and the lengths of common prefixes taken between neighbours. A substring of RUN tokens or more on PAGES distinct pages or
more is boilerplate: on open pages all tokens that such substrings cover go, what is unique stays. Inside an article, a
block goes only if it is such a substring as a whole and stands on more than half of the host's pages, as what a template
puts on every page does (a notice in a bare paragraph); all else inside an article is its own words, as a line or a
quotation that other pages hold as well is still text.

Pages are distinct by their blocks: copies within a host count once. Near copies differ by less than 1 - NEARLY of a page:
if that much of a page stands on m pages or more, these count as one page for it, so that no page loses its text to its
copies. Pages without a host have no site to share boilerplate with and keep all their blocks.

A host's pages are cut into shards of about SHARD_BYTES of html by their content, so that a host with a third of all pages
isn't one task. The suffix array of a shard says which units of its pages (blocks, or runs of RUN tokens) are alike and how
many of its pages hold them; over the shards of a larger host these numbers are added by the units' names, so that shards
change no result. Texts are shuffled by shard once, compressed and without copies of a task. What comes back is which
pages hold which boilerplate. A bitmap of bounded size tells the pages that may hold some; only these are shuffled
again to be cut, all others are done where they are read.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import _P, U, Words, distinct, mix, powers, text_slices
from .shared import written
from .url_filter import host_and_path

RUN = 8
PAGES = 3
#: Of a host's pages that a block inside an article must stand on, and more, to be its template's.
TEMPLATE = 0.5
SHARD_BYTES = 2 << 20
#: Of a page that its near copies share.
NEARLY = 0.8
#: Bits of the bitmap for each page with boilerplate, and at most. With fewer bits more pages are shuffled, none is judged otherwise.
BITS_EACH, MOST_BITS = 16, 1 << 28
_WORD = re.compile("[^\x20\x09-\x0d]+")

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "button", "object", "video", "audio", "canvas"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
#: Elements of text: a compound name such as related-work or share-prices says what it is about, not what it is for.
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "figcaption", "caption", "article", "main"}
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Words of class, id and role that name what isn't main text.
_UNWANTED = set("ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu sidebar header masthead footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe signup related share sharing social comment comments disqus respond replies widget pagination contentinfo complementary search".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
_STOP = re.compile(r">|=\s*([\"'])")
_LOWER = {i: i + 32 for i in range(65, 91)}


def _lowered(page: str) -> str:
    """page with A-Z in lower case, every character at its place."""
    low = page.lower()
    return low if len(low) == len(page) else page.translate(_LOWER)


def _unwanted(name: str, attributes: str) -> bool:
    """Whether class, id or role name the element as something other than text: as a whole, or, for classes of elements that
    hold others, by a part of the name (sidebar-left, but not has-sidebar)."""
    for kind, *value in _NAMES.findall(attributes):
        for token in "".join(value).lower().split():
            if token in _UNWANTED or re.sub("[^a-z0-9]", "", token) in _UNWANTED:
                return True
            if kind.lower() == "class" and name not in _TEXTUAL:
                parts = re.split("[^a-z0-9]+", token)
                if parts[0] not in ("has", "with", "no", "without", "is") and any(p in _UNWANTED for p in parts):
                    return True
    return False


class Tags:
    """The tags of a page one by one, in time linear in its length: (start, end, closing, name, attributes), name empty for
    comments and declarations. What looks like a tag but never ends is text."""

    def __init__(self, page: str) -> None:
        self.page, self.low = page, _lowered(page)
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while m := _TAG.search(page, at):
            start, at = m.span()
            if m[0] == "<!--":
                end = page.find("-->", at)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if at > self.last[">"]:
                return None
            if m[2] is None:
                return start, page.find(">", at) + 1, False, "", ""
            inside = at
            while s := _STOP.search(page, inside):
                inside = s.end()
                if s[0] == ">":
                    return start, inside, bool(m[1]), m[2].lower(), page[at : inside - 1]
                if inside <= self.last[s[1]]:
                    inside = page.find(s[1], inside) + 1
            # a quoted value held the last '>': nothing after it ends either
            return None
        return None

    def after(self, name: str, at: int) -> int:
        """The end of the closing tag of a raw text element, or of the page."""
        while (at := self.low.find(f"</{name}", at)) >= 0:
            at += len(name) + 2
            if self.low[at : at + 1] in (">", "/", "", *" \t\n\r\f"):
                end = self.low.find(">", at)
                return len(self.page) if end < 0 else end + 1
        return len(self.page)


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks of a page in order, white space collapsed and references decoded, and whether they are open (no article
    or main element holds text) instead of marked as the article."""
    page = page or ""
    marked: list[str] = []
    opened: list[str] = []
    held: list[str] = []
    depth = {"article": 0, "main": 0}
    skip, nested, at = "", 0, 0
    tags = Tags(page)

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            (marked if depth["article"] or depth["main"] else opened).append(text)

    n = 0
    while tag := tags.next(n):
        start, end, closing, name, attributes = tag
        if not skip and start > at:
            held.append(html.unescape(page[at:start]))
        at = n = end
        if not name:
            continue
        if not closing and name in _RAW and not attributes.endswith("/"):
            at = n = tags.after(name, n)
            continue
        if skip:
            if name == skip:
                nested += -1 if closing else 1
                if nested <= 0:
                    skip = ""
            elif skip == "p" and name not in _INLINE or name in ("article", "main") and not closing and skip == "header":
                skip = ""  # ended by what can't stand inside
            if skip or closing:
                continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            if not closing and name not in _VOID and _unwanted(name, attributes):
                skip, nested = name, 1
            continue
        flush()
        if name in depth:
            if closing:
                depth[name] = max(0, depth[name] - 1)
                continue
            if not _unwanted(name, attributes):
                depth[name] += 1
                continue
        if not closing and name not in _VOID and name not in ("html", "body", "head") and (name in _CHROME and not (name == "header" and depth["article"]) or _unwanted(name, attributes)):
            skip, nested = name, 1
    if not skip and at < len(page):
        held.append(html.unescape(page[at:]))
    flush()
    return (marked, False) if marked else (opened, True)


# ---- the suffix array


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of tokens (their last is unique) in order, and the rank of every suffix by its first 1, 2, 4, ... tokens.

    Prefix doubling; a rank is the place of the first suffix that shares the prefix, and only what isn't told apart yet is
    sorted on."""
    n = len(tokens)
    sa = np.argsort(tokens, kind="stable")
    new = np.concatenate([[True], tokens[sa[1:]] != tokens[sa[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa, levels
        s = sa[at]
        after = np.where(s + width < n, rank[np.minimum(s + width, n - 1)], -1)
        order = np.argsort(rank[s].astype(np.int64) * (n + 1) + after, kind="stable")
        s, after, low = s[order], after[order], rank[s][order]
        sa[at] = s
        first = np.concatenate([[True], (low[1:] != low[:-1]) | (after[1:] != after[:-1])])
        new[at] = first
        rank = rank.copy()
        rank[s] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Of each suffix and the one before it in order, the length of their common prefix, or 0 if it is below `least`."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    base = least.bit_length() - 1
    if len(levels) <= base or n < 2:
        return out
    at = np.flatnonzero(levels[base][sa[1:]] == levels[base][sa[:-1]]) + 1
    a, b, long = sa[at - 1].copy(), sa[at].copy(), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # suffixes that reach the end differ at the unique last token
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        a[same] += 1 << k
        b[same] += 1 << k
        long[same] += 1 << k
    out[at] = np.where(long >= least, long, 0)
    return out


class Stream:
    """The concatenated tokens of the distinct pages of a shard: words, one token for a block's end, one for each page's."""

    def __init__(self, pages: list[list[str]]) -> None:
        words = Words(pa.array([b for p in pages for b in p], pa.string()))
        per_page = np.array([len(p) for p in pages], np.int64)
        page_of_block = np.repeat(np.arange(len(pages)), per_page)
        self.block_words = words.count.astype(np.int64)
        # a block takes its words and one place more; a page one more after its blocks
        size = self.block_words + 1
        self.block_at = np.cumsum(size) - size + page_of_block
        total = int(size.sum()) + len(pages)
        self.hash = np.zeros(total, U)
        self.tokens = np.zeros(total, np.int64)
        kinds, kind = np.unique(words.hash, return_inverse=True)
        at = self.block_at[words.doc] + np.arange(len(words.hash)) - (np.cumsum(words.count) - words.count)[words.doc]
        self.tokens[at], self.hash[at] = kind + 1, words.hash
        self.word_at, self.block_of_word = at, words.doc
        self.hash[self.block_at + self.block_words] = U(1)
        self.page_of_block = page_of_block
        self.page_end = np.bincount(page_of_block, size, len(pages)).astype(np.int64).cumsum() + np.arange(len(pages))
        self.tokens[self.page_end] = len(kinds) + 1 + np.arange(len(pages))
        self.page = np.repeat(np.arange(len(pages)), np.diff(np.concatenate([[-1], self.page_end])))
        self.block_cut = np.concatenate([[0], np.cumsum(per_page)])

    def units(self, opened: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each page, the places of its units (blocks of RUN words or more, or of an open page every token from which RUN
        follow on the page) and their groups of equal ones, and of each group the number of distinct pages, by the suffix array."""
        sa, levels = suffix_array(self.tokens)
        common = common_prefixes(sa, levels, RUN)
        is_open = np.array(opened, bool)
        begin = np.concatenate([[0], self.page_end[:-1] + 1])
        # runs: neighbours that share RUN tokens
        run = np.empty(len(sa), np.int64)
        run[sa] = np.cumsum(common == 0)
        at = np.arange(len(sa))
        at = at[is_open[self.page] & (self.page_end[self.page] - at >= RUN)]
        # whole blocks: neighbours among the suffixes of blocks that share all words and the end
        long = np.flatnonzero((self.block_words >= RUN) & ~is_open[self.page_of_block])
        where = levels[-1][self.block_at[long]]
        order = np.argsort(where)
        sorted_, where = long[order], where[order]
        least = np.minimum.reduceat(common, np.stack([where[:-1] + 1, where[1:] + 1], 1).reshape(-1))[::2] if len(long) > 1 else np.zeros(0, np.int64)
        block = np.zeros(len(self.block_words), np.int64)
        block[sorted_] = len(sa) + 1 + np.concatenate([[0], np.cumsum(least <= self.block_words[sorted_[:-1]])])[: len(sorted_)]
        page = np.concatenate([self.page[at], self.page_of_block[long]])
        place = np.concatenate([at - begin[self.page[at]], long - self.block_cut[self.page_of_block[long]]])
        _, group = np.unique(np.concatenate([run[at], block[long]]), return_inverse=True)
        one, _ = distinct(group, page)
        order = np.lexsort((place, page))
        cut = np.cumsum(np.bincount(page, minlength=len(opened)))[:-1]
        return np.split(place[order], cut), np.split(group[order], cut), np.bincount(one)

    def names(self, opened: list[bool], places: list[np.ndarray]) -> list[np.ndarray]:
        """Names of units, equal in all streams for equal ones: hashes of the words of a block, or of RUN tokens."""
        hashed = np.zeros(len(self.block_words), U)
        np.add.at(hashed, self.block_of_word, mix(self.hash[self.word_at]) * powers(_P, int(self.block_words.max(initial=1)) + 1)[self.word_at - self.block_at[self.block_of_word]])
        whole = mix(hashed, 1).view(np.int64)
        n = len(self.hash)
        run = np.zeros(n, U)
        for j in range(RUN):
            run[: max(0, n - RUN)] = mix(run[: max(0, n - RUN)]) + self.hash[j : max(j, n - RUN + j)]
        run = mix(run, 2).view(np.int64)
        begin = np.concatenate([[0], self.page_end[:-1] + 1])
        return [run[begin[i] + p] if o else whole[self.block_cut[i] + p] for i, (o, p) in enumerate(zip(opened, places))]


def _repeated(weights: list[int], pages: dict[int, int]) -> list[int]:
    """Units that are boilerplate, from the weights of all and the numbers of pages of those on PAGES or more; other units
    count as the page's own. Pages that share NEARLY all of it count as one."""
    left, copies = (1 - NEARLY) * sum(weights), 1
    for count, weight in sorted((pages.get(i, 1), w) for i, w in enumerate(weights)):
        copies, left = count, left - weight
        if left < 0:
            break
    return [i for i, count in pages.items() if count - copies + 1 >= PAGES]


def _cut(blocks: list[str], opened: bool, pages: dict[int, int]) -> str:
    if not pages:
        return "\n".join(blocks)
    words = [_WORD.findall(b) for b in blocks]
    if not opened:
        gone = set(_repeated([len(w) for w in words], pages))
        return "\n".join(b for i, b in enumerate(blocks) if i not in gone)
    n = sum(len(w) + 1 for w in words)
    covered = {i + j for i in _repeated([1] * (n - RUN + 1), pages) for j in range(RUN)}
    kept, p = [], 0
    for block, mine in zip(blocks, words):
        hit = any(i in covered for i in range(p, p + len(mine)))
        text = " ".join(w for i, w in enumerate(mine, p) if i not in covered) if hit else block
        p += len(mine) + 1
        if text:
            kept.append(text)
    return "\n".join(kept)


def _judge(mine: pa.Table) -> pa.Table:
    """host, shards, shard, page_keys and open of contents of a shard, with units: places, groups' names (0 for a host of one
    shard, which needs none) and numbers of pages in this shard. Of a host of one shard, what is boilerplate by its number
    of pages; of others, every content and unit."""
    rows = mine.to_pylist()
    contents: dict[bytes, dict] = {}
    keys: dict[bytes, dict[bytes, None]] = {}
    for r in rows:
        contents.setdefault(r["content"], r)
        keys.setdefault(r["content"], {})[r["page_key"]] = None
    order = [c for c, r in contents.items() if r["text"] is not None]
    columns: list[list] = [[], [], [], [], []]
    if order:
        pages = [_unpacked(contents[c]["text"]) for c in order]
        opened = [contents[c]["open"] for c in order]
        stream = Stream(pages)
        places, groups, many = stream.units(opened)
        alone = rows[0]["shards"] == 1
        names = [np.zeros(len(g), np.int64) for g in groups] if alone else stream.names(opened, places)
        for c, o, p, g, name in zip(order, opened, places, groups, names):
            some = many[g] >= (PAGES if o else max(PAGES, int(TEMPLATE * len(order)) + 1)) if alone else np.ones(len(g), bool)
            if some.any() or not alone:
                for column, value in zip(columns, (list(keys[c]), o, p[some], name[some], many[g[some]])):
                    column.append(value)
    kinds = (pa.list_(pa.binary()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    head = [pa.array([rows[0][c]] * len(columns[0]), k) for c, k in (("host", pa.string()), ("shards", pa.int64()), ("shard", pa.int64()))]
    return pa.Table.from_arrays([*head, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["host", "shards", "shard", "page_keys", "open", "pos", "name", "pages"])


# ---- on Spark


def _host(url: Column) -> Column:
    """The host, of an url without a scheme too."""
    bare = F.lower(F.regexp_extract(url, r"^(?://)?((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?::[0-9]+)?(?:[/?#]|$)", 1))
    host = host_and_path(url)[0]
    return F.coalesce(F.when(host != "", host).otherwise(bare), F.lit(""))


def _packed(found: list[str]) -> bytes | None:
    """Blocks, none of which holds a line end, compressed; null for none."""
    if not found:
        return None
    data = "\n".join(found).encode("utf-8", "surrogatepass")
    return pa.compress(data, "zstd", asbytes=True) + struct.pack("<I", len(data))


def _unpacked(packed: bytes) -> list[str]:
    return pa.decompress(packed[:-4], struct.unpack("<I", packed[-4:])[0], "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")


def _parsed(pages: pa.Array) -> Iterator[tuple[list[str], bool]]:
    return (blocks(page) for page in pages.to_pylist())


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shards, page_key, html -> host, shards, shard, page_key, content, open, text; one of equal pages of a task."""
    seen: set[tuple[str, bytes]] = set()
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary())
    for batch in batches:
        at = 0
        for part in text_slices(batch.column(3), 1 << 20):
            host, shards, key = (c.slice(at, len(part)).to_pylist() for c in batch.columns[:3])
            at += len(part)
            fresh = []
            for i, k in enumerate(zip(host, key)):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            rows = []
            for i, (found, opened) in zip(fresh, _parsed(part.take(pa.array(fresh, pa.int64())))):
                content = hashlib.md5("\n".join(found).encode("utf-8", "replace") + bytes([opened])).digest()
                rows.append((host[i], shards[i], int.from_bytes(content[:7]) % shards[i], key[i], content, opened, _packed(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["host", "shards", "shard", "page_key", "content", "open", "text"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> page_id, url, text of all blocks."""
    for batch in batches:
        at = 0
        for part in text_slices(batch.column(2), 1 << 20):
            texts = ["\n".join(found) for found, _ in _parsed(part)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:2]), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
            at += len(part)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, host, page_key -> page_id, url, host, page_key, open, text (packed blocks)."""
    for batch in batches:
        at = 0
        for part in text_slices(batch.column(2), 1 << 20):
            found = [(opened, _packed(b)) for b, opened in _parsed(part)]
            rest = [batch.column(i).slice(at, len(part)) for i in (0, 1, 3, 4)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([o for o, _ in found], pa.bool_()), pa.array([t for _, t in found], pa.binary())], names=["page_id", "url", "host", "page_key", "open", "text"])
            at += len(part)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, open, text (packed blocks), pos, pages -> page_id, url, text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = []
            for opened, packed, pos, pages in zip(*(c.to_pylist() for c in part.columns[2:])):
                texts.append(_cut(_unpacked(packed), opened, dict(zip(pos or [], pages or []))) if packed is not None else "")
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def boilerplate(sited: DataFrame) -> DataFrame:
    """host, page_key, pos, pages: of pages (host, page_key, html) with units on PAGES pages or more, their places and numbers."""
    # few hosts are of several shards; joined by the size of this table
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    large = written(sited.groupBy("host").agg((F.floor(F.sum(size) / SHARD_BYTES) + 1).cast("long").alias("shards")).where("shards > 1"))
    dealt = sited.join(large, "host", "left").select("host", F.coalesce("shards", F.lit(1).cast("long")).alias("shards"), "page_key", "html")
    dealt = dealt.mapInArrow(_streams, "host string, shards long, shard long, page_key binary, content binary, open boolean, text binary")
    units = written(dealt.groupBy("host", "shard").applyInArrow(_judge, "host string, shards long, shard long, page_keys array<binary>, open boolean, pos array<bigint>, name array<bigint>, pages array<bigint>"))
    # hosts of several shards: a unit has one number of pages in each shard
    parts = units.where("shards > 1")
    each = parts.select("host", "shard", F.inline(F.arrays_zip("name", "pages"))).distinct().groupBy("host", "name").agg(F.sum("pages").alias("pages")).where(f"pages >= {PAGES}")
    total = parts.groupBy("host").agg(F.count("*").alias("total"))
    placed = parts.select("host", "page_keys", "open", F.inline(F.arrays_zip("pos", "name")))
    found = placed.join(each, ["host", "name"]).join(total, "host").where(F.col("open") | (F.col("pages") > F.floor(TEMPLATE * F.col("total")))).select("host", F.explode("page_keys").alias("page_key"), "pos", "pages")
    found = found.groupBy("host", "page_key").agg(F.collect_list(F.struct("pos", "pages")).alias("hits")).select("host", "page_key", F.col("hits.pos").alias("pos"), F.col("hits.pages").alias("pages"))
    return units.where("shards = 1").select("host", F.explode("page_keys").alias("page_key"), "pos", "pages").union(found)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by line ends) and n_chars (its code points) of every row, from the whole html.

    Null and empty html gives an empty text; very long pages are read whole, in time linear in their length; repeated rows
    give repeated rows; pages with a null url or none of a host keep all their blocks; other columns, whatever their names,
    are ignored; an empty table gives an empty result.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("page_key"))
    hits = written(boilerplate(rows.where("host <> ''").select("host", "page_key", "html")))
    bits = max(1 << 15, min(MOST_BITS, BITS_EACH * hits.count()))
    bit = F.pmod(F.xxhash64("host", "page_key"), F.lit(bits))
    # MOST_BITS bits at most
    maps = hits.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (place % 8 + 1).cast("int"))) != 0, F.lit(False))
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "bucket", "left").withColumn("some", some & (F.col("host") != ""))
    out = f"page_id {id_type}, url string, text string"
    plain = marked.where("not some").select("page_id", "url", "html").mapInArrow(_plain, out)
    held = marked.where("some").select("page_id", "url", "html", "host", "page_key").mapInArrow(_blocked, f"page_id {id_type}, url string, host string, page_key binary, open boolean, text binary")
    cut = held.join(hits, ["host", "page_key"], "left").select("page_id", "url", "open", "text", "pos", "pages").mapInArrow(_cuts, out)
    return plain.union(cut).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
