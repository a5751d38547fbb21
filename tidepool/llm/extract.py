"""HTML main-text extraction with site template removal (operator 5).

A page is parsed leniently (unclosed and misnested elements included) into text blocks and
container elements. Text that HTML itself never shows as text (scripts, styles, forms,
embedded media, the head) is not read. What else is boilerplate is told by the host's
pages:

* Each container's subtree has two hashes, built bottom-up: `exact` (tag, attributes,
  text, children) and `shape` (tag, class words and the set of its children's shapes;
  no text). Spark counts on how many pages of different content a host has them.
* These subtrees are deleted: exact ones on MIN_PAGES pages or more, wherever they are; shapes
  on a quarter of the host's pages (at least 2, and no more than LEAST_PAGES are asked for),
  if they lie outside the content element (article, else main) or bear a name of
  boilerplate (SKIP_WORDS, nav, footer, ...); and named shapes on MIN_PAGES pages of any
  hosts. Text outside the content element and in no container goes by its tag likewise. An
  element that holds the content element is never deleted.
* On a host whose pages all have one content nothing can recur, and names decide: content
  element only, without what is named.

Headings and text blocks as such are no containers: a passage that many articles quote
stays.

Text: character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one newline.

Defined cases: null html is empty; a null url has the empty host; repeated pages are
extracted alike and are one page for the count; truncated pages are read as far as
they go, an unfinished tag at the end is dropped; an empty table gives no rows; other
columns are ignored. Work is linear in the length of a page and the depth it nests to.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Pages of different content: of a host where something can recur, that make an exact subtree
#: a template, and that make a shape one on hosts of many pages.
HOST_PAGES, MIN_PAGES, LEAST_PAGES = 2, 8, 3
#: Templates that may be broadcast; beyond, a merge join on keys salted SALTS-fold.
BROADCAST_ROWS, SALTS = 50_000, 16

# Element names of the HTML standard and words of common site markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe object embed svg canvas math audio video map form button select option textarea input title xmp noembed noframes".split())
NAMED = frozenset("nav header footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br script style noscript template svg button select iframe object".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption caption hr".split())
CONTENT = ("article", "main")
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead header footer comment comments disqus respond replies reply share sharing social related recommended recommendations widget widgets toolbar complementary contentinfo".split()
)
#: What an opening tag ends: open elements of these names, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*)(>?)""", re.S)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def _marks(attributes: str) -> list[str]:
    """The words of class, id and role."""
    if not attributes or "=" not in attributes:
        return []
    return [w for m in MARKS.finditer(attributes) for w in re.split(r"[^a-z0-9]+", m[1].lower()) if w]


def _hash(*parts) -> int:  # noqa: ANN002
    """A signed 64-bit hash, never 0."""
    return _signed(xxhash.xxh64_intdigest(repr(parts).encode("utf-8", "surrogatepass"))) or 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Container:
    __slots__ = ("parent", "named", "inside", "holds", "text", "hasher", "exact", "shape")

    def __init__(self, parent: int, named: bool, inside: frozenset[str], hasher) -> None:  # noqa: ANN001
        self.parent, self.named, self.inside, self.hasher = parent, named, inside, hasher
        self.holds: set[str] = set()
        self.text = False
        self.exact = self.shape = 0


class Page:
    """blocks: [text, container or -1, content elements around it, under a name, tag]; containers."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, frozenset[str], bool, str]] = []
        self.containers: list[Container] = []
        # tag, hidden, named, container or -1, shapes of the children (None for inline elements), marks
        self._stack: list[tuple[str, bool, bool, int, set[int] | None, tuple[str, ...]]] = []
        self._outer = [set()]  # the sets of the open elements that are not inline
        self._open_tags: Counter[str] = Counter()
        self._at = [-1]  # open containers
        self._hidden = self._named = 0
        self._buffer: list[str] = []
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            if not m[4] and at >= len(source):
                break  # an unfinished tag
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close(tag)
        while self._stack:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        if text and not self._hidden:
            self._buffer.append(text)

    def _inside(self) -> frozenset[str]:
        return frozenset(t for t in CONTENT if self._open_tags[t])

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            if text:
                at = self._at[-1]
                tag = next((x[0] for x in reversed(self._stack) if x[4] is not None), "")
                self.blocks.append((text, at, self._inside(), self._named > 0, tag))
                if at >= 0:
                    self.containers[at].text = True
                    self.containers[at].hasher.update(text.encode("utf-8", "surrogatepass") + b"\0")
            self._buffer = []

    def _pop(self) -> None:
        tag, hidden, named, number, children, marks = self._stack[-1]
        if children is not None:
            self._flush()
        self._stack.pop()
        self._open_tags[tag] -= 1
        self._hidden -= hidden
        self._named -= named
        if children is None:
            return
        self._outer.pop()
        shape = _hash(tag, marks, sorted(children))
        self._outer[-1].add(shape)
        if number >= 0:
            self._at.pop()
            own = self.containers[number]
            own.exact, own.shape = _signed(own.hasher.intdigest()) or 1, shape
            own.hasher = None
            if own.parent >= 0:
                above = self.containers[own.parent]
                above.holds |= own.holds
                above.text |= own.text
                above.hasher.update(own.exact.to_bytes(8, "little", signed=True))
        elif tag in CONTENT and not named and self._at[-1] >= 0:
            self.containers[self._at[-1]].holds.add(tag)

    def _open(self, tag: str, attributes: str) -> None:
        marks = tuple(_marks(attributes))
        hidden = tag in HIDDEN
        named = tag in NAMED or not SKIP_WORDS.isdisjoint(marks)
        if tag in CONTENT and not named:
            while self._hidden or self._named:  # content does not start inside an advert that was left open
                self._pop()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag not in INLINE:
            self._end({"p"}, {"td", "th", "li", "div", "section", *CONTENT, "table", "blockquote", "body"})
            self._flush()
        elif tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        number, children = -1, None
        if tag not in INLINE:
            children = set()
            self._outer.append(children)
            if tag not in TEXT_BLOCKS and tag not in CONTENT and tag not in ("html", "body", "head"):
                number = len(self.containers)
                self.containers.append(Container(self._at[-1], named, self._inside(), xxhash.xxh64(f"{tag}{attributes}".encode("utf-8", "surrogatepass"))))
                self._at.append(number)
            elif self._at[-1] >= 0:
                self.containers[self._at[-1]].hasher.update(f"<{tag}>".encode("utf-8", "surrogatepass"))
        self._stack.append((tag, hidden, named, number, children, tuple(re.sub("[0-9]+", "0", w) for w in marks)))
        self._open_tags[tag] += 1
        self._hidden += hidden
        self._named += named

    def _end(self, ended: set[str], bounds: set[str]) -> None:
        """Close the nearest open element of `ended`, unless a bound is nearer."""
        if not any(self._open_tags[t] for t in ended):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in ended:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in bounds:
                return

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            if tag == "p":
                self._flush()
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in CONTENT and tag in INLINE:
                return

    def content(self) -> str | None:
        """The content element that counts: article, else main, if either has text."""
        return next((c for c in CONTENT if any(c in inside and not named for _, _, inside, named, _ in self.blocks)), None)

    def kept(self) -> list[bool]:
        """Of each block whether names leave it in."""
        content = self.content()
        return [not named and (content is None or content in inside) for _, _, inside, named, _ in self.blocks]

    def main_text(self) -> str:
        return "\n".join(b[0] for b, keep in zip(self.blocks, self.kept()) if keep)

    def marked(self) -> tuple[list[list], list[list[int]]]:
        """blocks (text, container, whether names leave it in, hash of a stray one) and
        containers (parent, hashes exact, shape, named). A hash is 0 where it may not decide."""
        content = self.content()
        blocks = [[text, at, keep, _hash("stray", tag) if content and at < 0 and content not in inside else 0] for (text, at, inside, _, tag), keep in zip(self.blocks, self.kept())]
        containers = []
        for c in self.containers:
            free = c.text and not (c.holds and content in c.holds)
            outside = content is not None and content not in c.inside
            containers.append([c.parent, _hash("exact", c.exact) if free else 0, _hash("shape", c.shape) if free and (outside or c.named) else 0, _hash("named", c.shape) if free and c.named else 0])
        return blocks, containers


#: Marks a page of a host in the counts, and counts over all hosts.
PAGE, ANYWHERE = 0, 0
#: What a page shows: hashes of its containers and stray blocks, each once.
SHOWN = "key long, host string, main long, exact array<long>, shape array<long>, named array<long>, stray array<long>"
_HASHES = ("exact", "shape", "named", "stray")
#: page: the blocks and containers, as compressed JSON.
PARSED = "key long, page_id long, url string, page binary"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield batch, [Page(source) for source in batch.column("html").to_pylist()]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in _pages(batches):
        mains = [_signed(xxhash.xxh64_intdigest(page.main_text().encode("utf-8", "surrogatepass"))) for page in pages]
        hashes: dict[str, list[list[int]]] = {k: [] for k in _HASHES}
        for page in pages:
            blocks, containers = page.marked()
            for k, name in enumerate(_HASHES[:3], 1):
                hashes[name].append(list({c[k] for c in containers if c[k]}))
            hashes["stray"].append(list({b[3] for b in blocks if b[3]}))
        columns = [batch.column("key"), batch.column("host"), pa.array(mains, pa.int64()), *(pa.array(hashes[k], pa.list_(pa.int64())) for k in _HASHES)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "host", "main", *_HASHES])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor()
    for batch, pages in _pages(batches):
        packed = [pack.compress(json.dumps(page.marked()).encode()) for page in pages]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "page_id", "url")), pa.array(packed, pa.binary())], ["key", "page_id", "url", "page"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [assembled(*json.loads(unpack.decompress(page)), set(drop or ())) for page, drop in zip(batch.column("page").to_pylist(), batch.column("drop").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def assembled(blocks: list[list], containers: list[list[int]], drop: set[int]) -> str:
    """The text of a page, given the hashes that recur on its host."""
    if PAGE not in drop:
        return "\n".join(text for text, _, keep, _ in blocks if keep)
    gone: list[bool] = []
    for parent, *hashes in containers:  # parents come first
        gone.append((parent >= 0 and gone[parent]) or any(h and h in drop for h in hashes))
    return "\n".join(text for text, at, _, stray in blocks if not ((at >= 0 and gone[at]) or (stray and stray in drop)))


def signatures(marks: DataFrame) -> DataFrame:
    """(key, host, hash, least, main): what each page shows, and on how many pages it
    must be to count. host is a hash; named shapes are there for ANYWHERE too."""
    one = lambda host, hash_, least: F.struct(host.alias("host"), hash_.cast("long").alias("hash"), F.lit(least).cast("byte").alias("least"))
    host, anywhere = F.xxhash64("host"), F.lit(ANYWHERE).cast("long")
    of = lambda name, least, where=host: F.transform(name, lambda h: one(where, h, least))
    rows = F.concat(of("exact", MIN_PAGES), of("shape", LEAST_PAGES), of("named", LEAST_PAGES), of("named", MIN_PAGES, anywhere), of("stray", LEAST_PAGES), F.array(one(host, F.lit(PAGE), HOST_PAGES)))
    return marks.select("key", "main", F.explode(rows).alias("x")).select("key", "x.*", "main")


def templates(shown: DataFrame, min_pages: int | None = None) -> DataFrame:
    """(host, hash) of what recurs on enough pages of different content; what a shape needs
    grows with the host's pages. min_pages: for all but the count of a host's pages."""
    pages = shown.groupBy("host", "hash", "least", "main").agg(F.lit(1).alias("one")).groupBy("host", "hash", "least").agg(F.count("*").alias("n"))
    pages = written(pages, "counts")
    size = pages.where(F.col("hash") == PAGE).select("host", F.col("n").alias("host_pages"))
    scaled = F.least(F.col("least"), F.greatest(F.lit(2), F.ceil(F.col("host_pages") / 4)))
    least = F.when(F.col("least") == LEAST_PAGES, scaled).otherwise(F.col("least"))
    need = least if min_pages is None else F.when(F.col("hash") == PAGE, F.col("least")).otherwise(F.lit(min_pages))
    return pages.hint("merge").join(size.hint("merge"), "host", "left").where(F.col("n") >= need).select("host", "hash").distinct()


def extract(pages: DataFrame, min_pages: int | None = None) -> DataFrame:
    """(page_id, url, text) of each row of pages (page_id, url, html)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))).withColumn("key", F.xxhash64("url", "html"))
    # pages are read again for their text: that takes less disk than to keep what was parsed
    shown = signatures(written(src.select("key", "host", "html").mapInArrow(_mark, SHOWN), "marks"))
    recurring = written(templates(shown, min_pages), "templates")
    own = shown.select("key", "host", "hash")
    if recurring.count() <= BROADCAST_ROWS:
        hit = own.join(F.broadcast(recurring), ["host", "hash"])
    else:
        salted = recurring.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        hit = own.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).hint("merge").join(salted.hint("merge"), ["host", "hash", "salt"])
    drops = written(hit.groupBy("key").agg(F.collect_set("hash").alias("drop")), "drops")
    parsed = src.select("key", "page_id", "url", "html").mapInArrow(_parse, PARSED)
    joined = parsed.hint("merge").join(drops.hint("merge"), "key", "left")
    return joined.select("page_id", "url", "page", "drop").mapInArrow(_assemble, "page_id long, url string, text string")


def report(pages: DataFrame, min_pages: int | None = None) -> DataFrame:
    return extract(pages, min_pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
