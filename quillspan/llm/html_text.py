"""Main text of web pages by nearest-URL page differencing.

Every page is cut into text blocks at block-level tags. Blocks inside elements that never hold an article (nav, header,
footer, aside, form, script, style and the like), or whose class, id or role names a menu, notice, advert, sidebar or
comment area, are marked as chrome by their markup. Then each page is differenced with the nearest different pages by
URL: pages are sorted by host and path, copies (pages of the same lines) that follow each other make a run, and a page's
lines are aligned by a longest common subsequence with the run before and the run after its own on its host. Lines shared
with either are deleted as the site's template. Markup checks this both ways: chrome is deleted though no neighbour has
it, and a shared line inside an <article> or <main> element is kept, as articles on one host may share a passage.

Neighbours come from a range-partitioned sort by (host, path, id), so a host with a third of all pages is spread over many
tasks and no host is gathered in one. A partition's first and last run wait for what lies beyond its ends: these runs and
the ones beside them, at most four of a partition, go to one small task in order. Markup alone decides for the only page
of a host and its copies; there, what lies outside the <article> or <main> element of a page that has one is not its text.
Pages without text have no template and are passed over as neighbours.

Lines are aligned in memory that grows with the lines of two pages, bit by bit of large numbers: 50,000 lines against as many take about a second.
A result has the page's id and URL and no other column of the input, whatever it is called. A null html counts as empty and gives an empty text; a null URL has the empty host and path. Repeated rows stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Elements of HTML by their part in a page.
DROPPED = frozenset("script style noscript template nav header footer aside form button select option textarea iframe svg canvas object head title menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_P_ENDS = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary", "body", "html"}
#: Words of class, id or role attributes that name what is not the article.
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adsense|banner|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|side|aside|widget|related|recommended|share|sharing|social|footer|foot|header|masthead|comment|comments|reader-comments|replies|disqus|respond|pager|pagination|search|toolbar|tags|contentinfo|complementary|skip)(?:$|[\s_-])",
    re.I,
)
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects (text, in chrome, in article) per block; unclosed tags end where an enclosing one does."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.found: list[tuple[str, bool, bool]] = []
        self.state = (False, False)

    def cut(self) -> None:
        if text := _SPACE.sub(" ", "".join(self.parts)).strip():
            self.found.append((text, *self.state))
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag in DROPPED:
            self.cut()
        if tag in _P_ENDS:
            self._close_p()
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        named = any(k in ("class", "id", "role") and v and CHROME.search(v) for k, v in attrs)
        body = tag in ("html", "body", "article", "main")
        chrome, article = self.state
        if tag in ("article", "main"):
            article = True
        if tag == "header" and article and not named:
            pass  # the heading of an article
        elif tag in DROPPED or (named and not body):
            chrome = True
        self.open.append((tag, *self.state))
        self.state = (chrome, article)
        if tag in ("script", "style"):
            return

    def _close_p(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag == "p":
                self.state = self.open[i][1:]
                del self.open[i:]
                return
            if tag in BLOCK or tag in DROPPED:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCK or tag in DROPPED or any(t in BLOCK or t in DROPPED for t, *_ in self.open[i:]):
                    self.cut()
                self.state = self.open[i][1:]
                del self.open[i:]
                return
            if self.open[i][0] in DROPPED and tag not in ("article", "main", "body", "html"):
                return  # a stray end tag does not close what is around it

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def page_blocks(html: str) -> list[tuple[str, bool, bool]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.found


def _prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The lengths of the longest common subsequences of x with y[:0], y[:1], ..., y. One big number's bits stand for y's lines, so a line of x costs a few operations on them."""
    places: dict[int, int] = {}
    for j, line in enumerate(y):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for line in x:
        meets = row & places.get(line, 0)
        row = ((row + meets) | (row - meets)) & full
    bits = np.unpackbits(np.frombuffer((full ^ row).to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def _align(x: list[int], y: list[int], at: int, out: list[int]) -> None:
    """Adds the places in x (from at on) of a longest common subsequence with y, halving x each time: memory grows with the lines and not with their product."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append(at + a)
            a, c = a + 1, c + 1
        if a == b or c == d:
            continue
        if b - a == 1:
            if x[a] in y[c:d]:
                out.append(at + a)
            continue
        middle = (a + b) // 2
        before = _prefix_lengths(x[a:middle], y[c:d])
        after = _prefix_lengths(x[middle:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(np.argmax(before + after))
        todo += [(a, middle, c, cut), (middle, b, cut, d)]


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a, whether it belongs to a longest common subsequence with b. Common ends are matched first, which loses no length."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    flags = [True] * head + [False] * (len(a) - head - tail) + [True] * tail
    names = {line: i for i, line in enumerate(set(a[head : len(a) - tail]) & set(b[head : len(b) - tail]))}
    x = [i for i in range(head, len(a) - tail) if a[i] in names]
    found: list[int] = []
    _align([names[a[i]] for i in x], [names[s] for s in b[head : len(b) - tail] if s in names], 0, found)
    for i in found:
        flags[x[i]] = True
    return flags


def main_blocks(own: Sequence[tuple[str, bool, bool]], near: list[list[str]]) -> list[str]:
    """The page's text blocks without chrome and without the lines outside its article that it shares with a neighbour. Without neighbours, only what is in the article, if it marks one."""
    if not near and any(article and not chrome for _, chrome, article in own):
        own = [b for b in own if b[2]]
    lines = [t for t, *_ in own]
    shared = [any(flags) for flags in zip(*(shared_lines(lines, other) for other in near), strict=True)] if near else [False] * len(lines)
    return [t for (t, chrome, article), same in zip(own, shared, strict=True) if not chrome and (article or not same)]


class _Run:
    """Pages of one host that follow each other and have the same lines, or none. Equal blocks are held once."""

    def __init__(self, host: str) -> None:
        self.host, self.lines, self.rows, self.at = host, [], [], 0
        self.kinds: dict[tuple, tuple] = {}

    def takes(self, host: str, lines: list[str]) -> bool:
        return host == self.host and (not lines or not self.lines or lines == self.lines)

    def add(self, id_, url: str | None, blocks: list) -> None:
        kind = tuple(blocks)
        self.lines = self.lines or [t for t, *_ in blocks]
        self.rows.append((id_, url, self.kinds.setdefault(kind, kind)))

    def texts(self, before: _Run | None, after: _Run | None) -> Iterator[tuple]:
        near = [r.lines for r in (before, after) if r is not None and r.host == self.host]
        text = {kind: " ".join(main_blocks(kind, near)) for kind in self.kinds}
        for id_, url, kind in self.rows:
            yield id_, url, text[kind], len(text[kind])


def _runs(pages: Iterator[tuple]) -> Iterator[_Run]:
    """Runs of (host, id, url, blocks), numbered."""
    run, n = None, 0
    for host, id_, url, blocks in pages:
        if run is None or not run.takes(host, [t for t, *_ in blocks]):
            if run is not None:
                yield run
                n += 1
            run = _Run(host)
            run.at = n
        run.add(id_, url, blocks)
    if run is not None:
        yield run


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (parts.hostname or "") if parts.netloc else "", parts.path


def extract_text(df: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """id, url, text and n_chars (its code points) of every row."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = df.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "id", "url"]
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    id_sql = dict(rows.dtypes)["id"]
    id_type = pa.int64() if id_sql == "bigint" else None

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, u, h, host in zip(*(batch.column(c) for c in ("id", "url", "html", "host")), strict=True):
                yield host.as_py(), i.as_py(), u.as_py(), page_blocks(h.as_py())

    def out(made: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held = 0
        for row in made:
            done.append(row)
            held += 200 + row[3]
            if held > 4_000_000:
                yield batch_of(done)
                done, held = [], 0
        if done:
            yield batch_of(done)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts, sizes = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["id", "url", "text", "n_chars"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All runs but a partition's first and last, which have both neighbours here."""

        def made() -> Iterator[tuple]:
            before = run = None
            for after in _runs(pages(batches)):
                if before is not None:
                    yield from run.texts(before, after)
                before, run = run, after

        return out(made())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first two and the last two runs; of a run that inner() has done, one page with text. Blocks equal to the row's before are left out."""
        part = TaskContext.get().partitionId()
        head: list[_Run] = []
        tail: list[_Run] = []
        for run in _runs(pages(batches)):
            if len(head) < 2:
                head.append(run)
            else:
                tail = [*tail[-1:], run]
        chosen = [*head, *tail]
        for n, run in enumerate(chosen):
            waits = n in (0, len(chosen) - 1)
            given = run.rows if waits else [next((r for r in run.rows if r[2]), run.rows[0])]
            for start in range(0, len(given), 1000):
                some = given[start : start + 1000]
                kinds = [json.dumps(k) if i == 0 or k is not some[i - 1][2] else None for i, (_, _, k) in enumerate(some)]
                size = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * size, pa.int32()), pa.array([run.at] * size, pa.int64()), pa.array(range(start, start + size), pa.int64()), pa.array([waits] * size), pa.array([run.host] * size, pa.string()), pa.array([r[0] for r in some], id_type), pa.array([r[1] for r in some], pa.string()), pa.array(kinds, pa.string())],
                    names=["part", "run", "row", "waits", "host", "id", "url", "blocks"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ends of all partitions in order: runs that go on over an end become one, and those that waited get their texts."""

        def merged() -> Iterator[tuple[_Run, bool]]:
            run, waits, blocks, kind = None, False, [], None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["blocks"] is not None and r["blocks"] != kind:
                        kind = r["blocks"]
                        blocks = [tuple(b) for b in json.loads(kind)]
                    if run is None or not run.takes(r["host"], [t for t, *_ in blocks]):
                        if run is not None:
                            yield run, waits
                        run, waits = _Run(r["host"]), r["waits"]
                    if r["waits"] or not run.rows:
                        run.add(r["id"], r["url"], blocks)
            if run is not None:
                yield run, waits

        def made() -> Iterator[tuple]:
            before, run, waits = None, None, False
            for after, next_waits in chain(merged(), [(None, False)]):
                if waits:
                    yield from run.texts(before, after)
                before, run, waits = run, after, next_waits

        return out(made())

    # Both read the one sorted exchange: Spark reuses it, and its partitions are the same for either.
    if df.sparkSession.conf.get("spark.sql.exchange.reuse", "true") != "true":
        raise ValueError("extract_text needs spark.sql.exchange.reuse: the ends of partitions are read from the exchange of the pages")
    given = sorted_.select("id", "url", "html", "host")
    schema = f"id {id_sql}, url string, text string, n_chars bigint"
    waiting = scratch.map_batches(given, ends, f"part int, run bigint, row bigint, waits boolean, host string, id {id_sql}, url string, blocks string")
    finished = scratch.map_batches(waiting.repartition(1).sortWithinPartitions("part", "run", "row"), joined, schema)
    return scratch.map_batches(given, inner, schema).union(finished).withColumnsRenamed({"id": id_, "url": url})


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
