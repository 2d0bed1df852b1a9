"""Board pages scanned for deals, many pages at a time.

What a page says goes through Python once: its texts, and what these say of
prices, conditions and times. A page is split at its marks, and
a tag that is written plainly, as most are, is told once for all places where
it stands; from the first mark that isn't plain the standard library's parser
reads on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.price_text import once, price_of, shipping_term
from pricelens.functions.rules import time_at, time_told

ROW = "page_id long, site string, post_id string, title string, url string, status string, reaction long, won long, shipping long, tags array<string>, clock int, day int"
#: Elements without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text isn't shown.
SILENT = {"script", "style", "template", "rt", "rp"}
#: Elements that hold text alone, in this version of the parser or in others.
TEXT = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "plaintext"}
#: Between < and >: a start tag whose values are in double quotes, one that may lack them, an end tag, a comment or document type. What is none of these may depend on what follows.
PLAIN = re.compile(r'([a-zA-Z][-a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_][-a-zA-Z0-9_]*="[^"]*")*)[ \t\n\r\f]*(/?)')
START = re.compile(r"""[a-zA-Z][-a-zA-Z0-9]*(?:[ \t\n\r\f]+[a-zA-Z_][-a-zA-Z0-9_]*(?:="[^"]*"|='[^']*'|=[-a-zA-Z0-9_.]+(?![^ \t\n\r\f]))?)*[ \t\n\r\f]*/?""")
VALUE = re.compile(r'([a-zA-Z_][-a-zA-Z0-9_]*)="([^"]*)"')
END = re.compile(r"/([a-zA-Z][-a-zA-Z0-9]*)[ \t\n\r\f]*")
UNSEEN = re.compile(r"!--[^-]+(?:-[^-]+)*--|!(?i:doctype)[^\[]*")
#: Tags that a worker remembers, and the longest of them; rows of a batch that leaves it.
TAGS, LONGEST, ROWS = 4096, 200, 8192


class Kind(NamedTuple):
    """A start tag. Its elements are found by the keys: tag, .class, #id."""

    tag: str
    attrs: dict[str, str | None]
    classes: frozenset[str]
    keys: tuple[str, ...]
    ends: bool

    @classmethod
    def of(cls, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> Kind:
        attrs = dict(attrs)
        classes = frozenset((attrs.get("class") or "").split())
        own = ["#" + attrs["id"]] if attrs.get("id") else []
        return cls(tag, attrs, classes, (tag, *("." + c for c in classes), *own), closed or tag in VOID)


class Tag(HTMLParser):
    """A start tag by the standard library's parser."""

    def __init__(self, raw: str):
        super().__init__()
        self.kind = None
        self.feed(f"<{raw}>")

    def handle_starttag(self, tag, attrs):
        self.kind = Kind.of(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self.kind = Kind.of(tag, attrs, True)


class Tags(dict):
    """What stands between < and > -> a start tag's kind, an end tag's name, "" of what isn't shown; None of what isn't plain."""

    def __missing__(self, raw: str) -> Kind | str | None:
        m = PLAIN.fullmatch(raw)
        if m and ("&" not in raw or unescape(raw) == raw):
            got = Kind.of(m[1].lower(), [(k.lower(), v) for k, v in VALUE.findall(m[2])], bool(m[3]))
        elif START.fullmatch(raw):
            got = Tag(raw).kind
        else:
            m = END.fullmatch(raw)
            got = m[1].lower() if m else "" if UNSEEN.fullmatch(raw) else None
        if len(raw) <= LONGEST:
            if len(self) >= TAGS:
                self.clear()
            self[raw] = got
        return got


KNOWN = Tags()


class Page(HTMLParser):
    """A page's elements in the order they begin, as lists: an element's kind, its parent's number, where its descendants end, and its texts.

    Elements that never end hold all that follows. Nothing here recurses, so
    elements may be nested as deep as the page is long; the first descendant
    of a kind is found by bisection.
    """

    def __init__(self, html: str):
        super().__init__()
        self.kinds, self.parent, self.end, self.text_from, self.text_to = [], [], [], [], []
        self.texts, self.open, self.names, self.hidden = [], [], defaultdict(int), 0
        self.found = defaultdict(list)  # key -> numbers of elements
        at = self.plain(html)
        if at < len(html):
            self.feed(html[at:])
            self.close()
        self.shut(0)

    def plain(self, html: str) -> int:
        """Takes what is plainly written; gives where the rest begins."""
        pieces = html.split("<")
        if pieces[0]:
            self.handle_data(unescape(pieces[0]))
        kinds, texts, opened, names, skip = self.kinds, self.texts, self.open, self.names, 0
        for i, piece in enumerate(pieces):
            if i <= skip:
                continue
            raw, closed, text = piece.partition(">")
            kind = KNOWN[raw] if closed else None
            if kind.__class__ is str:
                if opened and kinds[opened[-1]].tag == kind and kind not in SILENT:
                    n = opened.pop()
                    self.end[n], self.text_to[n] = len(kinds), len(texts)
                    names[kind] -= 1
                else:
                    self.handle_endtag(kind)
            elif kind is None or kind.tag in TEXT and not (skip := self.lone(pieces, i, kind)):
                return sum(map(len, pieces[:i])) + i - 1
            else:
                self.start(kind)
            if text and not self.hidden:
                texts.append(unescape(text) if "&" in text else text)
        return len(html)

    def lone(self, pieces: list[str], i: int, kind: Kind) -> int:
        """The last piece before the end of an element that holds text alone; 0 where the parser's versions may differ on its end."""
        end = next((k for k in range(i + 1, len(pieces)) if pieces[k].startswith("/")), 0)
        inner = pieces[i + 1 : end]
        plain = not any(x.startswith("!") for x in inner) if kind.tag in SILENT else not inner and "&" not in pieces[i]
        return end - 1 if end and plain and not kind.ends and pieces[end].lower().startswith(f"/{kind.tag}>") else 0

    def shut(self, depth: int) -> None:
        while len(self.open) > depth:
            n = self.open.pop()
            self.end[n], self.text_to[n] = len(self.kinds), len(self.texts)
            tag = self.kinds[n].tag
            self.names[tag] -= 1
            self.hidden -= tag in SILENT

    def start(self, kind: Kind) -> None:
        n, at, opened = len(self.kinds), len(self.texts), self.open
        self.kinds.append(kind)
        self.parent.append(opened[-1] if opened else -1)
        self.text_from.append(at)
        self.text_to.append(at)
        self.end.append(n + 1)
        for key in kind.keys:
            self.found[key].append(n)
        if not kind.ends:
            opened.append(n)
            self.names[kind.tag] += 1
            if kind.tag in SILENT:
                self.hidden += 1

    def handle_starttag(self, tag, attrs):
        self.start(Kind.of(tag, attrs, False))

    def handle_startendtag(self, tag, attrs):
        self.start(Kind.of(tag, attrs, True))

    def handle_endtag(self, tag):
        if self.names[tag]:  # else nothing of that name is open
            depth = len(self.open) - 1
            while self.kinds[self.open[depth]].tag != tag:
                depth -= 1
            self.shut(depth)

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section that the parser knows: a comment up to the next ">"
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])

    def of(self, key: str, *classes: str) -> list[int]:
        """Elements with a key and these classes."""
        got = self.found.get(key, [])
        return [n for n in got if self.kinds[n].classes.issuperset(classes)] if classes else got

    def below(self, above: list[int], found: list[int]) -> list[int]:
        """Those of found that are below any of above."""
        out, k, edge = [], 0, 0
        for n in found:
            while k < len(above) and above[k] < n:
                edge = max(edge, self.end[above[k]])
                k += 1
            if n < edge:
                out.append(n)
        return out

    def within(self, n: int, found: list[int]) -> list[int]:
        """Those of found that are below n."""
        return found[bisect_right(found, n) : bisect_left(found, self.end[n])]

    def first(self, n: int, found: list[int]) -> int | None:
        """The first of found that is below n."""
        at = bisect_right(found, n)
        return found[at] if at < len(found) and found[at] < self.end[n] else None

    def text(self, n: int | None) -> str | None:
        """Stripped texts below n, joined."""
        return None if n is None else "".join([t.strip() for t in self.texts[self.text_from[n] : self.text_to[n]]])

    def outside(self, n: int, but: int | None) -> str:
        """Texts below n, joined, without those below but."""
        a, b = self.text_from[n], self.text_to[n]
        return "".join(self.texts[a:b] if but is None else self.texts[a : self.text_from[but]] + self.texts[self.text_to[but] : b])

    def href(self, n: int) -> str:
        return self.kinds[n].attrs.get("href") or ""


def number(text: str | None) -> int:
    """0 for what is no number, or none that a long holds."""
    text = (text or "").strip()
    return int(text) if text.isdecimal() and len(text) <= 18 else 0


# Fixed values below: the classes, marks and addresses of the boards' pages.
def ppomppu(page: Page) -> Iterator[tuple]:
    titles = page.of("a", "baseList-title")
    posts, votes, times, ends = (page.of(c) for c in (".baseList-numb", ".baseList-rec", ".baseList-time", ".end2"))
    for row in page.of("tr", "baseList"):
        title = page.first(row, titles) if any(c.startswith("bbs_new") for c in page.kinds[row].classes) else None
        if title is None or "id=ppomppu" not in page.href(title):
            continue  # no deal, or another board's
        post = page.text(page.first(row, posts)) or ""
        if not post.isdigit():
            continue
        vote = (page.text(page.first(row, votes)) or "").split("-", 1)[0]
        name = page.text(title)
        yield post, name, f"https://www.ppomppu.co.kr/zboard/view.php?id=ppomppu&no={post}", page.first(row, ends) is not None, number(vote), page.text(page.first(row, times)), name, None


def ruliweb(page: Page) -> Iterator[tuple]:
    posts, wrappers, times, links = (page.of(c) for c in (".info_article_id", ".title_wrapper", ".time", "a"))
    titles = page.below(wrappers, links)
    votes = [n for n in page.of("strong") if page.parent[n] >= 0 and "recomd" in page.kinds[page.parent[n]].classes]
    for row in page.below(page.of("table", "board_list_table"), page.of("tr", "table_body", "normal")):
        post = page.first(row, posts) if page.kinds[row].classes.isdisjoint(("best", "notice")) else None
        value = post is not None and page.kinds[post].attrs.get("value")
        if not value:
            continue
        wrapper, title = page.first(row, wrappers), page.first(row, titles)
        outside = "" if wrapper is None else page.outside(wrapper, page.first(wrapper, links))
        over = any(m in outside for m in ("[품절]", "[종료]", "[매진]", "[마감]"))
        name = page.text(title) or ""
        yield value, name, page.href(title) if title is not None else "", over, number((page.text(page.first(row, votes)) or "").replace(",", "")), page.text(page.first(row, times)), name, None


def fmkorea(page: Page) -> Iterator[tuple]:
    lists = page.below(page.below(page.of("#content"), page.of(".fm_best_widget")), page.of("ul"))
    links, infos, ends, times = (page.of(c) for c in ("a", ".hotdeal_info", ".hotdeal_var8Y", ".regdate"))
    titles, votes = page.below(page.of(".title"), links), page.below(page.of(".pc_voted_count"), page.of(".count"))
    for item in page.below(lists, page.of("li")):
        title = page.first(item, titles)
        post = "" if title is None else page.href(title).strip("/").split("/")[-1]
        if not post:
            continue
        info = page.first(item, infos)
        cells = [page.text(n) for n in page.within(info, links)[:3]] if info is not None else []
        price, shipping = (cells[1], cells[2] if len(cells) > 2 else "") if len(cells) > 1 else (None, None)
        yield post, page.text(title), f"https://www.fmkorea.com/{post}", page.first(item, ends) is not None, number(page.text(page.first(item, votes))), page.text(page.first(item, times)), price, shipping


BOARDS = {"ppomppu": ppomppu, "ruliweb": ruliweb, "fmkorea": fmkorea}


def rows_of(html: str | None, site: str | None) -> list[tuple]:
    """What each deal row of a page says; none of an unknown board or a null. A page that breaks off says what came before."""
    if not html or site not in BOARDS:
        return []
    return [(post, title, url, "SOLD_OUT" if over else "ACTIVE", votes, *texts) for post, title, url, over, votes, *texts in BOARDS[site](Page(html))]


def priced(post: str, title: str, url: str, status: str, votes: int, time: str | None, price: str | None, shipping: str | None) -> tuple:
    """A row of ROW, from its status on: a board with a price cell states shipping in a cell of its own, elsewhere the title states both."""
    won, tags = price_of(price) or (None, []) if price is not None else (None, [])
    more, others = shipping_term(shipping) if shipping is not None else (None, [])
    return post, title, url, status, votes, won, more, once(tags + others) if won is not None else [], *time_told(time)


def scan_rows(pages: DataFrame) -> DataFrame:
    """ROW rows of pages (page_id, site, html). No shuffle; a page is one string."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split(" ") for x in ROW.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for p, s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rows += [(p, s, *priced(*d)) for d in rows_of(h.as_py(), s)]
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return pages.select(F.col("page_id").cast("long"), F.col("site").cast("string"), F.col("html").cast("string")).mapInArrow(run, ROW)


def scan_boards(pages: DataFrame, now: Column) -> DataFrame:
    """page_id, site, post_id, title, url, status, reaction, headline_price, applied_conditions, posted_at of every deal row.

    Where a price cell has no shipping beside it, that counts as unknown.
    """
    df = scan_rows(pages)
    won = F.col("won") + F.coalesce("shipping", F.lit(0))
    return df.select("page_id", "site", "post_id", "title", "url", "status", "reaction", won.alias("headline_price"), F.col("tags").alias("applied_conditions"), time_at(F.col("clock"), F.col("day"), now).alias("posted_at"))
