"""Main text of web pages by consensus paths of their host.

1. Every page is cut into elements. Each container is scored by the characters of its text outside links and
   boilerplate, less what links and boilerplate in it have; its path is generalised to tags and classes without digits.
   Elements named like boilerplate and forms are judged by content when the page is read: one that holds the page's
   article or most of its text is kept, and what stands in it is judged in turn.
2. Spark adds the scores, as shares of a page's best, over (host, path): the pages of a host vote. The winning path of
   a host is the one with the largest sum, ties to the longer, then the smaller path.
3. Every page is read again and its text taken from the containers on its host's winning path, if their score reaches
   half of the page's best; else from its own best container. Pages of no host vote together.

Votes are pre-aggregated, so a host with most of the pages is no hot key. The winners are broadcast while there are
few of them, else joined by a shuffle on the host with the hosts salted. Nothing of a page is capped.

Null and empty html give an empty text; text outside any tag counts as the page's own. Repeated rows and rows with null
ids or urls are pages like others; an empty table gives an empty result; other columns stay out of it.
"""

from __future__ import annotations

import hashlib
import html as character_references
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: elements whose content is no markup; all but titles are dropped with it
RAW = ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: elements that end an open paragraph and part blocks of text
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center div main section td html blockquote dd li".split())
DROPPED = frozenset(
    "head nav footer aside script style noscript template button select option textarea iframe svg object"
    " embed canvas menu dialog title xmp noembed noframes audio video map input label fieldset".split()
)
#: words in classes, ids and roles of what is no article
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments"
    " commentlist consent contentinfo complementary cookie cookies copyright disclaimer disqus dropdown footer gdpr hidden"
    " legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager"
    " pagination popup print promo promoted promotion recommended related replies reply respond search share sharing"
    " sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar tracking"
    " widget widgets warning alert".split()
)
#: a name with one of these tells of a layout with or without such a part, not of the part itself
ABOUT = frozenset("with has no without".split())
#: words for no kind of content; 'sidebar-wrap' is a sidebar, 'content-sidebar-wrap' is mixed
WRAPPING = frozenset("wrap wrapper layout container box inner outer area block section list".split())
#: an element of a mixed name, or a form, is kept where its text is more than so many times the text outside
MOST = 2
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
HOST = re.compile(r"^[\x09-\x0D ]*[a-z][-a-z0-9+.]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", re.IGNORECASE)
#: hosts up to which the winners are broadcast, each with a path of LONGEST characters at most
FEW_HOSTS = 50_000
#: a longer path goes on from its digest, so that deep or wide pages cost no more than others
LONGEST = 300
#: copies of a winner in the shuffled join
SALT = 16
#: share of the page's best score that the containers on the winning path must reach
ENOUGH = 0.5


class Element:
    """An open or closed element: where it begins in the list of text parts, and where it ends."""

    __slots__ = ("tag", "path", "dropped", "link", "begin", "end", "depth", "doubt", "inside")

    def __init__(
        self, tag: str, path: str, dropped: bool, link: bool, begin: int, depth: int, doubt: str = "", inside: bool = False
    ):
        self.doubt = doubt
        self.inside = inside  # it or an element around it is an article or main
        self.tag, self.path, self.dropped, self.link, self.begin, self.depth = tag, path, dropped, link, begin, depth
        self.end = -1


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def doubt_of(names: list[list[str]]) -> str:
    """'mixed' or 'single' where names, as lists of words, hold boilerplate words; else empty."""
    found = [n for n in names if not BOILERPLATE.isdisjoint(n) and ABOUT.isdisjoint(n)]
    if not found:
        return ""
    return "single" if any(BOILERPLATE.union(WRAPPING).issuperset(n) for n in found) else "mixed"


def marks(rest: str) -> tuple[list[str], list[list[str]], dict[str, str]]:
    """Classes without digits, the words of each class, id and role, and the attributes."""
    attributes: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        attributes.setdefault(name.lower(), value.strip("\"'"))
    classes = character_references.unescape(attributes.get("class", "")).split()
    named = [*classes, attributes.get("id", ""), attributes.get("role", "")]
    return [DIGITS.sub("", c) for c in classes], [[p.lower() for p in PARTS.findall(n)] for n in named], attributes


def longer(path: str, step: str) -> str:
    path = f"{path}/{step}"
    return path if len(path) <= LONGEST else "#" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()


class Page:
    """Text parts of a page with their state, and its containers.

    A part is (text, dropped, in a link) or None between blocks.
    """

    def __init__(self, source: str):
        self.parts: list[tuple[str, bool, bool] | None] = []
        self.containers: list[Element] = []
        self.doubtful: list[Element] = []
        root = Element("", "", False, False, 0, 0)
        self.stack = [root]
        self.open: Counter[str] = Counter()  # open elements of each tag
        self.blocks: list[int] = []  # places of open blocks in the stack
        at = 0
        while at < len(source):
            found = TOKEN.search(source, at)
            self._text(source[at : found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            if found["tag"]:
                at = self._tag(source, at, found["tag"].lower(), bool(found["end"]), found["rest"])
        while self.stack:
            self._close()
        self.root = root
        if self.doubtful:
            self._judge()

    def _judge(self) -> None:
        """Drops the doubtful elements that hold neither the page's article nor most of its text."""
        plain = [0]
        for part in self.parts:
            plain.append(plain[-1] + (len(part[0].strip()) if part and not part[1] and not part[2] else 0))

        def size(e: Element) -> int:
            return plain[e.end] - plain[e.begin]

        def within(e: Element, top: Element) -> bool:
            return e.begin >= top.begin and e.end <= top.end and e.depth >= top.depth

        def outermost(elements: list[Element]) -> list[Element]:
            out: list[Element] = []
            for e in elements:  # in the order of their beginnings
                if not out or not within(e, out[-1]):
                    out.append(e)
            return out

        articles = [e for e in self.containers if e.tag in ("article", "main") and not e.dropped and size(e)]
        doubtful = self.doubtful
        while True:
            tops = outermost(doubtful)
            kept = plain[-1] - sum(map(size, tops))
            owner, at = [], sorted(articles, key=lambda e: (e.begin, e.depth))
            i = 0
            for e in at:
                while i < len(tops) and tops[i].end <= e.begin:
                    i += 1
                owner.append(tops[i] if i < len(tops) and within(e, tops[i]) else None)
            outside = max((size(e) for e, o in zip(at, owner) if o is None), default=0)
            most = max((size(e) for e, o in zip(at, owner) if o is not None), default=0)
            holds = {id(o) for e, o in zip(at, owner) if o is not None and size(e) == most > outside}
            right = [
                e
                for e in tops
                if id(e) in holds and most > kept and (e.doubt == "mixed" or not outside)
                or e.doubt == "mixed" and not outside and size(e) > MOST * kept
                or e.doubt == "single" and size(e) and not kept
            ]
            if not right:
                break
            best = max(right, key=lambda e: (id(e) in holds, e.doubt == "mixed", size(e), -e.begin))
            doubtful = [e for e in doubtful if e is not best]
        inner = sorted(self.containers, key=lambda e: (e.begin, e.depth))
        i = 0
        for top in tops:
            for k in range(top.begin, top.end):
                part = self.parts[k]
                if part:
                    self.parts[k] = (part[0], True, part[2])
            while i < len(inner) and inner[i].begin < top.end:
                if within(inner[i], top):
                    inner[i].dropped = True
                i += 1

    def _text(self, raw: str) -> None:
        if raw:
            top = self.stack[-1]
            self.parts.append((character_references.unescape(raw) if "&" in raw else raw, top.dropped, top.link))

    def _close(self) -> None:
        element = self.stack.pop()
        element.end = len(self.parts)
        self.open[element.tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        if element.tag in BLOCK:
            self.parts.append(None)
        if element.tag in CONTAINER or not element.tag:
            self.containers.append(element)

    def _tag(self, source: str, at: int, tag: str, end: bool, rest: str) -> int:
        if end:
            if self.open[tag] > 0:
                while self.stack[-1].tag != tag:
                    self._close()
                self._close()
            return at
        if tag == "br":
            self.parts.append((" ", self.stack[-1].dropped, self.stack[-1].link))
        if tag in BLOCK:
            # a block ends an open paragraph and what stands open in it
            if self.blocks and self.stack[self.blocks[-1]].tag == "p":
                paragraph = self.blocks[-1]
                while len(self.stack) > paragraph:
                    self._close()
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                while self.stack[-1].tag in same:
                    self._close()
            self.parts.append(None)
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            return at
        above = self.stack[-1]
        classes, named, attributes = marks(rest) if rest.strip() else ([], [], {})
        path = longer(above.path, ".".join([tag, *sorted(classes)])) if tag in CONTAINER else above.path
        inside = above.inside
        dropped = (
            above.dropped
            or tag in DROPPED
            or (tag == "header" and not inside)
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "")
        )
        doubt = "" if dropped or tag in ("html", "body", "article", "main") else doubt_of(named)
        if tag == "form" and not dropped:
            doubt = doubt or "mixed"
        element = Element(tag, path, dropped, above.link or tag == "a", len(self.parts), above.depth + 1, doubt)
        element.inside = inside or tag in ("article", "main")
        self.open[tag] += 1
        if tag == "p" or tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        if doubt:
            self.doubtful.append(element)
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at)
            self._close()
            return over.end() if over else len(source)
        return at

    def scores(self) -> list[tuple[float, Element]]:
        """Score of each container that isn't dropped."""
        plain, other = [0], [0]
        for part in self.parts:
            size = len(part[0].strip()) if part else 0
            bad = bool(part) and (part[1] or part[2])
            plain.append(plain[-1] + (0 if bad else size))
            other.append(other[-1] + (size if bad else 0))
        out = []
        for e in self.containers:
            if not e.dropped:
                text = plain[e.end] - plain[e.begin]
                out.append((text - 0.5 * (other[e.end] - other[e.begin]), e))
        return out

    def best(self) -> tuple[float, Element] | None:
        """Highest score, ties to the deeper container, then to the first."""
        return max(self.scores(), key=lambda x: (x[0], x[1].depth, -x[1].begin), default=None)

    def text(self, element: Element) -> str:
        blocks, run = [], []
        for part in [*self.parts[element.begin : element.end], None]:
            if part is None:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif not part[1]:
                run.append(part[0])
        return "\n".join(b for b in blocks if b)


def votes(source: str) -> dict[str, float]:
    """Path -> score as a share of the page's best; of several containers on one path the best counts."""
    scored = Page(source).scores()
    best = max((s for s, _ in scored), default=0)
    out: dict[str, float] = defaultdict(float)
    for score, element in scored:
        if score > 0:
            out[element.path] = max(out[element.path], score / best)
    return out


def extract(source: str, path: str | None) -> str:
    """Text of the containers on the path, or of the page's best container where they fall far below it."""
    if not source:
        return ""
    page = Page(source)
    on_path = [e for e in page.containers if e.path == path and not e.dropped] if path is not None else []
    outer: list[Element] = []
    for e in sorted(on_path, key=lambda e: (e.begin, -e.end)):
        if not outer or e.begin >= outer[-1].end:
            outer.append(e)
    text = "\n".join(t for t in map(page.text, outer) if t)
    best = page.best()
    if text:
        score = {id(e): s for s, e in page.scores()}
        if not best or sum(score[id(e)] for e in outer) >= ENOUGH * best[0]:
            return text
    return page.text(best[1]) if best else ""


def main_text(pages: DataFrame, *, id_column: str = "page_id") -> DataFrame:
    """id, url, text, n_chars and path (the host's winning one) of every page."""
    rows = pages.select(F.col(id_column).alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], float] = defaultdict(float)
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, score in votes(source).items():
                    # whole numbers add up alike in any order
                    total[host_of(url), path] += round(score * 1e6)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in total], pa.string()),
                    pa.array([p for _, p in total], pa.string()),
                    pa.array([int(s) for s in total.values()], pa.int64()),
                ],
                names=["host", "path", "score"],
            )

    cast = arrow_map(rows.select("url", "html"), vote, "host string, path string, score long")
    sums = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    order = F.struct("score", F.length("path").alias("n"), "path")
    winners = sums.groupBy("host").agg(F.max(order).alias("w")).select("host", F.col("w.path").alias("path"))
    winners = written(winners, "winning-paths")
    few = winners.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?i)" + HOST.pattern, 1))
    known = rows.withColumn("host", host)
    if few:
        known = known.join(F.broadcast(winners), "host", "left")
    else:
        copies = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")
        known = known.withColumn("salt", salt).join(copies, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(s, p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns, batch.column(3)],
                names=["id", "url", "text", "n_chars", "path"],
            )

    schema = f"id {kind}, url string, text string, n_chars long, path string"
    return arrow_map(known.select("id", "url", "html", "path"), read, schema).withColumnRenamed("id", id_column)
