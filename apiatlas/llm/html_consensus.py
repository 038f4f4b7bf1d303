"""Main text of web pages by consensus host paths.

1. Every page's containers are scored: the length of the text below each, link text left out.
   Furniture does not count: elements that are menus, headers, footers, asides, scripts,
   styles, ... by their tag, and containers that a class, id or role names so, or that are forms.
   Such a name is a weak sign: it must be furniture as a whole ("no-sidebar" is not), and it is
   ignored where the container holds the page's article or first-level heading, and on pages
   that have no other text.
2. The page's candidate is its main element, or its articles, or else the container that is
   reached by going down from the page as long as one container holds all the text. Its
   generalised path (tags and classes, digits made equal) is the page's vote; Spark counts the
   votes of each host, and the path with most votes wins. Containers side by side in a candidate
   vote with their text too: a text that stands on the same path of most of a host's different
   pages, three or more, is furniture.
3. Every page is extracted again, without such repeated texts, from the elements on its host's
   winning path if they hold all of the page's text, or else from its own candidate, so a winning
   path never costs a page text of its own. First-level headings before an article stay with it.

Text: character references are decoded, white space within a block becomes one space,
blocks (paragraphs, headings, list items, cells, ...) are trimmed and joined by one line
feed in page order; a line-break tag is white space.

Cases: null, empty and text-free pages give the empty text; any length is read whole;
unclosed and stray tags are tolerated; a null url votes with the empty host; repeated rows
get equal texts and count as one page for repeated texts; an empty table gives no rows; other columns pass through, and an input
column named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import fresh, ship
from apiatlas.llm.url_rules import host_and_path
from apiatlas.session import write_table

ship(__name__)

#: A text repeats on a host if so many of its different pages hold it on the same path.
REPEATED = 3
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S | re.X)
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# fixed values: HTML's own element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map datalist".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr
    ul""".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
FURNITURE_TAGS = frozenset("aside button footer input label menu nav select textarea dialog".split())
#: Containers whose names are looked at.
NAMED = CONTAINER - frozenset("html body article main".split()) | frozenset("details dl fieldset form ol ul".split())
#: Words of classes, ids and roles that mark page furniture, and words that may stand beside them.
NEUTRAL = frozenset("""area bar block bottom box col column container first global inner item items last left link links list outer page
    panel primary reader right secondary section site slot text top unit user wrap wrapper""".split())
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets""".split())
#: A start tag closes these open elements, up to the nearest of the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Page:
    """A page's text blocks and containers, read in one pass."""

    def __init__(self, source: str):
        self.blocks: list = []  # (text, container, length without links, first-level heading?)
        self.paths: list = [""]  # of the containers; 0 stands for the page
        self.parents: list = [-1]
        self.tags: list = [""]
        self.named: list = [False]  # does its name, or being a form, say furniture?
        self.stack: list = []  # (tag, container, furniture, in_link, in_article) of open elements
        self.open: dict = {}
        self.parts: list = []
        self.links = 0
        self._read(source)
        self._drop_named()
        self.weights = self._weigh()

    def _below(self, marks: list[bool]) -> list[bool]:
        """The containers that are marked or stand below a marked one."""
        out = list(marks)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parents[k]]
        return out

    def _drop_named(self) -> None:
        """Take out the blocks of containers that are furniture by name."""
        if not any(self.named):
            return
        central = [tag in ("article", "main") for tag in self.tags]
        for _, k, _, top in self.blocks:
            central[k] = central[k] or top
        for k in range(len(central) - 1, 0, -1):
            central[self.parents[k]] = central[self.parents[k]] or central[k]
        named = self._below([n and not c for n, c in zip(self.named, central)])
        rest = [b for b in self.blocks if not named[b[1]]]
        if rest:
            self.blocks = rest

    def _weigh(self) -> list[int]:
        """Length of the text below each container, links left out."""
        weights = [0] * len(self.paths)
        for _, k, length, _ in self.blocks:
            weights[k] += length
        for k in range(len(weights) - 1, 0, -1):
            weights[self.parents[k]] += weights[k]
        return weights

    def _state(self) -> tuple:
        return self.stack[-1] if self.stack else ("", 0, False, False, False)

    def _end_block(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                self.blocks.append((text, self._state()[1], max(0, len(text) - self.links), bool(self.open.get("h1"))))
        self.parts, self.links = [], 0

    def _pop_to(self, k: int) -> None:
        for tag, *_ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def _close(self, tags: set, limit: set) -> None:
        """Close the innermost open element of ``tags`` that stands above all of ``limit``."""
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self._pop_to(k)
                return
            if self.stack[k][0] in limit:
                return

    def _kind(self, tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
        """Is an element furniture by its tag? By its name? And its classes, digits made equal."""
        if tag in FURNITURE_TAGS or tag in HIDDEN or (tag == "header" and not in_article):
            return True, False, ""
        named, classes = tag == "form", ""
        for kind, a, b, c in NAMES.findall(attributes) if tag in NAMED or tag in CONTAINER else ():
            value = a or b or c
            if kind.lower() == "class":
                classes = "".join("." + x for x in sorted(re.sub(r"\d+", "0", value).split()))
            for token in value.split() if tag in NAMED else ():
                words = {w.lower() for w in WORDS.findall(token) if not w.isdigit()}
                marks = words & FURNITURE - ({"header"} if in_article else set())  # an article's own header holds its heading
                named = named or bool(marks) and words <= marks | NEUTRAL
        return False, named, classes

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._end_block()
            self._close({"p"}, CONTAINER)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        _, container, furniture, link, article = self._state()
        own, named, classes = self._kind(tag, attributes, article) if not furniture else (True, False, "")
        if (tag in CONTAINER or named) and not own:
            self.paths.append(f"{self.paths[container]}>{tag}{classes}")
            self.parents.append(container)
            self.tags.append(tag)
            self.named.append(named)
            container = len(self.paths) - 1
        self.stack.append((tag, container, own, link or tag == "a", article or tag in ("article", "main")))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _finish(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        if self.open.get(tag):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self._pop_to(k)
                    return

    def _text(self, piece: str) -> None:
        _, _, furniture, link, _ = self._state()
        if not furniture and piece:
            self.parts.append(piece)
            if link:
                self.links += len(piece)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at:found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._finish(tag)
            elif tag in RAW:  # its content is no markup of the page
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
            else:
                self._start(tag, found[3] or found[6] or "")
        self._end_block()

    def candidates(self) -> list[int]:
        """The page's main elements, or else its outermost articles, or else the deepest container
        that holds all of the text; without text none."""
        for tag in ("main", "article"):
            own = [k for k, t in enumerate(self.tags) if t == tag and self.weights[k]]
            inner = self._below([t == tag for t in self.tags])
            if own := [k for k in own if not inner[self.parents[k]]]:
                return own
        best = 0
        for k in range(1, len(self.weights)):  # parents come before their children
            if self.parents[k] == best and self.weights[k] and self.weights[k] == self.weights[best]:
                best = k
        return [best] if self.weights[best] else []

    def _texts(self, chosen: list[int]) -> list[str]:
        """The blocks below some containers, and the first-level headings before articles."""
        inside = self._below([k in chosen for k in range(len(self.paths))])
        articles = any(self.tags[k] in ("main", "article") for k in chosen)
        first = next((i for i, b in enumerate(self.blocks) if inside[b[1]]), 0)
        return [b[0] for i, b in enumerate(self.blocks) if inside[b[1]] or articles and b[3] and i < first]

    def beside(self) -> list[tuple[str, int, list[int]]]:
        """(path, hash of its text, its blocks) of the containers that stand side by side in the candidate."""
        chosen = self.candidates()
        if len(chosen) != 1 or self.tags[chosen[0]] in ("main", "article"):
            return []
        owner = list(range(len(self.paths)))  # the candidate's child that each container stands in
        for k in range(1, len(owner)):
            owner[k] = k if self.parents[k] == chosen[0] else owner[self.parents[k]]
        groups: dict = {}
        for i, b in enumerate(self.blocks):
            k = owner[b[1]]
            if k and self.parents[k] == chosen[0] and self.tags[k] in ("div", "section", "center"):
                groups.setdefault(k, []).append(i)
        return [(self.paths[k], digest("\n".join(self.blocks[i][0] for i in at)), at) for k, at in groups.items()]

    def text(self, path: str | None, repeated: frozenset = frozenset()) -> str:
        """The main text, by a host's winning path and the texts that repeat on it."""
        gone = {i for own, key, at in (self.beside() if repeated else ()) if key in repeated for i in at}
        if gone and len(gone) < len(self.blocks):
            self.blocks = [b for i, b in enumerate(self.blocks) if i not in gone]
            self.weights = self._weigh()
        chosen = self.candidates()
        if not chosen:  # nothing but links
            return "\n".join(b[0] for b in self.blocks)
        on_path = [k for k, p in enumerate(self.paths) if p == path and self.weights[k]] if path else []
        if on_path and self.tags[chosen[0]] not in ("main", "article") and sum(self.weights[k] for k in on_path) == self.weights[0]:
            chosen = on_path
        return "\n".join(self._texts(chosen))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_votes(pages: DataFrame, html: str, host) -> DataFrame:
    """(host, path, weight, page, beside): every page's candidate path, and a digest of the page's
    text; with beside, the digest of the text of a container that stands beside others, on ``path``."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py() or "")
                chosen = page.candidates()
                if chosen:
                    whole = digest("\n".join(b[0] for b in page.blocks))
                    best = max(chosen, key=page.weights.__getitem__)
                    rows.append((host, page.paths[best], page.weights[best], whole, None))
                    rows.extend((host, path, 0, whole, key) for path, key, _ in page.beside())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "path", "weight", "page", "beside"])

    return pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(
        vote, "host string, path string, weight long, page long, beside long")


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path most pages of a host vote for; of equals that with more text,
    then the last in byte order."""
    counted = votes.filter("beside IS NULL").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("weight").alias("weight"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "weight", "path")).alias("path"))


def repeated_texts(votes: DataFrame) -> DataFrame:
    """(host, repeated): digests of the texts that most of a host's different pages with their path hold
    on it, ``REPEATED`` or more; a path has one such text at most."""
    seen = votes.filter("beside IS NOT NULL").select("host", "path", "beside", "page").distinct()
    own = seen.groupBy("host", "path", "beside").agg(F.count("*").alias("n"))
    every = seen.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    return (own.filter(F.col("n") >= REPEATED).join(every, ["host", "path"]).filter("2 * n > pages")
            .groupBy("host").agg(F.sort_array(F.collect_set("beside")).alias("repeated")))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``."""
    host, _ = host_and_path(F.col(url))
    votes = write_table(page_votes(pages, html, host))
    winners = write_table(winning_paths(votes).join(repeated_texts(votes), "host", "left"))

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sources, paths, repeated in batches:
            yield pa.array([Page(s.as_py() or "").text(p.as_py(), frozenset(r.as_py() or ())) for s, p, r in zip(sources, paths, repeated)], pa.string())

    own, path, again = fresh(pages, "__host", "__path", "__repeated")
    joined = pages.withColumn(own, host).join(winners.toDF(own, path, again), own, "left")
    return joined.withColumn(text, extract(F.col(html), F.col(path), F.col(again))).drop(own, path, again)
