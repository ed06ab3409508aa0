"""Main text of web pages by consensus of their host.

Every page is cut into text blocks inside containers (div, article, table cell, ...); menus, headers
and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag or by class, on containers, blocks and inline elements. A form, or an element named
as a wrapper of something, stays where most of the page's text is in it. A page's best container is the innermost one, article and main taken
whole, outside of which there are only blocks of links; headings are text even as links. The pages
of a host vote on the generalised path of that container (tags with classes, digits dropped), votes
are summed in Spark, and each page's text is taken anew from what has the host's winning path. A
page without such a container falls back on its own best one.

Votes are partial sums before the shuffle, a row for each host and path. Where the winners are small
(measured, 32 MB at most), they go to every task and no page is shuffled; else pages meet their host's
winner in a join that Spark splits where a host is hot. A page is parsed whole in its task.

Edge cases: null or empty html, or html without text, gives an empty text; a null url, or one without
a host, votes for itself alone; broken markup (unclosed tags, quotes or comments) ends where its
parent ends or at the page's end; a very long page is parsed whole, in a few times its own size;
repeated rows each vote and each give a row; columns other than
the three named are not read; an empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Scratch, released

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|select|svg|iframe|object|button)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?</\2\s*>"
    r"|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|<[a-z][^>]*>",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[a-z]+")
_CONTAINERS = frozenset("html body div section article main table tbody thead tfoot tr td th ul ol dl center figure details form nav header footer aside dialog fieldset menu address".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote hr figcaption caption summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEFT_OUT = frozenset("nav footer aside dialog menu".split())
_FORMS = frozenset("form fieldset".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words of class names and ids that mark what is not the article.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login pagination pager widget toolbar masthead skip copyright".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that say what a page has, not what an element is: has-menu, no-sidebar.
_STATES = frozenset("no not has with without is hide hidden show js".split())
#: Words of elements around others: they may hold the article, whatever else their name says.
_AROUND = frozenset("wrap wrapper wrapped container content main layout page body outer inner".split())
CERTAIN, UNLESS_MOST = 2, 1
MOST_BROADCAST = 32 << 20


def noise_of(value: str) -> int:
    """Whether a class attribute or an id marks what is not the article: ``CERTAIN``, ``UNLESS_MOST``
    (unless most of the page's text is in it) or 0. Each name counts for itself."""
    found = 0
    for name in value.split():
        words = _PART.findall(name)
        if _STATES.isdisjoint(words):
            if not _COMMENTS.isdisjoint(words):
                return CERTAIN
            if not _NOISE.isdisjoint(words):
                found = max(found, CERTAIN if _AROUND.isdisjoint(words) else UNLESS_MOST)
    return found


class Page:
    """Blocks of a page: ``blocks`` of (text, characters outside links, container), ``parents``,
    ``paths`` and ``tags`` of its containers; container 0 is the page itself. What is not the article is
    in containers of its own while the page is read, and left out at the end."""

    __slots__ = ("blocks", "parents", "paths", "tags")

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.parents, self.paths, self.tags = [-1], [""], [""]
        noise = [0]
        stack: list[tuple[str, int]] = []  # (tag, container or -1 for inline elements that are left out)
        here, hidden, in_article = 0, 0, 0
        text: list[str] = []
        linked, in_link, heading, at = 0, False, False, 0

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((joined, max(len(joined) - linked, 0), here))
                text, linked = [], 0

        def close(until: int) -> None:
            """Close what is open down to a place of the stack."""
            nonlocal hidden, in_article, here
            while len(stack) > until:
                tag, c = stack.pop()
                if c < 0:
                    hidden -= 1
                elif tag in ("article", "main"):
                    in_article -= 1
            here = next((c for _, c in reversed(stack) if c >= 0), 0)

        for m in _TOKEN.finditer(html):
            start = m.start()
            if start > at and not hidden:
                piece = html[at:start]
                if "&" in piece:
                    piece = unescape(piece)
                text.append(piece)
                if in_link and not heading:
                    linked += len(piece.strip())
            at = m.end()
            name = m.group(4)
            if name is None:
                continue
            name, attrs, ends = name.lower(), m.group(5), bool(m.group(3))
            block, container = name in _BLOCKS, name in _CONTAINERS
            if not block:
                if name == "br":
                    text.append(" ")
                elif name == "a":
                    in_link = not ends
                if ends:
                    if hidden and stack and stack[-1] == (name, -1):
                        close(len(stack) - 1)
                elif "=" in attrs and name not in _VOID and not attrs.endswith("/") and any(noise_of((a or b or c).lower()) == CERTAIN for _, a, b, c in _CLASS.findall(attrs)):
                    hidden += 1
                    stack.append((name, -1))
                continue
            flush()
            in_link, heading = False, name in _HEADINGS and not ends
            if ends:  # an end tag closes what is open inside it; one without its start tag is ignored
                if container or (stack and stack[-1][0] == name):
                    place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                    if place is not None:
                        close(place)
                continue
            if name in _VOID or attrs.endswith("/"):
                continue
            if stack and stack[-1][0] not in _CONTAINERS and stack[-1][1] >= 0 and stack[-1][0] in ("p", name):
                close(len(stack) - 1)  # a paragraph ends where the next block begins
            classes, own = "", 0
            if container:
                own = CERTAIN if name in _LEFT_OUT or (name == "header" and not in_article) else UNLESS_MOST if name in _FORMS else 0
            if "=" in attrs:
                for k, a, b, c in _CLASS.findall(attrs):
                    value = (a or b or c).lower()
                    if name not in ("html", "body", "article", "main"):
                        own = max(own, noise_of(value))
                    if k.lower() == "class":
                        classes = ".".join(sorted(set(_DIGITS.sub("", value).split())))
            if not container and not own:
                continue
            if name in ("article", "main"):
                in_article += 1
            self.parents.append(here)
            self.paths.append(f"{self.paths[here]}/{name}{'.' + classes if classes else ''}")
            self.tags.append(name)
            noise.append(own)
            here = len(self.paths) - 1
            stack.append((name, here))
        if at < len(html) and not hidden:
            piece = html[at:]
            text.append(unescape(piece) if "&" in piece else piece)
        flush()
        self._leave_out(noise)

    def _leave_out(self, noise: list[int]) -> None:
        """Keep the blocks that no container hides."""
        if not any(noise):
            return
        gone = [x == CERTAIN for x in noise]
        for c in range(1, len(gone)):  # parents come before their containers
            gone[c] = gone[c] or gone[self.parents[c]]
        size = [0] * len(gone)
        for _, n, c in self.blocks:
            if not gone[c]:
                size[c] += n
        for c in range(len(size) - 1, 0, -1):
            size[self.parents[c]] += size[c]
        for c in range(1, len(gone)):
            gone[c] = gone[c] or gone[self.parents[c]] or (noise[c] == UNLESS_MOST and 2 * size[c] <= size[0])
        self.blocks = [x for x in self.blocks if not gone[x[2]]]

    def best(self) -> tuple[str, int]:
        """Path of the best container, and its characters outside links: from the page down as long
        as one container holds all blocks but those that are mostly links, to article or main at
        most."""
        score, content = [0] * len(self.paths), [0] * len(self.paths)
        for t, n, c in self.blocks:
            score[c] += n
            if 2 * n > len(t):
                content[c] += n
        for c in range(len(score) - 1, 0, -1):  # parents come before their containers
            score[self.parents[c]] += score[c]
            content[self.parents[c]] += content[c]
        inner: dict[int, int] = {}
        for c in range(1, len(score)):
            p = self.parents[c]
            if p not in inner or content[c] > content[inner[p]]:
                inner[p] = c
        c = 0
        while c in inner and self.tags[c] not in ("article", "main") and content[inner[c]] == content[c] > 0:
            c = inner[c]
        return self.paths[c], score[c]

    def text(self, path: str | None) -> str:
        """Blocks inside containers with ``path``, in page order; of the best container if none has
        it."""
        for p in (path, None):
            p = self.best()[0] if p is None else p
            inside = [not p] * len(self.paths)
            for c in range(len(self.paths)):
                inside[c] = inside[c] or self.paths[c] == p or (c > 0 and inside[self.parents[c]])
            found = [t for t, _, c in self.blocks if inside[c]]
            if found:
                return "\n\n".join(found)
        return ""


def host_of(url):
    """Lower-case host of a URL column, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): the winning path of each host, by votes, then by characters, then by
    path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Page(x or "").best() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).where("host <> ''").mapInArrow(released(vote), "host string, path string, chars long")
    votes = votes.where("chars > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "chars", "path")).alias("won")).select("host", "won.path", "won.votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    scratch = Scratch(pages.sparkSession, "hosts")
    won = scratch.table(host_paths(pages, url, html).select("host", F.col("path").alias("_path")), "won")
    size = won.agg(F.coalesce(F.sum(F.length("host") + F.length("_path") + 16), F.lit(0)).alias("n")).first().n
    rows = pages.select(F.col(id_col), F.col(url), F.col(html).cast("string").alias("_html"), host_of(F.col(url)).alias("host"))
    # Measured: small enough to go to every task, so no page moves; else a join that can be split.
    rows = rows.join(F.broadcast(won) if size <= MOST_BROADCAST else won, "host", "left").select(id_col, url, "_path", "_html")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(x or "").text(p) for p, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url, "text"])

    return rows.mapInArrow(released(take), T.StructType([pages.schema[id_col], pages.schema[url], T.StructField("text", T.StringType())]))


# ---------------------------------------------------------------- query


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLE_SQL: dict[str, str] = {}
