"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text below them, and the page votes for the generalised tag-class
path of its best one. Votes are counted per host in Spark; then pages whose own path isn't their host's winning one
are extracted again with that, so that pages agree on where the text lies even where one alone would mislead.

What a class, id or role says about an element is evidence, no verdict: it only counts by its head noun (share-price
is a price, footer-links are a footer), and an element that holds nearly all of a page's text stays whatever its name.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .url_filter import url_host
from .workspace import fields, table, written

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

#: Elements whose content is no markup, elements without content, and elements that are never part of the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | set("head nav footer aside noscript template svg button select option dialog menu object canvas audio video".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article blockquote body center div main section table td".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What the start of an element ends: an open element of these, if none of the others is open in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Head nouns of class, id or role that mark what isn't the article, and those that readers' comments go by.
AWAY = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer foot sidebar aside rail widget widgets cookie cookies "
    "consent gdpr notice notices banner popup modal overlay ad ads advert adverts advertisement advertisements advertising "
    "adsense sponsor sponsored promo promotion share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search form pagination pager toolbar copyright contentinfo complementary dialog hidden".split()
)
COMMENTS = set("comment comments commentlist disqus replies reply respond responses".split())
#: Words after a head noun that only tell what kind of element it is.
KIND = set(
    "area bar block body box button buttons column container content group holder icon icons inner item items left link links "
    "list main module outer overlay panel right row section slot text title top bottom unit wrap wrapper".split()
)
#: A class with such a word tells about a page's layout, as in has-sidebar.
ABOUT = {"has", "no", "with", "without"}
#: A container takes over from the one around it with this share of its text, and a wrapper or an element with a name
#: of AWAY stays with this share of the page's.
SHARE = 0.8


def _head(name: str) -> str | None:
    """The head noun of a class, id or role, as ad of top-ad-slot0."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if ABOUT & set(words):
        return None
    while len(words) > 1 and words[-1] in KIND:
        words.pop()
    return words[-1] if words else None


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, str]:
    """(generalised label, what it may be): "" for text, "away" for what never is the article, "comments" for what
    readers wrote, "header" for what is one in an article only, "maybe" for what isn't the article unless it wraps it."""
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    classes = sorted({re.sub(r"\d+", "0", c.lower()) for c in found.get("class", "").split()})
    label = ".".join([tag, *classes])
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))
    if tag in ("html", "body", "main"):
        return label, ""
    if hidden or tag in DROPPED:
        return label, "away"
    heads = {_head(c) for k in ("class", "id", "role") for c in found.get(k, "").lower().split()}
    if heads & COMMENTS:
        return label, "comments"
    if tag == "header" or heads & {"header", "masthead"}:
        return label, "header"
    return label, "maybe" if tag == "form" or (tag != "article" and heads & AWAY) else ""


class Page:
    """The blocks of a page and the containers they lie in."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, container, running characters
        self.parents, self.paths, self.tags, self.kinds = [-1], [""], [""], [""]
        self._read(source)
        self._judge()

    def _sums(self) -> list[int]:
        scores = [0] * len(self.parents)
        for _, k, n in self.blocks:
            scores[k] += n
        for k in range(len(self.parents) - 1, 0, -1):
            scores[self.parents[k]] += scores[k]
        return scores

    def _judge(self) -> None:
        """Drop what isn't the article: comments and what may be away, but for that which holds nearly all the text."""
        scores, n = self._sums(), len(self.parents)
        last = list(range(n))  # the last container inside each one; containers are in page order
        for k in range(n - 1, 0, -1):
            last[self.parents[k]] = max(last[self.parents[k]], last[k])
        articles = [k for k, tag in enumerate(self.tags) if tag in ("article", "main")]
        gone, within = [False] * n, [tag in ("article", "main") for tag in self.tags]
        for k in range(1, n):
            kind, inner = self.kinds[k], within[self.parents[k]]
            within[k] = within[k] or inner
            gone[k] = gone[self.parents[k]] or kind == "comments"
            if kind in ("maybe", "header") and not gone[k]:
                alone = not articles or (k <= articles[0] and articles[-1] <= last[k])
                wraps = alone and not inner and scores[k] >= SHARE * scores[0]
                gone[k] = not (wraps or (kind == "header" and inner))
        self.blocks = [b for b in self.blocks if not gone[b[1]]]
        self.gone, self.scores = gone, self._sums()

    def _path(self, parent: str, label: str) -> str:
        if len(parent) > 400:  # a deep path goes on from its digest
            parent = "~" + hashlib.md5(parent.encode()).hexdigest()
        return f"{parent}>{label}"

    def _read(self, source: str) -> None:
        stack = [("", "", 0, False)]  # open elements: (tag, path, container, dropped)
        text: list[str] = []
        linked = links = 0
        position = 0

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.blocks.append((words, stack[-1][2], max(0, len(words) - 2 * linked)))
                text.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal links
            links -= sum(tag == "a" for tag, *_ in stack[depth:])
            del stack[depth:]

        def say(run: str) -> None:
            nonlocal linked
            if stack[-1][3]:
                return
            if "&" in run:
                run = html.unescape(run)
            text.append(run)
            if links:
                linked += len(run)

        while True:
            found = MARKUP.search(source, position)
            if found is None:
                say(source[position:])
                flush()
                return
            if found.start() > position:
                say(source[position : found.start()])
            position = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, ending, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
            if tag == "br":
                say(" ")
                continue
            if tag in BLOCKS:
                flush()
            if ending:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        if any(x[0] in BLOCKS for x in stack[depth:]):
                            flush()
                        close(depth)
                        break
                    if stack[depth][0] in ("td", "th", "table") and tag not in BLOCKS:
                        break
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, position)
                position = len(source) if end is None else end.start()
                if not attributes.endswith("/") or end is not None:
                    skip = source.find(">", position)
                    position = len(source) if skip < 0 else skip + 1
                continue
            if tag in VOID:
                continue
            if tag in BLOCKS:  # a block ends an open paragraph or heading, and list items and cells end their like
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in BLOCKS:
                        break
            if tag in ENDS:
                ended, limits = ENDS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in limits:
                        break
                    if stack[depth][0] in ended:
                        close(depth)
                        break
            label, kind = _element(tag, attributes)
            _, path, container, dropped = stack[-1]
            path = self._path(path, label)
            dropped = dropped or kind == "away" or (kind != "" and tag not in BLOCKS)
            if not dropped and (tag in CONTAINERS or kind):
                self.parents.append(container)
                self.paths.append(path)
                self.tags.append(tag)
                self.kinds.append(kind)
                container = len(self.parents) - 1
            links += tag == "a"
            stack.append((tag, path, container, dropped))

    def best(self) -> int:
        """The container of the article: down from the page while one child has most of the text, up to an article."""
        children: dict[int, list[int]] = {}
        for k in range(1, len(self.parents)):
            if not self.gone[k]:
                children.setdefault(self.parents[k], []).append(k)
        now = 0
        while self.tags[now] != "article":
            below = max(children.get(now, []), key=lambda k: self.scores[k], default=None)
            articles = [k for k in children.get(now, []) if self.tags[k] in ("article", "main")]
            if articles:
                below = max(articles, key=lambda k: self.scores[k])
            if below is None or self.scores[below] <= 0 or (not articles and self.scores[below] < SHARE * self.scores[now]):
                break
            now = below
        return now

    def vote(self) -> tuple[str, int] | None:
        """(path, score) of the best container; None for a page without running text."""
        k = self.best()
        return (self.paths[k], self.scores[k]) if self.scores[k] > 0 and self.paths[k] else None

    def text(self, path: str | None = None) -> str:
        """The blocks in the containers with this path, or in the page's own best one where it has none."""
        chosen = self._inside([k > 0 and self.paths[k] == path for k in range(len(self.parents))]) if path else []
        if not chosen:
            best = self.best()
            chosen = self._inside([k == best for k in range(len(self.parents))])
        return "\n".join(chosen)

    def _inside(self, chosen: list[bool]) -> list[str]:
        for k in range(1, len(self.parents)):
            chosen[k] = chosen[k] or chosen[self.parents[k]]
        return [words for words, k, _ in self.blocks if chosen[k]]


_OWN = "path string, score bigint, text string"


def own_texts(pages: DataFrame) -> DataFrame:
    """Rows (mark, key, url, host, html) -> the same without html, and each page's own vote (path and score, null
    without running text) and the text that lies there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores, texts = [], [], []
            for source in batch.column(4).to_pylist():
                page = Page(source or "")
                path, score = page.vote() or (None, None)
                paths.append(path)
                scores.append(score)
                texts.append(page.text(path))
            arrays = [*batch.columns[:4], pa.array(paths, pa.string()), pa.array(scores, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["mark", "key", "url", "host", "path", "score", "text"])

    kind = pages.schema["key"].dataType.simpleString()
    return pages.select("mark", "key", "url", "host", "html").mapInArrow(run, f"mark bigint, key {kind}, url string, host string, {_OWN}")


def host_paths(votes: DataFrame) -> DataFrame:
    """Rows (host, path, score), one per page -> (host, winner): most pages win, then most text, then the greater path by
    order. Votes are summed before they move."""
    summed = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("chars"))
    return summed.groupBy("host").agg(F.max(F.struct("pages", "chars", "path")).alias("best")).select("host", F.col("best.path").alias("winner"))


#: Parts that a host's rows are spread over where hosts are joined by shuffle.
SALTS = 32


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    A null or empty page, or one without text, gives an empty text. White space in a block becomes one space, blocks
    are joined by \\n in page order, and nothing of the article is cut, however long the page is. Repeated pages are
    kept, pages without a url are one host of their own. Of paths with equally many votes that with more text wins, then
    the greater one by order.

    Pages are parsed once, and again only where their host's path is another than their own. Html is never shuffled
    but for such pages, if they are too many for a broadcast of their numbers; texts are only if there are too many
    hosts for one, spread over salts then, so that one large host isn't one task.
    """
    rows = fields(pages, key=key, url=url, html=source).withColumns({"host": url_host(F.col("url")), "mark": F.xxhash64("key", "url", "html")})
    own = written(own_texts(rows), "own_texts")
    winners = written(host_paths(own), "host_paths")
    if workspace.small(winners):
        joined = own.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    agrees = F.col("winner").isNull() | F.coalesce(F.col("winner") == F.col("path"), F.lit(False))
    same = joined.where(agrees).select("key", "url", "text")
    other = written(joined.where(~agrees).select("mark", "winner").distinct(), "other_paths")
    again = rows.join(F.broadcast(other) if workspace.small(other) else other, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s or "").text(p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    found = same.unionByName(again.select("key", "url", "html", "winner").mapInArrow(run, f"key {kind}, url string, text string"))
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
