"""Main text of web pages by consensus of the pages of a host.

Pass one reads every page and scores its containers (text outside links and boilerplate); the best one votes for its path, tags and classes
with the digits taken out, under the host of the page. Spark sums the votes per host and path. Pass two reads the pages again and takes the
containers on the host's winning path; a page without such a container falls back to its own best one.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import slices

BROADCAST_BYTES = 8 << 20  # winners are sent to every task only up to this measured size; beyond it they are joined by a shuffle
LEAST_SHARE = 0.25  # of the own best path's unlinked text, below which the winning path is not used on a page

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp".split())
SKIP = RAW | frozenset("head nav header footer aside form button select option menu dialog fieldset label canvas audio video".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address hr br "
    "details summary center".split()) | SKIP
CONTAINER = frozenset("article main section div td body".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br"} - {"html", "body"}
# Words in a class, id or role that mark what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|"
    r"header|masthead|footer|foot|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|"
    r"comment-list|disqus|respond|replies|reply|discussion|share|sharing|social|related|recommended|recommendations|widget|toolbar|pagination|pager|"
    r"contentinfo|complementary|search|hidden|sr-only|skip)(?:$|[\s_-])", re.I)
KEEP = re.compile(r"(?:^|[\s_-])(?:article|content|post|story|entry|body|main|text)(?:$|[\s_-])", re.I)


class Node:
    """An open element: its generalised path, whether it is left out, and what it has gathered if it is a container."""

    __slots__ = ("tag", "path", "skip", "start", "linked", "link_from", "index")

    def __init__(self, tag: str, path: str, skip: bool, start: int, index: int):
        self.tag, self.path, self.skip, self.start, self.index = tag, path, skip, start, index
        self.linked = 0


def _mark(tag: str, attributes: str) -> tuple[str, bool]:
    """(step of the path, whether the element is boilerplate)."""
    if not attributes or not attributes.strip():
        return tag, tag in SKIP
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    skip = tag in SKIP or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if not skip and names and tag not in ("html", "body", "main", "article") and BOILERPLATE.search(names) and not KEEP.search(found.get("class", "")):
        skip = True
    if not skip and tag == "article" and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I):
        skip = True
    classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()))
    return f"{tag}.{classes}" if classes else tag, skip


def parse(page: str) -> tuple[list[str], list[tuple[str, int, int, int]]]:
    """(pieces, containers): text pieces in page order with block borders as one space, and (path, first piece, last piece, score) of each container.

    Only text outside boilerplate becomes a piece. Scripts and other raw elements end at their own end tag only; unclosed elements end with
    their parent, truncated markup with the page.
    """
    pieces: list[str] = []
    containers: list[tuple[str, int, int, int]] = []
    stack: list[Node] = [Node("", "", False, 0, 0)]
    own = [0]  # characters outside links, by depth, counted in the open containers
    links = 0
    at, end = 0, len(page)

    def text(raw: str) -> None:
        top = stack[-1]
        if not top.skip and raw:
            value = entities.unescape(raw) if "&" in raw else raw
            pieces.append(value)
            if not links:
                own[0] += len(value) - value.count(" ")

    def close() -> None:
        nonlocal links
        node = stack.pop()
        if node.tag == "a":
            links -= 1
        if node.tag in BLOCK:
            pieces.append(" ")
        if node.tag in CONTAINER and not node.skip:
            containers.append((node.path, node.start, len(pieces), own[0] - node.linked))

    while at < end:
        opening = page.find("<", at)
        if opening < 0:
            text(page[at:])
            break
        token = TOKEN.match(page, opening)
        if token is None:
            text(page[at:opening + 1])
            at = opening + 1
            continue
        if opening > at:
            text(page[at:opening])
        at = token.end()
        slash, name, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if name is None:
            continue
        tag = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        close()
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK and stack[depth].tag not in CLOSES:
                    break  # an inline end tag never closes a block above it
            continue
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, {"p"})
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends or (stack[depth].tag == "p" and tag in ENDS_P):
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in BLOCK:
            pieces.append(" ")
        if tag in VOID:
            continue
        step, skip = _mark(tag, attributes or "")
        top = stack[-1]
        node = Node(tag, f"{top.path}>{step}" if top.path else step, skip or top.skip, len(pieces), len(stack))
        node.linked = own[0]
        if tag in RAW:
            finish = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = finish.end() if finish else end
            pieces.append(" ")
            continue
        if (attributes or "").rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            links += 1
        stack.append(node)
    while len(stack) > 1:
        close()
    return pieces, containers


def weight(path: str, score: int) -> float:
    """Score of a container: its unlinked characters, with a bonus for article-like elements and a malus for wide wrappers."""
    last = path.rpartition(">")[2]
    tag = last.split(".")[0]
    factor = {"article": 2.0, "main": 1.5, "body": 0.6}.get(tag, 1.0)
    if tag in ("div", "section", "td") and KEEP.search(last.replace(".", " ")):
        factor = 1.7
    return score * factor + path.count(">") * 1e-3


def gathered(pieces: list[str], first: int, last: int) -> str:
    return " ".join("".join(pieces[first:last]).split())


def best_path(containers: list[tuple[str, int, int, int]]) -> tuple[str, float] | None:
    """The path of the page's best container and its weight; containers on one path count together."""
    if not containers:
        return None
    totals: dict[str, float] = {}
    for path, _, _, score in containers:
        totals[path] = totals.get(path, 0.0) + weight(path, score)
    return max(totals.items(), key=lambda x: (x[1], x[0]))


def extract(page: str, winner: str | None) -> str:
    """Text of the containers on `winner`, in page order and without counting nested ones twice.

    The page's own best path stands in where the page has no such container, or where these hold less than LEAST_SHARE of what the own
    best path holds: then the host uses that path for something else on this page.
    """
    pieces, containers = parse(page)
    chosen = [c for c in containers if c[0] == winner] if winner else []
    own = best_path(containers)
    if chosen and own and own[0] != winner and sum(c[3] for c in chosen) < LEAST_SHARE * sum(c[3] for c in containers if c[0] == own[0]):
        chosen = []
    if not chosen:
        if own is None:
            return gathered(pieces, 0, len(pieces))
        chosen = [c for c in containers if c[0] == own[0]]
    out, done = [], 0
    for _, first, last, _ in sorted(chosen, key=lambda c: (c[1], -c[2])):
        if first >= done:
            out.append(gathered(pieces, first, last))
            done = last
    return " ".join(x for x in out if x)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes: the summed weights of the best container of every page with a host; combined in each task before the shuffle."""

    def run(batches):
        for batch in slices(batches):
            totals: dict[tuple[str, str], float] = {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                if page and host and (found := best_path(parse(page)[1])):
                    totals[host, found[0]] = totals.get((host, found[0]), 0.0) + found[1]
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in totals], pa.string()), "path": pa.array([k[1] for k in totals], pa.string()), "votes": pa.array(totals.values(), pa.float64())})

    return (pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string, votes double")
            .groupBy("host", "path").agg(F.sum(F.round("votes", 3).cast("decimal(28,3)")).alias("votes")))


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most votes, ties to the smaller text."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return votes(pages).withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one space. A null or
    empty page, or one without text, gives the empty text; a page without a readable host takes no part in votes and gets its own best path; repeated rows give repeated
    results; an empty table gives none; other columns are ignored.
    """
    from courierworks.llm.common import stage

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winning = stage(winners(named))
    size = winning.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def rows(batch, paths):
        texts = [extract(page, path) if page else "" for page, path in zip(batch.column("html").to_pylist(), paths)]
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    if size <= BROADCAST_BYTES:
        known = {r.host: r.path for r in winning.collect()}

        def run(batches):
            for batch in slices(batches, 2):
                yield rows(batch, [known.get(host_of(u)) for u in batch.column("url").to_pylist()])

        return named.mapInArrow(run, schema)

    def hosted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "html": batch.column(2), "host": pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())})

    def joined(batches):
        for batch in slices(batches, 2):
            yield rows(batch, batch.column("path").to_pylist())

    with_host = named.mapInArrow(hosted, "page_id long, url string, html string, host string")
    return with_host.join(winning, "host", "left").select("page_id", "url", "html", "path").mapInArrow(joined, schema)
