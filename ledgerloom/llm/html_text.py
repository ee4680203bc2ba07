"""Main text of web pages: subtrees that a host repeats on many of its pages go, then what an element's own markup rules out."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without, written

ADDED = ("text", "n_chars", "n_template")

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg canvas".split())
#: Elements that are never main text.
DROPPED = frozenset("aside button datalist dialog footer head menu nav object optgroup option search select".split())
#: Roles of what isn't main text.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Whole class and id names of adverts, notices, forms, menus and readers' comments.
NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment-form comment-list comments commentlist cookie-banner cookie-consent cookie-notice disqus_thread "
    "footer login-form masthead menu modal nav navbar navigation newsletter pagination popup promo related-posts respond search-form share sharing sidebar "
    "site-footer site-header skip-link social sponsored subscribe toolbar topbar widget".split()
)
#: Words of compound class and id names, as in cookie-bar or reader_comments, and beginnings of such words.
NAME_WORDS = frozenset("ad ads banner comment comments consent cookie footer menu nav navbar newsletter notice promo sidebar social sponsored".split())
NAME_STEMS = ("adsby", "advert", "breadcrumb", "cookie", "navigation")
#: Words before such a word that say an element has one beside it, or none.
NOT_ITSELF = frozenset("no has with without".split())
#: What an element's start tag ends, if it is open.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"),
}
#: Elements that such an end doesn't reach beyond.
SCOPES = frozenset("table td th article main section ul ol dl select".split())
#: An element that class, id or form tag marks is around the main text, not beside it, from this share of the page's text on.
AROUND = 0.9
#: Text outside articles stays if it is as long as this share of theirs; shorter, it is what stands around them.
BESIDE = 1 / 3
#: So many blocks in a row outside articles, each with this share of its letters in links, are a menu, unless they are most of the page.
LINKS, LINKED = 3, 0.8
#: A subtree recurs on at least so many of a host's pages, from SHARE of them or ROOT times their square root on; within articles from OWN_LEAST and OWN_SHARE.
LEAST, SHARE, ROOT = 3, 0.6, 2.0
OWN_LEAST, OWN_SHARE = 10, 0.6
#: Parts that the deletions of one very frequent subtree are dealt to.
SALTS = 16

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLEAR, MAYBE, CERTAIN = 0, 1, 2


def is_marked(name: str, in_article: bool) -> bool:
    """Whether one of the words of a class or id is that of an advert, a notice, a menu or comments; a header's only outside articles."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    if words == ["header"] or words[-1:] == ["header"] and "site" in words or words[-1:] == ["header"] and "page" in words:
        return not in_article
    return any((w in NAME_WORDS or w.startswith(NAME_STEMS)) and not (k and words[k - 1] in NOT_ITSELF) for k, w in enumerate(words))


def verdict(tag: str, rest: str, in_article: bool) -> int:
    """What an element's name and attributes say: CERTAIN that it isn't main text, MAYBE, or nothing (CLEAR)."""
    if tag in DROPPED or tag == "header" and not in_article:
        return CERTAIN
    found = MAYBE if tag == "form" else CLEAR
    for name, *values in ATTRIBUTE.findall(rest):
        name, spelled = name.lower(), "".join(values)
        value = spelled.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and HIDDEN.search(value):
            return CERTAIN
        if name == "role" and ROLES.intersection(value.split()):
            return CERTAIN
        if name in ("class", "id") and tag not in ("html", "body", "main", "article") and (NAMES.intersection(value.split()) or any(is_marked(x, in_article) for x in spelled.split())):
            found = MAYBE
    return found


class Node:
    """An open element. Marked inline elements are nodes too; other inline elements aren't.

    limit: the number of blocks at the first block (of an inline element) or article inside it. If the
    element is never ended itself, what markup says of it holds up to there.
    """

    __slots__ = ("above", "article", "block", "depth", "digest", "ended", "inline", "limit", "tag", "verdict")

    def __init__(self, tag: str, block: int, verdict: int, article: bool, inline: bool, above: Node | None):
        self.tag, self.block, self.verdict, self.article, self.inline, self.above = tag, block, verdict, article, inline, above
        self.depth, self.ended, self.limit = 1, False, None
        self.digest = None if inline else xxhash.xxh64(tag.encode("utf-8", "surrogatepass"))


#: A piece of text, the marked inline element that it is in, and whether a block began in that before.
Piece = tuple[str, Node | None, bool]


class Page:
    """A page's blocks in order, which of them its markup leaves, which of those are in articles, and the hash of each element with its blocks.

    left: not ruled out; main: of a page with text in articles those in articles, else all that are left. Of elements around the same blocks the innermost one's hash stands for all.
    """

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.main: list[bool] = []
        self.left: list[bool] = []
        self.has_article = False
        self._link = False
        self._linked: list[tuple[int, int]] = []  # letters of each block, and of those the ones in links
        self._letters = [0, 0]
        self.subtrees: list[tuple[int, int, int]] = []
        self._parts: list[list[Piece]] = []
        self._in_article: list[bool] = []
        self._dropped: list[tuple[int, int, int]] = []
        self._stack = [Node("", 0, CLEAR, False, False, None)]
        self._open: Counter[str] = Counter()
        self._marked: list[Node] = []  # open elements that an article has not begun in
        self._pieces: list[Piece] = []
        self._read(source)
        self._decide()

    def _block_node(self) -> Node:
        top = self._stack[-1]
        return top.above if top.inline else top  # a marked inline element holds no other one directly

    def _flush(self) -> None:
        if not self._pieces:
            return
        whole = " ".join("".join(p for p, _, _ in self._pieces).split())
        if whole:
            node = self._block_node()
            node.digest.update(b"\x01" + whole.encode("utf-8", "surrogatepass"))
            self._parts.append(self._pieces)
            self._in_article.append(node.article)
            self._linked.append((self._letters[0], self._letters[1]))
        self._pieces, self._letters = [], [0, 0]

    def _push(self, tag: str, found: int, article: bool, inline: bool) -> None:
        self._stack.append(Node(tag, len(self._parts), found, article, inline, self._stack[-1]))
        self._open[tag] += 1

    def _pop(self, ended: bool) -> None:
        """Close the innermost element, by its own end or by that of one around it."""
        node = self._stack[-1]
        node.ended = ended
        if not node.inline:
            self._flush()
        self._stack.pop()
        self._open[node.tag] -= 1
        if node.inline:
            if ended and node.limit is not None:
                self._dropped.append((node.verdict, node.limit, len(self._parts)))
        elif len(self._parts) > node.block:
            digest = node.digest.digest()
            self._block_node().digest.update(b"\x02" + digest)
            span = (node.block, len(self._parts))
            if not self.subtrees or self.subtrees[-1][1:] != span:  # else one inside it has the same blocks, and recurs wherever it does
                self.subtrees.append((int.from_bytes(digest, "big", signed=True), *span))
            if node.verdict:
                self._dropped.append((node.verdict, node.block, len(self._parts) if ended or node.limit is None else node.limit))

    def _pop_to(self, tag: str) -> None:
        while self._stack[-1].tag != tag or self._stack[-1].inline:
            self._pop(False)
        self._pop(True)

    def _close_first(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open element of each of the tags in turn, with what is open inside it, up to a scope's edge."""
        for tag in tags:
            if not self._open[tag]:
                continue
            for node in reversed(self._stack):
                if node.tag == tag and not node.inline:
                    self._pop_to(tag)
                    break
                if node.tag in SCOPES and node.tag not in tags:
                    break

    def _read(self, source: str) -> None:
        at = 0
        while True:
            token = TOKEN.search(source, at)
            text = source[at : token.start() if token else len(source)]
            if text:
                self._text(html.unescape(text) if "&" in text else text)
            if token is None:
                break
            at = token.end()
            tag = (token["tag"] or "").lower()
            if not tag:
                continue
            if token["end"]:
                self._end(tag)
            elif tag in RAW:
                if tag != "svg" or not token["rest"].endswith("/"):
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    at = end.start() if end else len(source)
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text(" ")
            elif tag in BLOCKS:
                self._block(tag, token["rest"])
            else:
                self._inline(tag, token["rest"])
        while len(self._stack) > 1:
            self._pop(False)
        self._flush()

    def _text(self, text: str) -> None:
        top = self._stack[-1]
        self._letters[0] += len(text)
        self._letters[1] += len(text) if self._link else 0
        self._pieces.append((text, top, top.limit is not None) if top.inline else (text, None, False))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        if tag in BLOCKS:
            if self._open[tag]:
                self._pop_to(tag)
            else:
                self._flush()
            return
        top = self._stack[-1]
        if top.inline and top.tag == tag:
            top.depth -= 1
            if not top.depth:
                self._pop(True)

    def _inline(self, tag: str, rest: str) -> None:
        if tag == "a":
            self._link = True
        top = self._stack[-1]
        if top.inline:
            top.depth += top.tag == tag
        elif rest and not rest.endswith("/") and (found := verdict(tag, rest, top.article)):
            self._push(tag, found, top.article, True)

    def _block(self, tag: str, rest: str) -> None:
        self._flush()
        if self._stack[-1].tag == "p":
            self._pop(True)
        if tag in ENDS:
            self._close_first(ENDS[tag])
        top = self._stack[-1]
        if top.inline and top.limit is None:
            top.limit = len(self._parts)
        article = tag in ("article", "main")
        found = verdict(tag, rest, top.article)
        if article and not found:
            for node in self._marked:
                node.limit = len(self._parts)
            self._marked.clear()
        self._push(tag, found, top.article or article and not found, False)
        if found:
            self._marked.append(self._stack[-1])

    def _decide(self) -> None:
        """The blocks' texts, and which of them are left."""
        sizes = [0]
        for parts in self._parts:
            kept = (p for p, node, late in parts if node is None or late and not node.ended)
            self.blocks.append(" ".join("".join(kept).split()))
        certain = outside([(a, b) for found, a, b in self._dropped if found == CERTAIN], len(self.blocks))
        for text, x in zip(self.blocks, certain):
            sizes.append(sizes[-1] + len(text) * x)
        out = outside([(a, b) for found, a, b in self._dropped if found == CERTAIN or sizes[b] - sizes[a] < AROUND * sizes[-1]], len(self.blocks))
        left = [x and bool(t) for x, t in zip(out, self.blocks)]
        menus = outside(self._menus(left), len(self.blocks))
        self.left = [x and y for x, y in zip(left, menus)]
        of_article = [x and y for x, y in zip(self.left, self._in_article)]
        self.has_article = any(of_article)
        self.main = of_article if self.has_article else self.left

    def _menus(self, left: list[bool]) -> list[tuple[int, int]]:
        """Runs of blocks outside articles that are links for the most part, and not most of what is left."""
        total, runs, begin, size = sum(len(t) for t, x in zip(self.blocks, left) if x), [], None, 0
        for k in range(len(left) + 1):
            link = k < len(left) and left[k] and not self._in_article[k] and self._linked[k][1] >= LINKED * self._linked[k][0] > 0
            if link:
                begin, size = (k, len(self.blocks[k])) if begin is None else (begin, size + len(self.blocks[k]))
            elif begin is not None and (k == len(left) or left[k]):
                if k - begin >= LINKS and 2 * size < total:
                    runs.append((begin, k))
                begin = None
        return runs


def outside(spans: list[tuple[int, int]], n: int) -> list[bool]:
    """Of n places those that no half-open span covers."""
    change = [0] * (n + 1)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return [x == 0 for x in accumulate(change[:n])]


def signed64(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(data), "big", signed=True)


def packed(lines: list[str]) -> bytes:
    """Blocks, which hold no line feed, one a line, compressed: they are written and shuffled once."""
    data = "\n".join(lines).encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "big") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[str]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "big"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")


def parsed(batches: Iterator[pa.RecordBatch], html_col: str, keep: list[str], names: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Each page once: its blocks (empty where the markup rules them out), its content's hash and its subtrees.

    The last bit of a subtree's hash says whether it holds main text of an article.
    """
    tree = pa.list_(pa.struct([("hash", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        blocks, content, subtrees = [], [], []
        for source in batch.column(html_col).to_pylist():
            page = Page(source or "")
            # The first letter of a block that is left says whether it is in an article.
            blocks.append(packed(["" if not x else ("a" if page.has_article and m else "b") + t for t, x, m in zip(page.blocks, page.left, page.main)]))
            own = [t for t, m in zip(page.blocks, page.main) if m] or page.blocks
            content.append(signed64("\n\n".join(own).encode("utf-8", "surrogatepass")))
            inside = [0]
            for m in page.main:
                inside.append(inside[-1] + m)
            subtrees.append([{"hash": h & ~1 | (page.has_article and inside[b] > inside[a]), "a": a, "b": b} for h, a, b in page.subtrees])
        columns = [*(batch.column(c) for c in keep), pa.array(blocks, pa.binary()), pa.array(content, pa.int64()), pa.array(subtrees, tree)]
        yield pa.RecordBatch.from_arrays(columns, [*keep, names["blocks"], names["content"], names["subtrees"]])


def joined_blocks(batches: Iterator[pa.RecordBatch], names: dict[str, str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The text of the blocks that are left, and how many the site's template took."""
    for batch in batches:
        texts, taken = [], []
        for data, gone in zip(*(batch.column(names[c]).to_pylist() for c in ("blocks", "gone"))):
            blocks = unpacked(data)
            left = outside([(x["a"], x["b"]) for x in gone or ()], len(blocks))
            own = [t for t, x in zip(blocks, left) if t and x]
            of_article, beside = (sum(len(t) - 1 for t in own if t[0] == kind) for kind in "ab")
            texts.append("\n\n".join(t[1:] for t in own if t[0] == "a" or beside >= BESIDE * of_article))
            taken.append(sum(1 for t, x in zip(blocks, left) if t and not x))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(taken, pa.int64())], [*keep, names["text"], names["n"]])


def least_pages(pages: Column, own: Column) -> Column:
    """On how many of a host's different pages a subtree must stand to be its template; own: it holds main text of an article."""
    anywhere = F.greatest(F.lit(LEAST), F.least(pages * SHARE, F.sqrt(pages) * ROOT))
    return F.when(own, F.greatest(F.lit(OWN_LEAST), pages * OWN_SHARE)).otherwise(anywhere)


def template_subtrees(pages: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur across a host's pages, from (host, content, subtrees).

    Pages of one content count once, so copies of one article don't make its paragraphs a template.
    Pages and their subtrees are summed by host and subtree, combined before the shuffle; a host's
    number of pages meets its subtrees in SALTS parts.
    """
    seen = pages.select("host", "content", F.explode(F.array_distinct(F.transform("subtrees", lambda s: s["hash"]))).alias("hash"))
    counts = seen.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") >= LEAST).withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    hosts = pages.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    own = F.col("hash").bitwiseAND(F.lit(1)) == 1
    return counts.join(hosts, ["host", "salt"]).filter(F.col("n") >= least_pages(F.col("pages"), own)).select("host", "hash")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The main text of each page.

    A page is parsed once into blocks of text and elements. Every element's subtree is hashed from its
    name, its texts and its children's hashes; the hashes are counted per host over pages of different
    content, and subtrees that recur on many of the host's pages (least_pages: three at least, of small
    hosts 0.6, of large ones as many as twice the root of their pages) are deleted from it. Within
    articles (or main elements) only what stands on ten pages and 0.6 of all is, as a passage that
    several articles share is theirs.

    What a page says of itself does the rest, so that single pages have a text too. Hidden elements,
    menus, asides, footers and headers outside articles go, as do elements whose role, or a word of
    whose class or id, marks an advert, a notice, a form or comments, unless nine tenths of the text
    are in them, and runs of links outside articles that aren't most of the page. Articles are taken,
    and the text beside them if, after all that, it is a third as long as theirs or more: then an
    article is a teaser or a part of the text; else what stands beside it is its page's. A marked
    inline element goes to its end tag, or if it has none up to the next block. Character references are decoded, white
    space within a block becomes one space, and blocks are joined by two line feeds in their order.

    Returns pages (columns ``keep``, all by default) with text, n_chars (code points) and n_template
    (blocks that were deleted as the site's and by nothing else); input columns of these names give way, unless they are
    the html. Null, empty or broken html and one without text give an empty text. Pages without a url
    or with a broken one share a host. A page of any length or depth is read whole, in time in
    proportion to it. Repeated rows are answered alike; an empty table gives no rows.

    The texts aren't shuffled by host: (host, subtree) pairs are joined, and what is found goes back
    to its page by a number. A subtree that is on a third of all pages is dealt to SALTS tasks.
    """
    keep = list(pages.columns) if keep is None else keep
    keep = [c for c in keep if c in without(pages, *ADDED).columns]
    n = fresh(pages, "html", "host", "row", "blocks", "content", "subtrees", "gone", "text", "n")
    host = F.xxhash64(F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST")), F.lit(""))), r"^www\.", ""))
    df = pages.select(*keep, F.col(html_col).cast("string").alias(n["html"]), host.alias(n["host"]), F.monotonically_increasing_id().alias(n["row"]))
    passed = [*keep, n["host"], n["row"]]
    kinds = {f.name: f for f in df.schema.fields}
    tree = T.StructType.fromDDL("hash long, a int, b int")
    schema = T.StructType([kinds[c] for c in passed]).add(n["blocks"], T.BinaryType()).add(n["content"], T.LongType()).add(n["subtrees"], T.ArrayType(tree))
    df = written(df.mapInArrow(lambda batches: parsed(batches, n["html"], passed, n), schema), "html-parsed")
    seen = df.select(F.col(n["host"]).alias("host"), F.col(n["content"]).alias("content"), F.col(n["subtrees"]).alias("subtrees"))
    template = written(template_subtrees(seen), "html-template")
    part = lambda salt: F.xxhash64("host", "hash", salt).alias("key")
    spots = df.select(F.col(n["row"]).alias("row"), F.col(n["host"]).alias("host"), F.explode(n["subtrees"]).alias("s")).select("row", "host", "s.*")
    spots = spots.select(part(F.pmod("row", F.lit(SALTS))), "row", "a", "b")
    template = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).select(part(F.col("salt")))
    gone = spots.join(template, "key", "left_semi").groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias(n["gone"]))
    df = df.drop(n["subtrees"], n["content"], n["host"]).join(gone.withColumnRenamed("row", n["row"]), n["row"], "left")
    schema = T.StructType([kinds[c] for c in keep]).add(n["text"], T.StringType()).add(n["n"], T.LongType())
    df = df.mapInArrow(lambda batches: joined_blocks(batches, n, keep), schema)
    return df.select(*keep, F.col(n["text"]).alias("text"), F.length(n["text"]).cast("bigint").alias("n_chars"), F.col(n["n"]).alias("n_template"))
