"""HTML extraction with a site style tree.

The pages of a host are merged by element paths (tag and marking attributes). A branch of that tree
that holds text is worth as much as its presentation and content vary between pages: a menu is laid
out and worded alike on all of them, an article is not. Branches below a threshold are removed from
each page; an inner branch is worth what its best one is, so it never takes a good one with it.
Copies of a page count as one page. All pages take part, with or without ``article`` and ``main``.

What HTML itself marks is a prior: ``nav``, ``footer``, ``aside``, forms, adverts, comments and the
like go; of a page with ``article`` or ``main`` all else goes, and what is inside goes only at a
lower importance.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ruleloom.llm.common import staged

#: Branches of fewer pages are not judged by entropy; others go below this importance.
LEAST_PAGES = 8
THRESHOLD = 0.6
#: The same inside ``article`` and ``main``, which speak for the branch.
MAIN_THRESHOLD = 0.3
#: Weight of a branch's content against its presentation.
DAMPING = 0.9
#: Up to this size the table of removed branches is broadcast; beyond it is joined by host.
BROADCAST_BYTES = 16 << 20

RAW = "script style title textarea template xmp iframe noembed noframes noscript".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
}
WORTHLESS_TAGS = frozenset("head nav footer aside form menu dialog svg math select button object canvas audio video".split())
WORTHLESS_MARKS = frozenset(
    "ad ads adsense advert advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu"
    " breadcrumb breadcrumbs masthead footer cookie cookies consent notice newsletter subscribe signup popup modal comment comments"
    " disqus replies related recommended share sharing social login complementary contentinfo search hidden".split()
)
OUTSIDE_MARKS = frozenset(["header", "banner"])
MAIN_TAGS = frozenset(["article", "main"])
MAIN_MARKS = frozenset(["articlebody"])

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|itemprop|hidden|aria-hidden)(?![\w:.-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for t in RAW}

#: One text block: its text, the hashed paths of its branches, whether it is worthless, and main.
Block = tuple[str, tuple[int, ...], bool, bool]


def _marks(attrs: str) -> tuple[set[str], set[str]]:
    """Whole marking tokens, and the words in them, of which paths are made."""
    found: set[str] = set()
    words: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attrs):
        value = "".join(values).lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            found.add("hidden")
            words.add("hidden")
        elif name.lower() != "aria-hidden":
            found.update(value.split())
            words.update(re.findall(r"[^\W\d_]+", value))
    return found, words


def parse(page: str | None) -> list[Block]:
    """Text blocks of a page in order.

    Tags that HTML lets one leave open are closed by what follows; a closing tag without an opening
    one is ignored; a page may end anywhere. Inline tags do not end a block. A name (class, id, role)
    makes an element worthless unless an ``article`` or ``main`` lies in it; one inside another
    ``article``, as comments are, or itself named so, saves nothing.
    """
    page = page or ""
    found: list[tuple[str, tuple[int, ...], bool, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    # tag, hashed path, worthless, main, numbers of the elements around that their names make worthless
    stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [("", 0, False, False, ())]
    names = 0
    saved: set[int] = set()

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((text, tuple(n[1] for n in stack[1:]), *stack[-1][2:]))

    at = 0
    for token in iter(lambda: _TOKEN.search(page, at), None):
        parts.append(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["close"] or token["close2"]:
            if tag in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                flush()
                del stack[depth:]
            continue
        if tag in _END:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1][0] == "p":
                stack.pop()
            while stack[-1][0] in CLOSES.get(tag, ()):
                stack.pop()
        if tag in VOID or not (tag in BLOCKS or tag in WORTHLESS_TAGS):
            continue
        flush()
        attrs = token["attrs"] or ""
        marks, words = _marks(attrs) if attrs else (set(), set())
        _, path, worthless, main, named = stack[-1]
        opens = tag in MAIN_TAGS or bool(marks & MAIN_MARKS)
        main = main or opens
        if tag not in ("html", "body"):
            worthless = worthless or tag in WORTHLESS_TAGS or (not main and tag == "header")
            if marks & WORTHLESS_MARKS or (not main and marks & OUTSIDE_MARKS):
                names += 1
                named = (*named, names)
            elif opens and not any(n[0] == "article" for n in stack):
                saved.update(named)
        path = xxh64_intdigest(f"{path} {tag} {' '.join(sorted(words))}") >> 1
        stack.append((tag, path, worthless, main, named))
    parts.append(page[at:])
    flush()
    return [(text, paths, worthless or not saved.issuperset(named), main) for text, paths, worthless, main, named in found]


def host_of(url: str) -> Column:
    """Lower-case host of a URL column; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _branches(blocks: list[Block]) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """Signature of a page's text, and (path, kind, value, main) of its branches that hold text.

    Kind 0 is the branch's shape, 1 a text of its own. The signature is of the text in ``article``
    and ``main`` if there is any, else of all: pages with the same one are copies.
    """
    own = [b for b in blocks if not b[2]]
    inner: dict[int, list[int]] = {}
    texts: set[tuple[int, int, int, bool]] = set()
    for text, paths, _, main in own:
        for path, below in zip(paths or (0,), (*paths[1:], 0), strict=True):
            shape = inner.setdefault(path, [])
            if shape[-1:] != [below]:
                shape.append(below)
        texts.add((paths[-1] if paths else 0, 1, xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1, main))
    shapes = {(path, 0, xxh64_intdigest(repr(inner[path])) >> 1, main) for path, _, _, main in texts}
    signed = [b for b in own if b[3]] or own
    return xxh64_intdigest("\0".join(b[0] for b in signed).encode("utf-8", "surrogatepass")) >> 1, sorted(texts | shapes)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, main, n_pages, presentation, content, importance) of each branch that holds text of its own.

    Presentation is the entropy of the shapes (sequences of inner branches) that the branch takes
    on its host's pages, content one less the mean entropy of its texts over the pages, both with
    the number of pages as base. Copies count as one page, the one whose branches come first in
    order. ``main`` tells branches inside ``article`` or ``main``. Branches without text of their
    own are as good as their best inner one and need no row.
    """
    kind = "array<struct<path:bigint,kind:int,value:bigint,main:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("main", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [_branches(parse(page)) for page in part.column(1).to_pylist()]
                rows = [[dict(zip(("path", "kind", "value", "main"), b, strict=True)) for b in branches] for _, branches in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array(rows, branch)], names=["host", "copy", "branches"])

    seen = pages.select(host_of("url").alias("host"), "html").mapInArrow(run, f"host string, copy long, branches {kind}")
    once = seen.groupBy("host", "copy").agg(F.min("branches").alias("branches"))
    each = once.select("host", F.explode("branches").alias("b")).select("host", "b.*")
    counted = each.groupBy("host", "path", "main", "kind", "value").agg(F.count("*").alias("n"))
    shape = F.col("kind") == 0
    sums = counted.groupBy("host", "path", "main").agg(
        F.sum(F.when(shape, F.col("n"))).alias("n_pages"),
        F.sum(F.when(shape, F.col("n") * F.log("n"))).alias("shapes"),
        F.avg(F.when(~shape, F.log("n"))).alias("texts"),
    )
    base = F.log(F.greatest("n_pages", F.lit(2)))
    presentation = F.when(F.col("n_pages") == 1, 1.0).otherwise((F.log("n_pages") - F.col("shapes") / F.col("n_pages")) / base)
    content = F.when(F.col("n_pages") == 1, 1.0).otherwise(1 - F.col("texts") / base)
    return sums.select("host", "path", "main", "n_pages", presentation.alias("presentation"), content.alias("content")).withColumn(
        "importance", (1 - DAMPING) * F.col("presentation") + DAMPING * F.col("content")
    )


def main_texts(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, main_threshold: float = MAIN_THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page.

    Branches that HTML marks as something else go, and those whose importance on their host is
    below ``threshold``, or below ``main_threshold`` inside ``article`` and ``main``; of a page with
    one of these, what is outside goes, too. White space in a
    block becomes one space, blocks are joined by one. A null or empty page has an empty text; a
    null or odd URL counts to the host without a name. Repeated rows come once each; an empty table
    gives an empty result; other columns are ignored.
    """
    low = style_tree(pages).where((F.col("n_pages") >= least_pages) & (F.col("importance") < F.when(F.col("main"), main_threshold).otherwise(threshold)))
    gone = staged(low.groupBy("host").agg(F.collect_set("path").alias("gone")))
    size = gone.agg(F.sum(F.length("host") + 8 * F.size("gone") + 64)).first()[0] or 0
    sized = F.broadcast(gone) if size <= BROADCAST_BYTES else gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for page, removed in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    blocks = [b for b in parse(page) if not b[2]]
                    less = frozenset(removed or ())
                    marked = [b for b in blocks if b[3]] or blocks
                    texts.append(" ".join(b[0] for b in marked if (b[1][-1] if b[1] else 0) not in less))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    joined = own.join(sized, "host", "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
