"""Main text of web pages by tag-path ratios.

Every text node belongs to a root-to-leaf tag path (tags and class, id and role tokens). A page's text length,
punctuation and nodes are summed by path and by every path above; a path's ratio is its text a node times
its punctuation a node. A block (paragraph, heading, list item, ...) gets the ratios of its nodes, weighted
by length; the blocks' ratios are smoothed over their neighbours in page order and fused with what the
elements around say: navigation, forms and the like count nothing, article and main more.

Names only scale: a token whose parts all tell of boilerplate (comment-list, but neither has-sidebar
nor social-history) takes an element's weight away unless it holds most of the page's weight or an article;
only reader comments go at any size. Blocks over the threshold vote for the smallest section that holds most
of their weight; outside article and main it widens to the lowest element around all blocks of prose (with punctuation, and
MEDIAN_SHARE of such blocks' median length or PROSE characters long), since one long block outweighs many
short ones. In the section each named element (class or id) whose path's ratio is under the threshold goes with all that it holds,
and so do list items that are links; the rest is the text.

The parser is lenient: unclosed and crossing tags, raw-text elements, comments and a cut end.
Null or empty html, or no content: empty text. Pages stand alone: no shuffle, repeated rows and
equal ids give a row each, other columns are not read. Whole pages are read, nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from statistics import median_high

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import read_table, slices, tune

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|textarea|iframe|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("html body main article section div td center blockquote".split())
#: Elements and name words of what is not the text; words that may stand beside those in a token; words of the text.
NOT_TEXT_TAGS = frozenset("head nav footer aside form menu button select option input label dialog fieldset".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " footer sidebar aside cookie cookies consent gdpr notice alert popup modal overlay share sharing social related"
    " recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget copyright disclaimer complementary contentinfo skip".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
BESIDE_WORDS = frozenset(
    "site page main global top bottom left right upper lower first last primary secondary inner outer box boxes block list item items area section container"
    " wrapper wrap holder panel bar row column col link links unit slot inline group content form field message text post posts article articles story stories card cards thread the a of x xs s m l xl".split()
)
TEXT_WORDS = frozenset("article body caption content entry headline heading intro lead main post standfirst story subtitle text title".split())
TRUSTED = frozenset("h1 h2 h3 h4 h5 h6 table tbody thead tfoot tr td th caption figcaption body html article main".split())
LINK = re.compile(r"(?:/[^/]*)*?/a(?:[./]|$)")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
#: The share of the weight that the text's section holds; a block's threshold as a share of the mean; the gain of article and main.
SHARE, THRESHOLD, GAIN = 0.6, 0.3, 4.0
#: A block with punctuation is prose from this share of such blocks' median length, and from so many characters whatever the median.
MEDIAN_SHARE, PROSE = 0.3, 60


def _kind(token: str) -> str:
    """What a name token says of its element: comments, other, head, text or nothing."""
    parts = [p.lower() for p in PART.findall(token)]
    said = {p for p in parts if not p.isdigit() and p not in BESIDE_WORDS}
    for kind, words in (("comments", COMMENT_WORDS), ("other", NOT_TEXT_WORDS), ("head", HEAD_WORDS)):
        # a part of another list doesn't clear a token
        if said & words and said <= COMMENT_WORDS | NOT_TEXT_WORDS | HEAD_WORDS:
            return kind
    return "text" if parts and parts[-1] in TEXT_WORDS else ""


class _Element:
    __slots__ = ("tag", "above", "bad", "good", "named", "says", "path")

    def __init__(self, tag: str, above: "_Element | None", attributes: str):
        tokens, says = (), set()
        if attributes:
            tokens = sorted({t for m in NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()})
            says = {_kind(t) for t in tokens}
        self.tag, self.above = tag, above
        self.good = tag in ("article", "main") or bool(above and above.good)
        self.bad = bool(above and above.bad or tag in NOT_TEXT_TAGS or tag == "header" and not self.good or attributes and HIDDEN.search(attributes))
        plain = tag in ("body", "html", "article", "main")
        self.says = "" if plain else "comments" if "comments" in says else "other" if "other" in says or "head" in says and not self.good else ""
        self.named = bool(tokens) and tag not in TRUSTED and "text" not in says
        self.path = (above.path if above else "") + "/" + tag + "".join("." + t for t in tokens)


def blocks_of(page: str) -> list[tuple[_Element, str, list[tuple[str, int, int]]]]:
    """Blocks in page order: the element, the text, and (path, length, punctuation) of its nodes."""
    top = here = _Element("", None, "")
    out, parts, nodes, owner = [], [], [], top

    def close() -> None:
        nonlocal parts, nodes
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text, nodes))
        parts, nodes = [], []

    for m in TOKEN.finditer(page):
        said, tag = m[5], m[3]
        if said is not None:
            if not parts:
                owner = here
            text = html.unescape(said)
            parts.append(text)
            if not text.isspace():
                nodes.append((here.path, len(text), len(PUNCTUATION.findall(text))))
        elif tag:
            tag = tag.lower()
            if tag in BLOCKS:
                close()
            elif tag == "br":
                parts.append(" ") if parts else None
            if m[2]:
                at = here
                while at.above and at.tag != tag:
                    # an inline end tag doesn't reach over a block
                    at = at.above if tag in BLOCKS or at.tag not in BLOCKS else top
                if at.above:
                    here = at.above
            elif tag not in VOID:
                if tag in BLOCKS:
                    while here.above and (here.tag not in BLOCKS or here.tag == "p" or here.tag == tag and tag in ("li", "dd", "dt", "td", "th", "tr")):
                        here = here.above
                here = _Element(tag, here, m[4] if "=" in m[4] or "hidden" in m[4] else "")
    close()
    return out


def _around_prose(section: _Element, blocks: list) -> _Element:
    """The lowest element at or over the section that holds every block of prose."""
    marked = [(e, len(text)) for e, text, nodes in blocks if not e.bad and any(marks for _, _, marks in nodes)]
    least = min(PROSE, MEDIAN_SHARE * median_high(n for _, n in marked)) if marked else 0
    prose = [e for e, n in marked if n >= least]
    held: dict[_Element, int] = defaultdict(int)
    for e in prose:
        while e:
            held[e] += 1
            e = e.above
    while section.above and held[section] < len(prose):
        section = section.above
    return section


def _up(e: _Element):
    while e.above:
        yield e
        e = e.above


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for _, _, nodes in blocks:
        for path, length, marks in nodes:
            s = sums[path]
            s[0], s[1], s[2] = s[0] + length, s[1] + marks, s[2] + 1
    ratio = {p: (length / n) * (1 + marks / n) for p, (length, marks, n) in sums.items()}
    raw = [sum(ratio[p] * n for p, n, _ in nodes) / max(1, sum(n for _, n, _ in nodes)) for _, _, nodes in blocks]
    padded = [0.0, *raw, 0.0]
    smooth = [0.25 * padded[i] + 0.5 * padded[i + 1] + 0.25 * padded[i + 2] for i in range(len(raw))]

    # names take weight away from what holds neither most of it nor an article
    held: dict[_Element, float] = defaultdict(float)
    around: set[_Element] = set()
    for (e, text, _), s in zip(blocks, smooth):
        if not e.bad:
            for up in _up(e):
                held[up] += s * len(text)
                if up.tag in ("article", "main"):
                    around.update(_up(up))
    most = SHARE * max(held.values(), default=0)
    cleared = {e for e in held if not e.says or e in around or e.says == "other" and held[e] >= most and not around}
    bad = [e.bad or any(up not in cleared for up in _up(e)) for e, _, _ in blocks]

    fused = [0.0 if b else s * len(text) * (GAIN if e.good else 1) for (e, text, _), s, b in zip(blocks, smooth, bad)]
    if not any(fused):
        return ""
    least = THRESHOLD * sum(fused) / len(fused)
    weight: dict[_Element, float] = defaultdict(float)
    for (e, _, _), f in zip(blocks, fused):
        if f >= least:
            for up in _up(e):
                weight[up] += f
    total = max(weight.values(), default=0)
    fit = [e for e, w in weight.items() if w >= SHARE * total and e.tag in SECTIONS]
    if not fit:  # text without any section
        return "\n".join(text for (_, text, _), b in zip(blocks, bad) if not b)
    section = max(fit, key=lambda e: e.path.count("/"))
    if not section.good:
        section = _around_prose(section, [x for x, b in zip(blocks, bad) if not b])
    for up in _up(section):
        if up.tag in ("article", "main"):
            section = up

    inside = [i for i, (e, _, _) in enumerate(blocks) if not bad[i] and (e is section or section in _up(e))]
    own: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for i in inside:
        e, _, nodes = blocks[i]
        for path in {up.path for up in _up(e)}:
            s = own[path]
            s[0], s[1], s[2] = s[0] + sum(n for _, n, _ in nodes), s[1] + sum(m for _, _, m in nodes), s[2] + 1
    worth = {p: (length / n) * (1 + marks / n) for p, (length, marks, n) in own.items()}
    enough = THRESHOLD * worth[section.path]

    def kept(i: int) -> bool:
        e, _, nodes = blocks[i]
        item = next((up for up in _up(e) if up.tag in BLOCKS), e)
        if item.tag == "li" and worth[item.path] < enough and all(LINK.match(path, len(item.path)) and not marks for path, _, marks in nodes):
            return False
        for up in _up(e):
            if up is section:
                return True
            if up.named and worth[up.path] < enough:
                return False
        return True

    return "\n".join(blocks[i][1] for i in inside if kept(i))


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row with page_id, url and html."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return extract(read_table(spark, sf_dir, "pages"))
