"""Main text of web pages by a maximum-scoring subsequence.

A page is a row of tokens: words and tags. Words have the weight of their kind, the log of the odds that
such a word stands inside the content, fitted on labelled pages. The kind is the block that the word stands
in (paragraph, heading, list, ...), whether that is a long one, and whether the word is linked; labels come
from the element that a page names as its content. Pages of one template vote once, however many there are,
so that a kind that one template never uses in its content isn't taken for boilerplate everywhere. Where an
element around a word looks like boilerplate by its name or by a word of its class, id or role, the weight of
this evidence, fitted as well, stands for that of the kind. Tags score negative. One linear scan finds the
contiguous run of tokens with the largest sum, the content region. Its blocks are the text, but for those
whose words their evidence makes negative, such as an advert amid an article.

A page that names one element as its content (``article`` or ``main``) has said what belongs together: words
inside that no evidence speaks against score at least ``NAMED``, and the tags between them nothing, so that
lists, tables and short lines of an article stay. The element's own two tags cost ``BORDER`` each.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import texts_of

#: Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("head script style noscript template iframe svg math object canvas select textarea".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu".split())
CONTENT = ("article", "main")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
PLACES = {"p": "paragraph", "blockquote": "quote", "pre": "quote", "figcaption": "quote"} | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading") | dict.fromkeys("li dt dd".split(), "list") | dict.fromkeys("td th".split(), "cell")
#: Words of class, id and role that may mark boilerplate (menus, notices, adverts, comments and the like), and
#: words beside them that say how a page is laid out.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments discussion discussions disqus feedback respond reply replies related recommended widget toolbar pagination pager skip contentinfo complementary search".split()
)
LAYOUT = frozenset("has is no not with without and open opened closed enabled disabled on off".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_BORDERS = frozenset(f"tag {name}" for name in CONTENT)

#: Rows of the labelled pages, at most: those with the smallest hash.
LABELLED_ROWS = 2_000
#: Words of a block that make it long.
LONG = 25
#: How likely words of a kind are content before any page is seen, and the words that this counts for.
PRIOR_SHARES = {"paragraph": 0.8, "quote": 0.8, "heading": 0.7, "list": 0.7, "cell": 0.6, "other short": 0.35, "other long": 0.7, "bare": 0.7, "evidence": 0.05}
PRIOR_SHARES |= {"linked paragraph": 0.55, "linked quote": 0.55, "linked heading": 0.5, "linked list": 0.15, "linked cell": 0.3, "linked other": 0.15, "linked bare": 0.3}
PRIOR = 20.0
#: Bounds of the weights of a word, of a word with evidence, and of a tag.
WORD_BOUNDS, EVIDENCE_BOUNDS, TAG_BOUNDS = (-4.0, 4.0), (-8.0, 4.0), (-1.0, -0.05)
#: A tag's weight without evidence, that of a tag at which a content element begins or ends, and what a block
#: costs at most that its evidence keeps out of the text anyway.
TAG, BORDER, LEFT_OUT = -0.2, -5.0, 0.5
#: The least weight of a word in the page's one content element, if nothing speaks against it.
NAMED = 0.5


@dataclass
class Element:
    """An open element, with what speaks for boilerplate."""

    name: str
    linked: bool
    place: str
    inside: bool  # a labelled content element
    around: tuple[Element, ...] = ()  # elements with evidence that hold this one, and this one
    evidence: tuple[str, ...] = ()
    words: int = 0
    holds: bool = False  # the first heading of the first order
    holds_content: bool = False


@dataclass
class Token:
    kind: str
    text: str  # of words; a tag has none
    block: int
    inside: bool
    around: tuple[Element, ...] = field(default=())
    words: int = 0
    begins: bool = False  # a content element


def evidence_of(name: str, attributes: str, within: tuple[str, ...]) -> tuple[str, ...]:
    """Kinds of evidence that an element is boilerplate."""
    if name in ("html", "body", *CONTENT):
        return ()
    found = {f"in {name}"} if name in BOILERPLATE or (name == "header" and not {*CONTENT, "section"} & {*within}) else set()
    for _, *values in _ATTRIBUTE.findall(attributes):
        for value in values:
            for word in value.lower().split():
                parts = _NAME.findall(word)
                if not LAYOUT & {*parts}:
                    found |= {f"mark {part}" for part in parts if part in MARKS}
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return tuple(sorted(found))


def tokens(page: str) -> list[Token]:
    """A page's runs of words and its tags, in order.

    Unclosed elements end with the element around them; end tags without a start are tags like others.
    Raw elements (scripts, styles, the head) hold no words. An element with evidence of boilerplate that
    holds the page's first content element, most words with the first heading, or four fifths of all words
    is a wrapper of the page and loses it.
    """
    found: list[Token] = []
    open_: list[Element] = []
    block, at, size, total = 0, 0, len(page), 0
    worded, lengths = -1, Counter()  # the last block with words; words of each block
    low, headed, reached = None, False, False
    top = Element("", False, "bare", False)  # text in no element at all
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        here = open_[-1] if open_ else top
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                text = m[0]
                count = len(text.split())
                if count:
                    found.append(Token(("linked " if here.linked else "") + here.place, text, block, here.inside, here.around, count))
                    worded = block
                    total += count
                    lengths[block] += count
                    for element in here.around:
                        element.words += count
                elif worded == block:
                    found.append(Token(here.place, " ", block, here.inside, here.around))  # of no words, so that it scores nothing
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        inside = here.inside
        if m[1]:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth].name == name:
                    del open_[depth:]
                    break
        elif name in RAW:
            if not m[3].endswith("/"):
                low = page.lower() if low is None else low
                ends = [e for e in (low.find(f"</{name}", at), low.find("<body", at) if name == "head" else -1) if e >= 0]
                at = size if not ends else min(ends) if low.startswith("<body", min(ends)) else max(at, low.find(">", min(ends)) + 1 or size)
        else:
            if name == "br" and worded == block:
                found.append(Token(here.place, " ", block, here.inside, here.around))
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_:
                # such an element ends the one of its name before it, unless another block began meanwhile
                for depth in range(len(open_) - 1, -1, -1):
                    if open_[depth].name == name:
                        del open_[depth:]
                        break
                    if open_[depth].name in BLOCKS:
                        break
                here = open_[-1] if open_ else top
            if name not in VOID and not m[3].endswith("/"):
                within = tuple(e.name for e in open_)
                inside = here.inside or name in CONTENT
                if name == "h1" and not headed:
                    headed = True
                    for element in here.around:
                        element.holds = True
                if name in CONTENT and not reached and not {"nav", "aside", "footer"} & {*within}:
                    reached = True
                    for element in here.around:
                        element.holds_content = True
                place = PLACES.get(name, "other") if name in BLOCKS else "other" if here.place == "bare" and name == "body" else here.place
                new = Element(name, here.linked or name == "a", place, inside, here.around, evidence_of(name, m[3], within))
                if new.evidence:
                    new.around = (*here.around, new)
                open_.append(new)
                here = new
        found.append(Token(f"tag {name}", "", block, inside, here.around, begins=not m[1] and name in CONTENT))
    for token in found:
        if token.words and token.kind == "other":
            token.kind = "other long" if lengths[token.block] >= LONG else "other short"
        token.around = tuple(e for e in token.around if not (e.holds_content or 2 * e.words > total and e.holds or 5 * e.words > 4 * total))
    return found


def kind_counts(page: str) -> list[tuple[str, int, int]]:
    """(kind, words or tags inside content, outside) of a labelled page; none where it has not one content element.

    Words count for the kind of their place, and for each kind of evidence around them; tags count where
    there is no evidence.
    """
    if len(re.findall(r"<(?:article|main)[\s>]", page, re.IGNORECASE)) != 1:
        return []
    inside, outside = Counter(), Counter()
    for token in tokens(page):
        side, against = (inside if token.inside else outside), {kind for e in token.around for kind in e.evidence}
        if token.text:
            for kind in {token.kind, *against}:
                side[kind] += token.words
        elif not against:
            side[token.kind] += 1
    return [(k, inside[k], outside[k]) for k in sorted(inside | outside)]


def template_of(page: str) -> str:
    """The names of a page's elements, and the words of class, id and role that may mark boilerplate: pages made alike have the same."""
    names, marks = {m[2].lower() for m in _TOKEN.finditer(page) if m[2]}, set()
    for _, *values in _ATTRIBUTE.findall(page):
        marks |= {part for value in values for part in _NAME.findall(value.lower()) if part in MARKS}
    return " ".join([*sorted(names), "/", *sorted(marks)])


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", rows: int = LABELLED_ROWS) -> dict[str, float]:
    """Weights of all kinds from labelled pages: those whose markup names one content element.

    The sample is the ``rows`` pages of the smallest key hash at most, counted in Spark. The pages of a
    template vote together, for each kind by the share of its words (or tags) inside, with the weight of
    ``PRIOR`` words. The driver gets one row for each kind of token. Without labelled pages all kinds have the
    weights of the prior.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(template_of(p or ""), *x) for p in batch.column(0).to_pylist() for x in kind_counts(p or "")]
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["template", "kind", "inside", "outside"])

    sample = pages.select(key).orderBy(F.xxhash64(key), key).limit(rows).distinct()
    labelled = pages.join(F.broadcast(sample), key, "left_semi").select(page)  # `rows` keys at most
    counts = labelled.mapInArrow(count, "template string, kind string, inside long, outside long").groupBy(F.xxhash64("template").alias("template"), "kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    share = F.col("inside") / (F.col("inside") + F.col("outside"))
    counts = counts.where("inside + outside > 0").groupBy("kind").agg((PRIOR * F.sum(share)).alias("inside"), (PRIOR * F.sum(1 - share)).alias("outside"))
    # Tag names are the page's own, so only those that HTML knows are kept apart.
    known = [f"tag {n}" for n in sorted((BLOCKS | VOID | BOILERPLATE | {"a", "b", "i", "em", "strong", "span"}) - {*CONTENT})]
    return weights([tuple(r) for r in counts.where(~F.col("kind").startswith("tag ") | F.col("kind").isin(known)).collect()])


def weights(counts: list[tuple[str, float, float]]) -> dict[str, float]:
    """Log of the odds of the inside for each kind, within its bounds; kinds that no page has get that of the prior."""
    seen = {kind: (inside, outside) for kind, inside, outside in counts}
    evidence = [f"in {n}" for n in sorted(BOILERPLATE | {"header"})] + [f"mark {w}" for w in sorted(MARKS)] + ["hidden"]
    priors = {k: (v, WORD_BOUNDS) for k, v in PRIOR_SHARES.items() if k != "evidence"} | {k: (PRIOR_SHARES["evidence"], EVIDENCE_BOUNDS) for k in evidence}
    found = {"tag": TAG} | {f"tag {n}": BORDER for n in CONTENT}
    for kind, (share, (low, high)) in priors.items():
        inside, outside = seen.get(kind, (0, 0))
        found[kind] = min(high, max(low, math.log((inside + PRIOR * share) / (outside + PRIOR * (1 - share)))))
    for kind, (inside, outside) in seen.items():
        if kind.startswith("tag ") and kind not in found:
            found[kind] = min(TAG_BOUNDS[1], max(TAG_BOUNDS[0], math.log((inside + PRIOR / 2) / (outside + PRIOR / 2))))
    return found


def region(scores: list[float]) -> tuple[int, int]:
    """The first of the shortest runs [start, end) with the largest sum; (0, 0) if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def scored(row: list[Token], weight: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether its evidence keeps it out of the text."""
    scores, left_out, paid = [], [], {}
    named = sum(token.begins for token in row) == 1
    for token in row:
        against = min((weight[kind] for e in token.around for kind in e.evidence), default=None)
        out = against is not None and against < 0
        left_out.append(out)
        belongs = named and token.inside and against is None
        if not token.text:
            scores.append(0.0 if out or belongs and token.kind not in _BORDERS else weight.get(token.kind, TAG))
        elif out:
            before = paid.get(token.block, 0.0)
            paid[token.block] = max(-LEFT_OUT, before + against * token.words)
            scores.append(paid[token.block] - before)
        else:
            own = weight.get(token.kind, 0.0) if against is None else against
            scores.append((max(NAMED, own) if belongs else own) * token.words)
    return scores, left_out


def main_text(page: str, weight: dict[str, float]) -> str:
    """The text of the blocks that a page's content region reaches, one line a block."""
    row = tokens(page)
    scores, left_out = scored(row, weight)
    start, end = region(scores)
    reached = {token.block for token in row[start:end] if token.words}  # blocks that the region cuts are whole
    blocks: dict[int, list[str]] = {}
    for token, out in zip(row, left_out):
        if token.text and token.block in reached and not out:
            blocks.setdefault(token.block, []).append(token.text)
    lines = (_SPACE.sub(" ", entities.unescape("".join(parts))).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extracted(page: Column, weight: dict[str, float]) -> Column:
    """String column: the main text of ``page`` (null: empty)."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((main_text(p or "", weight) for run in texts_of(batch) for p in run), pa.string())

    return text(page)


def extract(pages: DataFrame, weight: dict[str, float], page: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` with the main text and its code points under ``names`` (existing columns of these are replaced).

    Every row stays; null, empty and wordless pages have an empty text; whole pages are read.
    """
    text, n_chars = names
    kept = [pages[c] for c in pages.columns if c.lower() not in {text.lower(), n_chars.lower()}]
    return pages.select(*kept, extracted(pages[page], weight).alias(text)).withColumn(n_chars, F.char_length(text).cast("long"))
