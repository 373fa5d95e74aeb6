"""Main text of web pages by two-pass block rules.

Pass 1 cuts a page into blocks and decides those that its rules can: by the enclosing
elements, link density, length and stop-word density. Pass 2 gives each undecided block the
label of its nearest decided neighbours. On a page that names an article, the article's element
is the strongest sign: blocks outside are no main text, those inside are decided by density and
links, and neighbours count only inside. That holds where one article alone has dense text and none
stands before it (what follows may be readers' comments), or where the articles hold at least as
much text as there is dense text outside; other articles are teasers. On any other page density and
links decide alone, also outside. Where dense text is less than a quarter of the long blocks that
aren't, the page is in another language than the stop words', and length and links decide instead
of density. Every page is one row in and one row out, so the work is a plain map.

Defined cases: null or empty html gives an empty text; a page that is cut off in a tag loses
that tag only; text outside any block element is a block of its own; unclosed elements end
with their parent; a page in which nothing is decided keeps blocks with words only if they
are not link lists.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.llm.common import free_name

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and a to in is that it was for on are as with his they at be this from have or by not but what all were
    when we there can an which their if will each about how up out them then she many some so these would into has more
    der die das und ist von den mit zu auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird
    bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sich ich
    le la les de des du un une et est en que qui dans pour pas sur au avec par ce il ne se plus aux son sont ou mais
    comme on nous vous leur cette été elle ses ces
    el los las del y que en un una por con no para es al lo se su como más o pero sus le ha me sin sobre este ya entre
    cuando todo esta ser son también fue había era muy hasta desde""".split()
)
# Elements that start and end blocks.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul""".split()
)
# Elements whose content is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object select textarea button title head canvas audio video".split())
# Elements that hold what surrounds an article.
AROUND_TAGS = frozenset("nav footer aside form menu dialog".split())
# Words in class, id or role that name such elements.
AROUND_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar widget nav navbar
    navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice alert popup modal newsletter subscribe
    signup comment comments commentlist disqus reply replies respond share sharing social related recommended pagination
    pager login search toolbar contentinfo complementary dialog gdpr paywall""".split()
)
# Words that may stand beside them in one name, as in share-buttons; others make a name of its own, as in social-history.
NAME_PARTS = frozenset(
    """area bar block body bottom box button buttons card cards container content count dropdown fixed form global group header
    icon icons inner item items left link links list main menu mobile module overlay page panel posts primary right row
    secondary section site slot small sticky text title top unit widget widgets wrap wrapper thread""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript template svg math".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
# one attribute with its value, so that names are never looked for inside values
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"\w+")

LONG_CHARS, SHORT_CHARS, STOP_SHARE, LINK_SHARE = 140, 70, 0.2, 0.4


class _Block:
    """``article`` is the number of the article that holds the block, 0 outside."""

    __slots__ = ("text", "linked", "around", "article", "good")

    def __init__(self, text: str, linked: int, around: bool, article: int):
        self.text, self.linked, self.around, self.article, self.good = text, linked, around, article, None

    @property
    def inside(self) -> bool:
        return self.article > 0


def _named_around(attributes: str, inside: bool) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()}
                if words & AROUND_WORDS and words <= AROUND_WORDS | NAME_PARTS and not (inside and words & AROUND_WORDS <= {"banner"}) or not inside and name != "id" and words == {"header"}:
                    return True
    return False


def blocks(page: str) -> list[_Block]:
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, around, inside an article
    parts: list[str] = []
    linked, anchor, at, n, article = 0, 0, 0, len(page), 0
    around = inside = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(_Block(text, linked, around, article if inside else 0))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            s = entities.unescape(page[at:end])
            parts.append(s)
            if anchor:
                linked += len("".join(s.split()))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text_to(n)
            break
        text_to(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW_TAGS and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            flush()
        elif tag == "a":
            anchor = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            flush()
            if tag in BLOCK_TAGS:
                anchor = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID_TAGS and tag not in ("p", "li", "dd", "dt", "option", "td", "th", "tr") or tag in ("p", "li") and "=" in attributes:
                now_inside = inside or tag in ("article", "main")
                article += now_inside and not inside
                bad = around or tag in AROUND_TAGS or tag in SKIPPED_TAGS or tag == "header" and not inside or _named_around(attributes, inside)
                if tag in ("p", "li"):  # these end where the next one begins
                    while stack and stack[-1][0] in ("p", "li"):
                        stack.pop()
                    around, inside = stack[-1][1:] if stack else (False, False)
                    bad = around or _named_around(attributes, inside)
                    now_inside = inside
                stack.append((tag, bad, now_inside))
            elif tag in ("p", "li"):
                while stack and stack[-1][0] in ("p", "li"):
                    stack.pop()
            around, inside = stack[-1][1:] if stack else (False, False)
    flush()
    return out


def _dense(text: str) -> bool:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) >= STOP_SHARE * max(1, len(words))


def classify(found: list[_Block]) -> list[_Block]:
    """Labels every block; see the module text for the two passes."""
    links = [b.linked / max(1, len(b.text) - b.text.count(" ")) for b in found]
    plain = [not b.around and len(b.text) >= SHORT_CHARS and share <= LINK_SHARE for b, share in zip(found, links, strict=True)]
    dense = [p and _dense(b.text) for b, p in zip(found, plain, strict=True)]
    long = [p and not d and len(b.text) >= LONG_CHARS for b, p, d in zip(found, plain, dense, strict=True)]
    size_of = lambda chosen: sum(len(b.text) for b, c in zip(found, chosen, strict=True) if c)
    if 4 * size_of(dense) < size_of(long):
        dense = [d or x for d, x in zip(dense, long, strict=True)]
    held = size_of(p and b.inside for b, p in zip(found, plain, strict=True))
    outside = size_of(d and not b.inside for b, d in zip(found, dense, strict=True))
    articles = {b.article for b, d in zip(found, dense, strict=True) if d and b.inside}
    first = next((b for b, d in zip(found, dense, strict=True) if d), None)
    alone = len(articles) == 1 and first.inside
    leads = any(b.inside and not b.around for b in found) and (alone or held >= outside)
    for b, share, thick in zip(found, links, dense, strict=True):
        size = len(b.text)
        if b.around or leads and not b.inside:
            b.good = False
        elif share > LINK_SHARE and not (leads and size < SHORT_CHARS and share <= 0.8):
            b.good = False
        elif thick:
            b.good = True
        elif size >= LONG_CHARS and not leads:
            b.good = False
    decided = [k for k, b in enumerate(found) if b.good is not None and not (leads and (b.around or not b.inside))]
    left, labels = -1, [b.good for b in found]
    for k, b in enumerate(found):
        while left + 1 < len(decided) and decided[left + 1] < k:
            left += 1
        if b.good is None:
            near = [j for j in decided[max(0, left) : left + 2] if j != k]
            if near:
                least = min(abs(j - k) for j in near)
                labels[k] = any(found[j].good for j in near if abs(j - k) == least)
            else:
                labels[k] = True
    for b, good in zip(found, labels, strict=True):
        b.good = good
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page)) if b.good) if page else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; ``html`` itself is left out, every other column is kept."""
    kept = [c for c in pages.columns if c != html]
    text, n_chars = free_name(pages.select(*kept) if kept else pages, "text"), free_name(pages, "n_chars")
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text, T.StringType())])
    names = [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.schema.get_field_index(html))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array(texts, pa.string())], names)

    return pages.mapInArrow(run, schema).withColumn(n_chars, F.char_length(text).cast("long"))
