"""HTML main-text extraction by tag-path ratios.

Every text run of a page belongs to the path of tags from the root to its element (a step is a tag with its first
class). For each path, text length and punctuation are added up over its runs, and divided by the runs. Both ratios
are smoothed over paths: paths that share most of their steps, like a heading and the paragraphs beside it, lend each
other weight that decays with their distance in the tree. The smoothed ratios are fused with what the page says about
an element itself, and paths above a threshold of the best one are content. An article or main that holds enough of
the page's text limits the choice to its paths; a teaser does not. A name of navigation, advertising and the like is a
factor on the ratios below it, unless the element holds such an article or most of the text. Pages are read where
they lie, in Arrow batches: no shuffle.

Blocks are cut at block-level tags; white space inside a block becomes one space, blank blocks go, and blocks are
joined by a line feed in page order. Character references are decoded once, after the markup is cut.

Defined results: null and empty html give an empty text; text outside any tag is content of the root; an unclosed
tag, comment, script or style at the end of a page hides what follows it; repeated pages are separate rows.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanrisk.llm.common import with_text_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，；：！？、]")

# FIXED VALUES - HTML elements by role.
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html head body option legend summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
            "option": "option"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table",
          "option": "select"}
# FIXED VALUES - elements, roles and name parts that mark what is not the article.
ASIDE = frozenset(
    "nav footer aside script style noscript template iframe object svg canvas button select textarea input "
    "label dialog menu head title audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                        "menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo "
    "promoted promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login form search comment "
    "comments disqus respond replies pagination pager copyright skip toolbar".split())
ARTICLE_ASIDE = frozenset("comment comments reply ad ads advert advertisement sponsored promo related".split())


@dataclass(frozen=True)
class PathParams:
    decay: float = 0.5  # weight that a step in the tree leaves
    threshold: float = 0.1  # of the best path's score
    inside: float = 0.02  # the same, among the paths of an article
    name: float = 0.005  # factor of paths in an element whose name says that it is not content
    most: float = 0.5  # share of the text from which such a name does not count
    nearly_all: float = 0.9  # the same, for names of comments, advertising and the like
    headed: float = 20.0  # weight of a main's text, or of an article's with an h1, against the text outside


def _hints(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, int, bool]:
    """Path step, whether the element is not content, whether its name says so (2: of comments, advertising and the
    like), whether it is an article."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    classes = found.get("class", "").split()
    step = f"{tag}.{classes[0].lower()}" if classes else tag
    article = tag in ("article", "main") or found.get("role") in ("main", "article")
    if tag in ASIDE or tag == "header" and not in_article:
        return step, True, 0, False
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(
            " ", ""):
        return step, True, 0, False
    names = set()
    for name in (*classes, *found.get("id", "").split()):
        parts = [x.lower() for x in NAME.findall(name)]
        if parts[:1] and parts[0] not in ("has", "with", "no", "without"):  # what an element has, it is not
            names.update(parts, ["".join(parts)])
    if tag in ("html", "body", "main"):
        return step, False, 0, article
    if article:
        aside = bool(names & ARTICLE_ASIDE)
        return step, False, 2 * aside, not aside
    if in_article:
        names -= {"header", "masthead"}  # an article's own head holds its title
    form = tag == "form" or found.get("role") == "form"
    named = 2 if names & ARTICLE_ASIDE else int(form or bool(names & ASIDE_NAMES))
    return step, found.get("role") in ASIDE_ROLES, named, False


@dataclass
class Page:
    """Text runs in page order, and the tree of tag paths that they hang on (0 is the root, parents come first)."""

    runs: list[tuple[int, int, str]]  # block number, path, raw text
    parent: list[int]
    aside: list[bool]  # an element of the path is not content
    named: list[int]  # the name of the path's last element says that it is not content (0: does not)
    article: list[int]  # the outermost article that the path is inside (0: none)
    headed: list[bool]  # the path's last element is main or h1


def parse(text: str) -> Page:
    page = Page([], [0], [False], [0], [0], [False])
    runs, ids = page.runs, {}
    block = pos = 0
    stack: list[tuple[str, int]] = [("", 0)]  # open tags with their paths
    opened: Counter[str] = Counter()

    def said(part: str) -> None:
        if part and not part.isspace():
            runs.append((block, stack[-1][1], part))
        elif part:
            spaced()

    def spaced() -> None:
        if runs and runs[-1][0] == block:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + " ")

    def pop_to(tags: str, scope: str = "") -> None:
        """Close the innermost of ``tags`` and what it holds, but nothing outside the innermost of ``scope``."""
        wanted, limits = tags.split(), scope.split()
        if not any(opened[t] for t in wanted):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in wanted:
                opened.subtract(t for t, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in limits:
                return

    for m in TOKEN.finditer(text):
        if m.start() < pos:
            continue
        said(text[pos:m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS:
            block += 1
        elif tag == "br":
            spaced()
        if closing:
            pop_to(tag)
            continue
        if tag in CLOSES_P:
            pop_to("p", "td th div section article aside main nav footer header blockquote li body button")
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], SCOPES[tag])
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, pos)
            pos = end.end() if end else len(text)
        elif tag not in VOID:
            above = stack[-1][1]
            step, aside, named, article = _hints(tag, m[3], page.article[above] > 0)
            key = (above, step, aside, named, article)
            at = ids.setdefault(key, len(page.parent))
            if at == len(page.parent):
                page.parent.append(above)
                page.aside.append(page.aside[above] or aside)
                page.named.append(named)
                page.article.append(page.article[above] or (at if article else 0))
                page.headed.append(tag in ("main", "h1") or article and tag != "article")
            stack.append((tag, at))
            opened[tag] += 1
    said(text[pos:])
    return page


def _smoothed(page: Page, value: list[float], decay: float) -> list[float]:
    """Sum over all paths of ``value`` times decay ** distance in the tree (one pass up, one down), over the most."""
    up = list(value)
    for k in range(len(up) - 1, 0, -1):
        up[page.parent[k]] += decay * up[k]
    out = list(up)
    for k in range(1, len(up)):
        out[k] += decay * (out[page.parent[k]] - decay * up[k])
    top = max((x for x, v in zip(out, value) if v), default=0.0)
    return [x / top if top else 0.0 for x in out]


def _below(page: Page, value: list[int]) -> list[int]:
    """Sum of ``value`` over each path and the paths below it."""
    out = list(value)
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] += out[k]
    return out


def _unlike(page: Page, chars: list[int], excused: list[int], p: PathParams) -> list[bool]:
    """Whether a name on the path says that it is not content. Names do not count where ``excused``, nor where the
    element holds most of the text (``chars``)."""
    held, total = _below(page, chars), sum(chars)
    share = (0.0, p.most, p.nearly_all)
    out = [bool(named) and not excused[k] and held[k] < share[named] * total for k, named in enumerate(page.named)]
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.parent[k]]
    return out


def _articles(page: Page, chars: list[int], p: PathParams) -> set[int]:
    """The articles that hold at least as much text as there is outside all of them, by weight."""
    n = len(page.parent)
    held = _below(page, chars)
    unlike = _unlike(page, chars, _below(page, [int(page.article[k] == k > 0) for k in range(n)]), p)
    outside = sum(c for k, c in enumerate(chars) if not page.article[k] and not unlike[k])
    headed = {page.article[k] for k in range(n) if page.headed[k] and not page.aside[k]}
    return {k for k in range(1, n) if page.article[k] == k and held[k]
            and held[k] * (p.headed if k in headed else 1) >= outside}


def content_paths(page: Page, p: PathParams = PathParams()) -> set[int]:
    """The paths whose runs are content."""
    n = len(page.parent)
    chars, marks, runs = [0] * n, [0] * n, [0] * n
    for _, k, text in page.runs:
        if not page.aside[k]:
            chars[k] += len(text)
            marks[k] += len(PUNCTUATION.findall(text))
            runs[k] += 1
    articles = _articles(page, chars, p)
    used = [k for k in range(n) if runs[k] and (not articles or page.article[k] in articles)]
    if not used:
        return set()
    own = set(used)
    chars = [c if k in own else 0 for k, c in enumerate(chars)]
    unlike = _unlike(page, chars, _below(page, [int(k in articles) for k in range(n)]), p)
    factor = [p.name if x else 1.0 for x in unlike]
    length = _smoothed(page, [factor[k] * chars[k] / runs[k] if k in own else 0.0 for k in range(n)], p.decay)
    points = _smoothed(page, [factor[k] * marks[k] / runs[k] if k in own else 0.0 for k in range(n)], p.decay)
    score = {k: factor[k] * (length[k] + points[k]) / 2 for k in used}
    limit = (p.inside if articles else p.threshold) * max(score.values())
    return {k for k in used if score[k] >= limit}


def main_text(text: str, p: PathParams = PathParams()) -> str:
    page = parse(text)
    kept = content_paths(page, p)
    blocks: dict[int, list[str]] = {}
    for block, k, part in page.runs:
        if k in kept:
            blocks.setdefault(block, []).append(part)
    lines = (" ".join(references.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, html: str = "html", p: PathParams = PathParams()) -> DataFrame:
    """``pages`` with text and n_chars."""

    def step(texts: list[bytes]) -> dict[str, list]:
        out = [main_text(t.decode("utf-8", "replace"), p) if t else "" for t in texts]
        return {"text": out, "n_chars": [len(x) for x in out]}

    return with_text_columns(pages, html, FIELDS, lambda: step)
