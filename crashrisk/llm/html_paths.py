"""Main text of web pages by tag-path ratios.

Text nodes of a page are grouped by their path of tags from the root. A path's ratios are
its text length and its punctuation per node; the two are fused, smoothed along the page
and held against the spread of the page's scores. Paths above it point to the element
that holds the article: an <article> or <main> with most of their text, or else the
innermost one with all of it and nearly all of the page's. That element's nodes are the
result. Elements that say they
are something else (menus, footers, adverts, forms, ...) score nothing and are left out.

Pages are judged one by one: no shuffle and no state.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from crashrisk.llm.registry import query

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
#: Elements that never hold the article's text.
OUTSIDE = RAW | frozenset("head nav footer aside form button select option datalist dialog menu svg canvas math object "
                          "audio video map fieldset".split())
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of a key ends an open element of its value, unless an element of STOPS lies between.
CLOSES = ({t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption "
           "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
          | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
             "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
             "option": frozenset(["option"])})
STOPS = frozenset("table ul ol dl td th body html article section div main button".split())
#: Words in a class, id or role that say an element is not the article, wherever they stand between hyphens or underscores,
#: unless a word of NEGATED stands before.
OUTSIDE_WORDS = frozenset(
    "ad ads adsense banner nav navigation navbar breadcrumb breadcrumbs footer header masthead sidebar complementary contentinfo "
    "search notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login comment comments disqus "
    "replies respond share sharing social widget pagination pager toolbar skip hidden".split())
OUTSIDE_STEMS = ("advert", "sponsor", "promo", "menu", "recommend")
#: Words that say so as the whole name, or with nothing but words of their own beside them.
OUTSIDE_PAIRS = {"side": frozenset("bar box col column content left menu nav panel right".split()),
                 "related": frozenset("articles box content items links news pages posts reading stories topics".split())}
NEGATED = frozenset("no non not has have with without hide".split())
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)((?:"[^"<]*"|'[^'<]*'|[^><])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…،。，、！？；：]")
#: Share of the greatest path score that a path needs at most, and standard deviations of the node scores it needs otherwise.
MOST_SHARE, DEVIATIONS = 0.5, 1.0
#: Share of the page's text that is no link and not outside which an element must hold to be the article without saying so.
LEAST_KEPT = 0.8
#: Elements that are never the article nor hold all of it, and those that are not but may hold it.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: Weight of paths inside an element that says it is the article.
ARTICLE_WEIGHT = 4.0


def says_outside(value: str) -> bool:
    """Does a class, id or role say that its element is not the article?"""
    for name in value.lower().split():
        parts = re.split("[-_]+", name)
        for i, part in enumerate(parts):
            if i and parts[i - 1] in NEGATED:
                continue
            if part in OUTSIDE_WORDS or part.startswith(OUTSIDE_STEMS):
                return True
            if part in OUTSIDE_PAIRS and all(p in OUTSIDE_PAIRS[part] for p in parts[:i] + parts[i + 1:]):
                return True
    return False


class _Element:
    __slots__ = ("tag", "path", "parent", "outside", "article", "link", "depth")

    def __init__(self, tag: str, attributes: str, parent: _Element | None, paths: dict):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.path = paths.setdefault((parent.path if parent else None, tag), len(paths))  # a number for each root-to-leaf path
        self.link = tag == "a" or bool(parent and parent.link)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.outside = tag in OUTSIDE or bool(parent and parent.outside)
        if attributes and not self.outside:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody":
                    self.article = True
                elif (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name in ("class", "id", "role")
                      and tag not in ("html", "body", "article", "main") and says_outside(value)):
                    # a head inside the article is the article's own
                    self.outside |= not (self.article and _HEADER.search(value))
        if tag == "header" and not self.article:
            self.outside = True


def text_blocks(page: str) -> list[tuple[_Element, int, str]]:
    """(element, number of the block, text as it stands) of all text nodes outside raw elements."""
    paths: dict[tuple[int | None, str], int] = {}
    element, out, block, at = _Element("", "", None, paths), [], 0, 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        begin = token.start() if token else len(page)
        if begin > at:
            out.append((element, block, page[at:begin]))
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if tag not in INLINE:
            block += 1
        if token[1]:
            open_one = element
            while open_one and open_one.tag != tag:
                open_one = open_one.parent
            if open_one and open_one.parent:
                element = open_one.parent
            continue
        if tag == "br":
            out.append((element, block, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.IGNORECASE).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if ended := CLOSES.get(tag):
            open_one, found = element, None
            while open_one and open_one.tag not in STOPS:
                if open_one.tag in ended:
                    found = open_one
                open_one = open_one.parent
            if open_one and open_one.tag in ended and found is None:
                found = open_one
            if found is not None and found.parent:
                element = found.parent
        if not token[3].rstrip().endswith("/") or tag not in ("path", "circle", "rect", "line"):
            element = _Element(tag, token[3], element, paths)
    return out


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, kernel, mode="valid")


def main_text(page: str) -> list[str]:
    """The blocks of the article, in page order, with white space runs as one space."""
    nodes = [(element, block, html.unescape(text)) for element, block, text in text_blocks(page) if not element.outside]
    filled = [(element, text) for element, _, text in nodes if text.strip()]
    if not filled:
        return []
    root = filled[0][0]
    while root.parent is not None:
        root = root.parent
    counts, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for element, text in filled:
        counts[element.path] += 1
        if not element.link:
            chars[element.path] += len(text.strip())
            marks[element.path] += len(_PUNCTUATION.findall(text))
    weight = {element.path: ARTICLE_WEIGHT if element.article else 1.0 for element, _ in filled}
    ratio = {p: weight[p] * chars[p] / counts[p] * (1 + marks[p] / counts[p]) for p in counts}
    scores = _smooth(np.array([ratio[element.path] for element, _ in filled]))
    by_path = defaultdict(list)
    for (element, _), score in zip(filled, scores):
        by_path[element.path].append(score)
    level = {p: float(np.mean(v)) for p, v in by_path.items()}
    needed = min(MOST_SHARE * max(level.values()), float(scores.mean() + DEVIATIONS * scores.std()))
    chosen = {p for p, v in level.items() if v >= needed}

    # chosen text, and all text that is no link, in every element
    held: dict[_Element, int] = defaultdict(int)
    kept: dict[_Element, int] = defaultdict(int)
    for element, text in filled:
        size, up = len(text.strip()), element
        picked, own = size if element.path in chosen else 0, 0 if element.link else size
        while up is not None:
            held[up] += picked
            kept[up] += own
            up = up.parent
    articles = [e for e, size in held.items() if e.tag in ("article", "main") and 2 * size > held[root]]
    best = max(articles, key=lambda e: e.depth, default=root)
    if not articles:
        # step down while one child keeps all chosen text and nearly all of the page's
        for e in sorted((e for e, size in held.items() if size == held[root]), key=lambda e: e.depth):
            if e.tag in PARTS or kept[e] < LEAST_KEPT * kept[root]:
                break
            if e.tag not in INLINE and e.tag not in TABLE:
                best = e
    blocks: dict[int, list[str]] = defaultdict(list)
    for element, block, text in nodes:
        up = element
        while up is not None and up is not best:
            up = up.parent
        if up is best:
            blocks[block].append(text)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return [b for b in joined if b]


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            blocks = [main_text(page or "") for page in part.column(part.num_columns - 1).to_pylist()]
            text = pa.array(["\n".join(b) for b in blocks], pa.string())
            yield pa.record_batch([*part.columns[:-1], text, pc.utf8_length(text).cast(pa.int64()),
                                   pa.array(list(map(len, blocks)), pa.int64())], names=names)


def extract_main_text(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns ``keep`` of every row with its page's main text, n_chars (code points) and n_blocks.

    A null or empty page, and one without an article, has an empty text. Repeated rows are
    extracted each on its own; columns that are not named are not read.
    """
    fields = df.select(*keep).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long, n_blocks long"
    return df.select(*keep, page).mapInArrow(partial(_batches, names=[*keep, "text", "n_chars", "n_blocks"]), schema)


@query("op10_html_paths")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
