"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a row of tokens: words score positive (words of links less), tags negative. Weights come from labelled pages:
pages whose author marked the content with an article or main element tell, for every kind of tag, how often it stands
outside of the content, how long blocks outside run (a tag seen outside only costs more than the longest such block),
and which class names stand outside only (words in such elements score as little as those of links). One linear scan
finds the contiguous region of the highest score. Elements that hold no main text by their kind (menus, forms, scripts,
...) or by their own name for it (class, id or role such as "sidebar" or "comments") add no words, wherever they stand.

Elements end as HTML has it: at their end tag, at that of an element around them, or, for those whose end tag may be left
out (p, li, td, ...), where the next one begins. An element to leave out whose end tag is missing, though it may not be
left out, is not left out, for what follows may be text. All passes are linear in the page, however malformed.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 200  # pages that are looked at for labels
SAMPLE_BYTES = 200_000  # of pages up to this size

# Element names of HTML.
RAW = "script style noscript template svg math iframe object textarea title select".split()
ASIDE = "nav footer aside form button dialog menu head".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = ("article", "main")
FLOW = set("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Which open elements a start tag ends, and the elements they don't end beyond.
ENDS_P = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
ENDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {t: (("p",), ("button", "table", "td", "th", "caption", "object")) for t in ENDS_P}
ENDS |= {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
ENDS |= {"td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",))}
ENDS |= {t: (("thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")}
OPTIONAL_END = {"p", "li", "dt", "dd", "option", "td", "th", "tr", "thead", "tbody", "tfoot"}
# Words of class, id or role names that say what an element is, whatever stands beside them in the name, ...
STRONG = re.compile(r"advert\w*|breadcrumbs?|comments?|commentlist|contentinfo|cookies?|disqus|masthead|nav|navbar|navigation|newsletter|pagination|sidebar|sponsored")
# ... those that say so alone or beside their like and the neutral words, ...
WEAK = re.compile(r"ads?|banner|footer|menu|modal|notice|popup|promo\w*|related|replies|respond|responses|share|sharing|signup|social|sponsor|sponsors|subscribe|subscription|widgets?")
# ... and words that say nothing of their own.
NEUTRAL = re.compile(
    r"\d\w*|ad|area|articles?|bar|block|blog|body|bottom|box|btn|buttons?|col|column|container|content|desktop|entry|fixed|form|global|group|header|icons?|inline|inner|item|items|js|left|links?|list|main|mobile|more|outer|page|panel|post|posts|primary|reader|right|row|secondary|section|site|sticky|text|title|top|user|wp|wrap|wrapper"
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STEP = re.compile(r"[^>=]*(?:(>)|=\s*([\"']?))")


def says_aside(name: str) -> bool:
    """Whether a class, id or role name means an element without main text."""
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
    if any(STRONG.fullmatch(x) for x in parts):
        return True
    return any(WEAK.fullmatch(x) for x in parts) and all(WEAK.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts)


@dataclass
class Weights:
    word: float = 1.0
    link_word: float = 0.2
    inline: float = 0.05
    skipped: float = 1.0
    flow: float = 4.0
    tag: float = 0.5  # of a kind of tag that the labelled pages don't have
    longest: float = 40.0  # words of a block outside
    tags: dict[str, float] = field(default_factory=dict)
    outside: set[str] = field(default_factory=set)  # class names that the labelled pages have outside of the content only

    def of(self, tag: str) -> float:
        return -self.tags.get(tag, self.inline if tag.strip("/") in INLINE else self.longest if tag.strip("/") in CONTENT else self.tag)


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw text, ""), ("open" or "close", element, attributes) and ("raw", element, "") in page order. A quoted
    value may hold ">"; from the first tag that quotes keep open to the end of the page on, quotes mean nothing."""
    at, size, quotes = 0, len(page), True
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "text", page[at:end], ""
            at = end
            continue
        m = TAG.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        end = here = m.end()
        while quotes:
            step = STEP.match(page, here)
            if step is None:
                quotes = False
            elif step[1]:
                end = step.end()
                break
            elif step[2]:
                here = page.find(step[2], step.end()) + 1
                quotes = here > 0
            else:
                here = step.end()
        if not quotes:
            end = page.find(">", m.end()) + 1
            if not end:
                return  # an unfinished tag ends the page
        name, rest = m[2].lower(), page[m.end() : end - 1]
        at = end
        if not m[1] and name in END_OF and not rest.rstrip().endswith("/"):
            close = END_OF[name].search(page, at)
            at = close.end() if close else size
            yield "raw", name, ""
        else:
            yield ("close" if m[1] else "open"), name, rest


@dataclass
class Element:
    name: str
    start: int  # of its first token
    names: list[str]
    aside: bool
    end: int = -1


def parsed(page: str) -> tuple[list[tuple[str, str]], list[Element]]:
    """("tag", name or /name), ("skip", name) for a raw element, ("text", raw text), in page order; and the elements that
    have names of their own or are to be left out or hold content, with the places of their tokens."""
    out: list[tuple[str, str]] = []
    stack: list[Element] = []
    where: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of each kind of open element
    noted: list[Element] = []

    def close(depth: int, own: bool = False) -> None:
        while len(stack) > depth:
            e = stack.pop()
            where[e.name].pop()
            e.end = len(out)
            e.aside = e.aside and (own and len(stack) == depth or e.name in OPTIONAL_END)

    for kind, name, rest in markup(page):
        if kind in ("text", "raw"):
            out.append(("text" if kind == "text" else "skip", name))
            continue
        if kind == "close":
            if where[name] and name not in ("html", "body"):
                depth = where[name][-1]
                out.append(("tag", "/" + name))
                close(depth, True)
            else:
                out.append(("tag", "/" + name))
            continue
        if name in ENDS:
            ended, within = ENDS[name]
            first = max((where[x][-1] for x in ended if where[x]), default=-1)
            if first >= 0 and all(not where[x] or where[x][-1] < first for x in within):
                close(first)
        if name not in VOID and not rest.endswith("/"):
            named = [(a.lower(), x) for a, *values in ATTRIBUTE.findall(rest) for x in next(filter(None, values), "").split()] if rest else []
            plain = name in ("html", "body", *CONTENT)
            aside = not plain and (name in ASIDE or name == "header" and not (where["article"] or where["main"]))
            aside = aside or not plain and any(says_aside(x) for a, x in named if a != "id" or name not in HEADINGS)
            e = Element(name, len(out), [x for a, x in named if a == "class"], aside)
            where[name].append(len(stack))
            stack.append(e)
            if e.names or aside or name in CONTENT:
                noted.append(e)
        out.append(("tag", name))
    for e in stack:  # open to the end of the page
        e.end = len(out)
        e.aside = e.aside and e.name in OPTIONAL_END
    return out, noted


def tokens(page: str, outside: set[str] = frozenset()) -> tuple[list[tuple[str, str]], list[bool]]:
    """The page's tokens, with ("skip", name) for each element that is left out; and for each token whether it stands in an
    element of a name in `outside`."""
    row, elements = parsed(page)
    out, low, at, low_to = [], [], 0, 0
    marks = [e for e in elements if e.aside or any(x in outside for x in e.names)]  # in page order
    for e in [*marks, None]:
        to = e.start if e else len(row)
        while at < to:
            stop = min(to, low_to) if at < low_to else to
            out += row[at:stop]
            low += [at < low_to] * (stop - at)
            at = stop
        if e and e.start >= at and e.aside:
            out.append(("skip", e.name))
            low.append(False)
            at = e.end
        elif e:
            low_to = max(low_to, e.end)
    return out, low


def learn(pages: list[str]) -> Weights:
    """Weights from the pages that hold one article or main element, which is their label."""
    inside, outside, longest = Counter(), Counter(), 0
    names_in, names_out = Counter(), Counter()
    for page in pages:
        _, elements = parsed(page)
        labels = [e for e in elements if e.name in CONTENT]
        row, _ = tokens(page)
        opens, closes = ([i for i, (kind, x) in enumerate(row) if kind == "tag" and x in which] for which in (CONTENT, [f"/{x}" for x in CONTENT]))
        if not labels or not opens or not closes:
            continue
        first, last = labels[0].start, max(e.end for e in labels)
        block = 0
        for i, (kind, x) in enumerate(row):
            within = opens[0] < i < closes[-1]
            if kind == "tag":
                (inside if within else outside)[x] += 1
                block = block if x.strip("/") in INLINE else 0
            elif kind == "text" and not within:
                block += len(x.split())
                longest = max(longest, block)
        names_in.update({x for e in elements if first <= e.start < last for x in e.names})
        names_out.update({x for e in elements if e.end <= first or e.start >= last for x in e.names})
    w = Weights(outside={x for x, n in names_out.items() if n >= 3 and not names_in[x]})
    if outside:
        w.longest = max(w.longest, 1.5 * longest)
        total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
        for tag in inside | outside:
            a, b = inside[tag] / total_in, outside[tag] / total_out
            # tags that any text may hold don't end a region by themselves, even if the labelled pages' texts lack them
            most = w.skipped if tag.strip("/") in INLINE else w.flow if tag.strip("/") in FLOW else w.longest
            w.tags[tag] = w.inline + most * max(0.0, 2 * b / (a + b) - 1)
    return w


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run of the highest sum, the shortest of equals that begin at the same place, the
    first of all equals; (0, 0) if none is above 0."""
    best, best_from, best_to, now, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best:
            best, best_from, best_to = now, start, i + 1
    return best_from, best_to


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region: blocks in page order joined by one space; empty if no region scores above 0."""
    row, low = tokens(page or "", weights.outside)
    link, scores = False, []
    for (kind, x), less in zip(row, low):
        if kind == "text":
            scores.append((weights.link_word if link or less else weights.word) * len(x.split()))
        elif kind == "skip":
            scores.append(-weights.skipped)
        else:
            link = x == "a" or (link and x != "/a")
            scores.append(weights.of(x))
    first, last = best_region(scores)
    parts = [x if kind == "text" else "" if x.strip("/") in INLINE else " " for kind, x in row[first:last]]
    return " ".join(html.unescape("".join(parts)).split())


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars (code points). Only labels are read from a sample: at most
    `sample` pages of at most `sample_bytes`, by hash of their id (of several pages of one id, the first by its text);
    every page is extracted from its whole html, however long.

    A null page, and one without a region of positive score, has an empty text. Repeated ids stay rows of their own. An
    empty table gives no rows; other columns are ignored whatever their names.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    short = p.where("id is not null").where(F.octet_length("html") <= sample_bytes)
    chosen = [r["id"] for r in short.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    labelled = short.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect() if chosen else []
    weights = learn([r["html"] for r in labelled])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [p.schema[c].dataType.simpleString() for c in ("id", "url")]
    return p.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
