"""Main text of web pages by tag-path ratios.

A page becomes its text blocks, each with the root-to-leaf path of its block elements. Text length and
punctuation outside links are summed per path and divided by the path's blocks; the two ratios are fused to a
score. Scores are smoothed over neighbouring blocks, averaged per path again and held against their standard
deviation and mean: the paths above are content. Names of elements and attributes that mark menus, adverts and the
like are a help alone: each mark around a block divides its path's score. Marks around the whole main text count for
nothing: those around an article or main element with text of its own, or else around what holds nearly all text.
The bar is that of blocks without marks, so a long marked block does not lower it.

The content blocks choose the innermost container that holds nearly all their text. It grows to containers that
add headings only, and to the article or main element around it. In such an element the page's text is every block that
no mark excludes, without boxes of links alone; in any other container it is the content blocks, what lies between two of
them, and the headings before one. Content blocks elsewhere come with their own containers, or alone where that is one
around it. All steps are linear in the page, up to a logarithm.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

#: Element names by their role in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
ASIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp"}
CONTAINER = {"body", "div", "section", "td", "center", "header", "footer", "nav", "aside", "form"}
WHOLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role attributes that mark what is not the article.
MARKED = set(
    "ad ads adbox adsense advert advertisement advertising alert banner breadcrumb breadcrumbs byline-ad cc-banner comment comments commentlist complementary consent contentinfo cookie cookies cookiebar copyright dialog disqus disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promotion promoted recommended related respond responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
HEADER = {"header", "heading-bar", "topbar", "site-header", "page-header"}
#: A tag with its quoted attributes, in one pass without going back; one that ends at the first ">"; other markup.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TELLING = re.compile(r"class|id|role|style|hidden", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}
PUNCTUATION = ",.;:!?…、。，；：！？"
_PUNCTUATION = re.compile(f"[{PUNCTUATION}]")
#: What a mark divides a path's score by, marks that count at most; the share of the content that the chosen container
#: holds at least.
MARK, MARKS, SHARE = 2**20, 8, 0.75
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_LIMITS = {"ul", "ol", "dl", "table", "div", "article", "section", "body"}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def aside(name: str, text: str, inside: bool) -> tuple[bool, str | None]:
    """(hidden, mark) of an element with the attributes ``text``; ``inside``: within an article.

    What is hidden holds no article text; what has a mark, the names that hold a telling word, holds none as a rule, and
    its text weighs less.
    """
    mark = "" if name in ASIDE or name == "header" and not inside else None
    if not text.strip():
        return name in HIDDEN, mark
    found = attributes(text)
    hidden = name in HIDDEN or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    words = {w for k in ("class", "id", "role") for part in found.get(k, "").lower().split() for w in (part, *re.split(r"[-_]+", part))}
    if name in ("html", "body") or name in WHOLE and found.get("class", "").lower() not in MARKED:
        return hidden, mark
    telling = words & MARKED or (set() if inside else words & HEADER)
    return hidden, " ".join(found.get(k, "").lower() for k in ("class", "id", "role")) if telling else mark


def tags(html: str):
    """(start, end, name, attributes, closing) of every tag and, with an empty name, of comments and other markup.

    A tag whose quotes never close ends at its first ">"; from there on quotes are not minded, so that no part of a
    page is read twice. A "<" that no ">" follows is text.
    """
    at, loose, last = 0, False, html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", "", False
        elif at > last:
            return
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1
            yield at, end, "", "", False
        else:
            m = None if loose else _TAG.match(html, at)
            if m is None and html[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                m = _LOOSE.match(html, at)
                loose = loose or m is not None
            if m is None:
                at += 1
                continue
            end, name = m.end(), m[2].lower()
            if name in RAW and not m[1] and not m[3].rstrip().endswith("/"):
                stop = _RAW_END[name].search(html, end)
                end, name = stop.end() if stop else len(html), ""
            elif name in RAW:
                name = ""
            yield at, end, name, m[3], bool(m[1])
        at = end


class Page:
    """Text blocks of a page and the trees of their paths, containers and marks; a tree is a list of parents.

    ``blocks``: [path, container, mark, heading, parts, characters, punctuation, all characters, inside an article], characters
    and punctuation outside links. An open
    paragraph ends where a block begins, a list item, cell or row where the next one does; other end tags close the
    nearest element of their name.
    """

    def __init__(self, html: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.marks, self.containers, self.whole = [-1], [-1], [False]
        self.blocks: list[list] = []
        # Name, path, container, mark (None: hidden), inside an article, inside a link, inside a heading.
        stack: list[tuple] = [("", 0, 0, 0, False, False, False)]
        places: dict[str, list[int]] = {}
        bounds = [0]  # places of the elements that no implied end crosses
        outer = [0]  # places of the elements that no inline element's end crosses
        at, fresh = 0, True

        def cut(depth: int) -> None:
            while len(stack) > depth:
                places[stack.pop()[0]].pop()
            for own in (bounds, outer):
                while own[-1] >= depth and len(own) > 1:
                    own.pop()

        def text(part: str) -> None:
            nonlocal fresh
            _, path, container, mark, inside, linked, heading = stack[-1]
            part = re.sub(r"\s+", " ", unescape(part)) if part != " " else part
            if mark is None or not part:
                return
            if fresh:
                self.blocks.append([path, container, mark, heading, [], 0, 0, 0, inside])
                fresh = False
            own = self.blocks[-1]
            own[4].append(part)
            own[7] += len(part.strip())
            if not linked:
                own[5] += len(part.strip())
                own[6] += len(_PUNCTUATION.findall(part))

        for start, end, name, attrs, closing in tags(html):
            if start > at:
                text(html[at:start])
            at = end
            if not name:
                continue
            if name == "br":
                text(" ")
                continue
            if name not in INLINE:
                fresh = True
            if closing:
                own = places.get(name)
                if own and not (name in INLINE and outer[-1] > own[-1]):
                    cut(own[-1])
                continue
            closes = _CLOSES.get(name, set() if name in INLINE else {"p"})
            limit = 0 if name == "body" else bounds[-1] + 1
            ended = [own[i] for x in closes if (own := places.get(x)) and (i := bisect_left(own, limit)) < len(own) and own[i]]
            if ended:
                cut(min(ended))
            if name in VOID or attrs.rstrip().endswith("/"):
                continue
            _, path, container, mark, inside, linked, heading = stack[-1]
            inside = inside or name in WHOLE
            if mark is not None:
                hidden, told = aside(name, attrs if _TELLING.search(attrs) else "", inside)
                if hidden:
                    mark = None
                elif told is not None:
                    self.marks.append(mark)
                    mark = len(self.marks) - 1
                if name in CONTAINER or name in WHOLE:
                    self.containers.append(container)
                    self.whole.append(name in WHOLE)
                    container = len(self.containers) - 1
                if name not in INLINE:
                    step = (path, name if told is None else f"{name}!{told}")
                    path = self.paths.setdefault(step, len(self.paths) + 1)
            places.setdefault(name, []).append(len(stack))
            if name in _LIMITS:
                bounds.append(len(stack))
            if name not in INLINE:
                outer.append(len(stack))
            stack.append((name, path, container, mark, inside, linked or name == "a", heading or name in HEADINGS))
        text(html[at:])


def depths(parents: list[int]) -> list[int]:
    out = [0] * len(parents)
    for i in range(1, len(parents)):
        out[i] = out[parents[i]] + 1
    return out


def main_mark(blocks: list[list], marks: list[int]) -> int:
    """The innermost mark around the main text, 0 for none: the one with the fewest marks around it that has text of an
    article itself, other than headings. Without such text it is none, if a tenth of what the fullest mark holds stands
    without one, else the fullest."""
    deep = depths(marks)
    told, own = {}, [0.0] * len(marks)
    for b in blocks:
        if b[5] and not b[3]:
            own[b[2]] += b[5] * (1 + b[6])
            if b[8]:
                told[b[2]] = told.get(b[2], 0) + b[5]
    if told:
        return min(told, key=lambda m: (deep[m], -told[m], m))
    fullest = max(range(len(marks)), key=lambda m: (own[m], -m))
    return 0 if own[0] >= own[fullest] / 10 else fullest


def marks_around(marks: list[int], main: int) -> list[int]:
    """How many marks count around what is within each mark: those around ``main``, and itself, do not."""
    void = {0}
    while main > 0:
        void.add(main)
        main = marks[main]
    out = [0] * len(marks)
    for i in range(1, len(marks)):
        out[i] = out[marks[i]] + (i not in void)
    return out


def path_scores(blocks: list[list], around: list[int]) -> dict[int, float]:
    """Fused ratio of each path: characters a block times one plus punctuation a block, less for marks around it."""
    sums: dict[int, list[float]] = {}
    for path, _, mark, _, _, chars, punctuation, *_ in blocks:
        own = sums.setdefault(path, [0, 0, 0, around[mark]])
        own[3] = min(own[3], around[mark])
        own[0] += 1
        own[1] += chars
        own[2] += punctuation
    return {path: chars / n * (1 + punctuation / n) / MARK ** min(MARKS, deep) for path, (n, chars, punctuation, deep) in sums.items()}


def smoothed(scores: list[float], runs: list) -> list[float]:
    """Weighted mean of each score and its two neighbours on either side, of the same run (container and mark) only."""
    out, n = [], len(scores)
    for i in range(n):
        total = weight = 0.0
        for d, w in ((-2, 1), (-1, 2), (0, 4), (1, 2), (2, 1)):
            if 0 <= i + d < n and runs[i + d] == runs[i]:
                total += w * scores[i + d]
                weight += w
        out.append(total / weight)
    return out


def content_blocks(blocks: list[list], around: list[int]) -> list[bool]:
    """Which blocks are content: those of the paths whose smoothed score reaches the standard deviation of the scores,
    and half of the score that a character without marks has on average (any character, if none is without)."""
    score = path_scores(blocks, around)
    near = smoothed([score[b[0]] for b in blocks], [(b[1], b[2]) for b in blocks])
    mean = sum(near) / len(near)
    spread = sqrt(sum((x - mean) ** 2 for x in near) / len(near))
    of_path: dict[int, list[float]] = {}
    for b, x in zip(blocks, near):
        of_path.setdefault(b[0], []).append(x)
    fused = {path: sum(x) / len(x) for path, x in of_path.items()}
    bare = [not around[b[2]] for b in blocks]
    if not any(b[5] for b, x in zip(blocks, bare) if x):
        bare = [True] * len(blocks)
    usual = sum(b[5] * x for b, x, own in zip(blocks, near, bare) if own) / sum(b[5] for b, own in zip(blocks, bare) if own)
    least = min(max(spread, usual / 2), max(fused[b[0]] for b, own in zip(blocks, bare) if own))
    return [fused[b[0]] >= least and b[5] > 0 for b in blocks]


def summed(values: list[float], parents: list[int]) -> list[float]:
    """Sums over subtrees; parents come before their children."""
    out = values[:]
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def chosen_blocks(blocks: list[list], content: list[bool], dead: list[bool], parents: list[int], whole: list[bool]) -> list[bool]:
    """Which blocks are the page's text; ``dead`` are marks that exclude, ``whole`` containers that are articles."""

    def over(size, keep):
        own = [0.0] * len(parents)
        for b, c in zip(blocks, content):
            if keep(b, c):
                own[b[1]] += b[size]
        return summed(own, parents)

    held = over(5, lambda b, c: c)
    other = over(7, lambda b, c: not (c or b[3] or dead[b[2]]))
    chosen = max(i for i in range(len(parents)) if held[i] >= SHARE * held[0])
    up = chosen
    while up:
        up = parents[up]
        if whole[up] or other[up] == other[chosen]:
            chosen = up
    inside, around = [False] * len(parents), {chosen}
    while (i := parents[min(around)]) >= 0:
        around.add(i)
    homes = {b[1] for b, c in zip(blocks, content) if c} - around | {chosen}
    named, told = [False] * len(parents), over(5, lambda b, c: not (b[3] or dead[b[2]]))  # text outside links and headings
    linked = over(7, lambda b, c: not (b[3] or dead[b[2]]))
    for i in range(len(parents)):
        up = parents[i]
        inside[i] = i in homes or i > 0 and inside[up]
        named[i] = whole[i] or i > 0 and named[up]
        if inside[i] and i not in homes and linked[i] and not told[i]:
            inside[i] = False  # a box of links alone
    alive = [not dead[b[2]] and (inside[b[1]] or c) for b, c in zip(blocks, content)]
    kept = [a and (c or named[b[1]]) for a, b, c in zip(alive, blocks, content)]
    # In other containers, what lies between two content blocks of the same home, and headings before one.
    home, last = list(range(len(parents))), {}
    for i in range(1, len(parents)):
        if inside[i] and inside[parents[i]]:
            home[i] = home[parents[i]]
    for i, (b, c) in enumerate(zip(blocks, content)):
        if c and alive[i]:
            for j in last.get(home[b[1]], ()):
                kept[j] = alive[j]
            last[home[b[1]]] = []
        elif home[b[1]] in last and alive[i]:
            last[home[b[1]]].append(i)
    following = False
    for i in range(len(blocks) - 1, -1, -1):
        if alive[i] and not kept[i] and blocks[i][3] and following:
            kept[i] = True
        following = kept[i] or following and not alive[i]
    return kept


def main_text(html: str | None) -> str:
    """The page's text, its blocks joined by \n; empty if no block has text outside links."""
    page = Page(html or "")
    blocks = [b for b in page.blocks if any(p != " " for p in b[4])]
    if not any(b[5] for b in blocks):
        return ""
    around = marks_around(page.marks, main_mark(blocks, page.marks))
    content = content_blocks(blocks, around)
    # A mark that holds content is none; nor is one around it.
    live = [0.0] * len(page.marks)
    for b, c in zip(blocks, content):
        live[b[2]] += c * b[5]
    live, dead = summed(live, page.marks), [False] * len(page.marks)
    for i in range(1, len(page.marks)):
        dead[i] = dead[page.marks[i]] or not live[i]
    kept = ("".join(b[4]) for b, k in zip(blocks, chosen_blocks(blocks, content, dead, page.containers, page.whole)) if k)
    lines = (re.sub(" +", " ", x).strip(" ") for x in kept)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of ``html``.

    A null, empty or textless page has an empty text; a page of any length is read whole. Repeated rows stay
    repeated, an empty table stays empty; other columns stay, but for ones named text or n_chars. Of containers that
    hold as much of the content, the innermost and last one is taken.
    """
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]  # as Spark compares names
    small_batches(pages.sparkSession)
    texts = F.udf(main_text, "string", useArrow=True)
    step = pages.select(*[F.col(f"`{c}`") for c in kept], texts(F.col(f"`{html}`")).alias("text"))
    return step.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
