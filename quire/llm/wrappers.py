"""Page wrappers as union-free regular expressions over token streams.

A page is read as a stream of block tags and texts. :func:`read_page` nests it
(with HTML's implied ends) and folds neighbouring repeats, so a list of any
length is one repeated group. :func:`align` brings two streams of one host
together: equal tags match, tags or groups that one of them lacks become
optional, runs that repeat become repeated groups, and texts that differ
become slots. The result is again such a stream, the wrapper, without unions:
each of its parts is there once, optionally, or repeated.

A wrapper is written as its shape (nested lists as JSON: label, flags, parts)
and the statistics of its texts in order (least and greatest digest, code
points, code points in links, pages), so texts of streams of equal shape merge
number by number.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left

import xxhash

#: Fixed HTML names: blocks, empty elements, elements whose content is not
#: markup, elements that never hold the article, containers, and implied ends.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CHROME_TAGS = frozenset("head nav aside footer header form button select dialog menu noscript template object svg canvas audio video label".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
}
CONTAINERS = frozenset("html body div section main article center form table tbody tr td".split())
HOLDS = frozenset("ul ol menu dir dl table td th body div section article main aside".split())
#: Words of class, id and role that name what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promoted promotion recommendations recommended related replies reply respond search share sharebar sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_NOT_IT = ("has", "with", "no", "without", "is")
MAX_DEPTH, MAX_PERIOD = 120, 4

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in RAW}
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


class Item:
    """A part of a stream: a text (``kids`` is None), an element, or a group
    of parts that repeat together. ``runs`` are a page's own texts."""

    __slots__ = ("label", "kids", "rep", "opt", "stat", "runs", "main", "region")

    def __init__(self, label: str, kids: list[Item] | None = None, stat: list[int] | None = None):
        self.label, self.kids, self.stat = label, kids, stat
        self.rep = self.opt = self.main = self.region = False
        self.runs: list[list] = []


def _names(attributes: str) -> tuple[str, bool, bool]:
    """What a tag's attributes add to its label, and whether they name
    boilerplate or the article."""
    label, chrome, main = "", False, False
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), _html.unescape("".join(value)).strip()
        if name == "itemprop":
            main |= value.lower() == "articlebody"
            continue
        if name == "role":
            main |= value.lower() == "main"
        for word in value.split():
            parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if p]
            if parts and parts[0] not in _NOT_IT:
                chrome |= parts[0] in CHROME_WORDS or parts[-1] in CHROME_WORDS
        label += {"class": ".", "id": "#", "role": "@"}[name] + re.sub(r"\d+", "0", _SPACES.sub(".", value))[:40]
    return label, chrome, main


def read_page(html: str) -> tuple[list[Item], list[list]]:
    """The folded stream of a page, and its texts in order: [block number,
    decoded text, text part]."""
    top = Item("", [])
    stack: list[tuple[str, Item]] = [("", top)]
    runs: list[list] = []
    block, in_link, strict, at, n = 0, False, True, 0, len(html)

    def text(raw: str) -> None:
        if not raw:
            return
        home = stack[-1][1].kids
        if not home or home[-1].label != "#t":
            if raw.isspace():  # between elements; inside a block it follows a text
                if runs and runs[-1][0] == block:
                    runs.append([block, " ", None])
                return
            home.append(Item("#t", None, [0, 0, 0, 0, 1]))
        run = [block, _html.unescape(raw) if "&" in raw else raw, home[-1]]
        home[-1].runs.append(run)
        runs.append(run)
        home[-1].stat[2] += len(run[1])
        if in_link:
            home[-1].stat[3] += len(run[1])

    def close(upto: int) -> None:
        del stack[upto:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            at = n if end < 0 else end + (3 if html.startswith("-->", end) else 1)
            continue
        m = None
        if nxt == "/" or nxt.isalpha():
            m = _TAG.match(html, lt) if strict else None
            if m is None:
                m = _LOOSE.match(html, lt)
                strict = strict and m is None  # a quote stays open: from here on, tags end at the next bracket
        if m is None:
            if nxt == "/" and html.find(">", lt) >= 0:  # a bogus end tag
                at = html.find(">", lt) + 1
            elif nxt.isalpha():  # cut off inside a tag
                at = n
            else:
                text("<")
                at = lt + 1
            continue
        at, ending, tag = m.end(), m.group(1), m.group(2).lower()
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            if tag in BLOCKS:
                block += 1
            if tag in BLOCKS or tag == "a":
                in_link = False
            continue
        if tag == "br":
            if runs:
                runs.append([block, " ", None])
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = html.find(">", end.end()) + 1 if end and html.find(">", end.end()) >= 0 else n
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        is_block = tag in BLOCKS
        if is_block:
            block, in_link = block + 1, False
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS.get(tag, ()):
                    close(k)
                elif stack[k][0] in HOLDS:
                    break
        in_link |= tag == "a"
        label, chrome, main = _names(m.group(3)) if m.group(3) else ("", False, False)
        chrome = (chrome or tag in CHROME_TAGS) and tag not in ("html", "body", "main")
        if tag == "article" and not re.search("comment|repl", label):
            chrome = False
        main = (main or tag in ("article", "main")) and not chrome
        if (is_block or chrome or main) and len(stack) < MAX_DEPTH:
            item = Item(("!" if chrome else "*" if main else "") + tag + label, [])
            stack[-1][1].kids.append(item)
            stack.append((tag, item))
    _fold_all(top)
    return top.kids, runs


def _fold_all(item: Item) -> None:
    """Fold an element's parts from the leaves up."""
    for k in item.kids:
        if k.kids is None:
            words = _SPACES.sub(" ", "".join(r[1] for r in k.runs)).strip()
            k.stat[0] = k.stat[1] = xxhash.xxh3_64_intdigest(words) >> 1
        else:
            _fold_all(k)
    item.kids = fold(item.kids)


def _group(parts: list[Item]) -> Item:
    return Item("(" + " ".join(p.label for p in parts) + ")", list(parts))


def merge(a: Item, b: Item) -> Item:
    """One part for two of equal label."""
    a.rep |= b.rep
    a.opt |= b.opt
    a.runs += b.runs
    if a.kids is None:
        x, y = a.stat, b.stat
        a.stat = [min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4] + y[4]]
    else:
        a.kids = align(a.kids, b.kids)
    return a


def fold(parts: list[Item]) -> list[Item]:
    """Neighbouring repeats, of one part or of up to ``MAX_PERIOD``, become
    one repeated part."""
    single: list[Item] = []
    for p in parts:
        if single and single[-1].label == p.label:
            single[-1] = merge(single[-1], p)
            single[-1].rep = True
        else:
            single.append(p)
    out: list[Item] = []
    for p in single:
        out.append(p)
        for k in range(2, min(MAX_PERIOD, len(out) - 1) + 1):
            tail = out[-k:]
            name = "(" + " ".join(x.label for x in tail) + ")"
            if out[-k - 1].label == name:
                one, first = out[-k - 1], len(out) - k - 1
            elif [x.label for x in out[-2 * k : -k]] == [x.label for x in tail]:
                one, first = _group(out[-2 * k : -k]), len(out) - 2 * k
            else:
                continue
            one.rep = True
            out[first:] = [merge(one, _group(tail))]
            break
    return out


def _regroup(parts: list[Item], other: list[Item]) -> list[Item]:
    """Runs of parts that are one group in the other stream become one here."""
    have = {p.label for p in parts}
    for g in other:
        if g.label.startswith("(") and g.label not in have:
            k, out, i = len(g.kids), [], 0
            while i < len(parts):
                if [p.label for p in parts[i : i + k]] == [p.label for p in g.kids]:
                    out.append(_group(parts[i : i + k]))
                    i += k
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
    return parts


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of very long lists, of a common
    subsequence taken from the left."""
    if len(a) * len(b) > 40_000:
        spots: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            spots.setdefault(x, []).append(i)
        out, low = [], 0
        for j, y in enumerate(b):
            s = spots.get(y, [])
            k = bisect_left(s, low)
            if k < len(s):
                out.append((s[k], j))
                low = s[k] + 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of two streams."""
    if [x.label for x in a] == [x.label for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    a, b = _regroup(a, b), _regroup(b, a)
    out, i, j = [], 0, 0
    for x, y in [*matches([p.label for p in a], [p.label for p in b]), (len(a), len(b))]:
        for lone in a[i:x] + b[j:y]:
            lone.opt = True
            out.append(lone)
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def write(parts: list[Item]) -> tuple[str, list[list[int]]]:
    """Shape and text statistics of a stream."""
    stats: list[list[int]] = []

    def shape(p: Item):
        flags = p.rep + 2 * p.opt + 4 * p.main + 8 * p.region
        if p.kids is None:
            stats.append(p.stat)
            return [p.label, flags]
        return [p.label, flags, [shape(k) for k in p.kids]]

    return json.dumps([shape(p) for p in parts], ensure_ascii=False, separators=(",", ":")), stats


def read(shape: str, stats: list[list[int]] | None = None) -> list[Item]:
    """The stream that was written."""
    left = iter(stats or [])

    def item(x) -> Item:
        p = Item(x[0], None if len(x) == 2 else [], [0] * 5 if len(x) == 2 else None)
        p.rep, p.opt, p.main, p.region = (bool(x[1] & f) for f in (1, 2, 4, 8))
        if p.kids is None:
            p.stat = list(next(left, p.stat))
        else:
            p.kids = [item(k) for k in x[2]]
        return p

    return [item(x) for x in json.loads(shape)]


def regex(parts: list[Item]) -> str:
    """The wrapper as a readable expression: ``#`` a slot, ``=`` a fixed text."""

    def one(p: Item) -> str:
        if p.kids is None:
            body = "=" if p.stat[0] == p.stat[1] else "#"
        elif p.label.startswith("("):
            body = "".join(map(one, p.kids))
        else:
            body = f"<{p.label.lstrip('!*')}>" + "".join(map(one, p.kids)) + "</>"
        mark = {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[(int(p.rep), int(p.opt))]
        return f"({body}){mark}" if mark else body

    return "".join(map(one, parts))


def decide(parts: list[Item], pages: int, least_pages: int = 3, share: float = 0.7) -> None:
    """Mark the text slots that hold the article.

    ``main``: inside an article or main element (articles inside a main
    element count alone), and in nothing that is named as boilerplate; of a
    header in there, its headings. ``region``, for pages without such an
    element: texts that vary between pages, in the smallest container that
    holds ``share`` of the variable text; where too few pages are known, or none of
    them vary, all texts count as variable.
    """
    tag = lambda p: re.split(r"[.#@]", p.label.lstrip("!*"), maxsplit=1)[0]

    def has_article(items: list[Item]) -> bool:
        return any((p.label.startswith("*article")) or has_article(p.kids or []) for p in items)

    def walk(items: list[Item], state: str, head: bool, article_only: bool) -> None:
        for p in items:
            if p.kids is None:
                p.main = state == "main" or (state == "header" and head)
                continue
            now, only = state, article_only
            if p.label.startswith("!"):
                now = "header" if state in ("main", "header") and tag(p) == "header" else "form" if tag(p) == "form" and state in ("", "form") else "chrome"
            elif p.label.startswith("*") and state in ("", "form"):
                if tag(p) == "article" or not article_only:
                    only = tag(p) != "article" and has_article(p.kids)
                    now = "" if only else "main"
            walk(p.kids, now, head or bool(re.fullmatch("h[1-6]", tag(p))), only)

    walk(parts, "", False, False)

    def weight(p: Item, every: bool) -> int:
        if p.label.startswith("!"):
            return 0
        if p.kids is None:
            varies = every or pages < least_pages or p.stat[0] != p.stat[1]
            return max(p.stat[2] - 2 * p.stat[3], 0) if varies else 0
        return sum(weight(k, every) for k in p.kids)

    every = not sum(weight(p, False) for p in parts)
    here = parts
    while True:
        whole = sum(weight(p, every) for p in here)
        inner = [p for p in here if p.kids and not p.rep and tag(p) in CONTAINERS and whole and weight(p, every) >= share * whole]
        if not inner:
            break
        here = inner[0].kids

    def mark(items: list[Item]) -> None:
        for p in items:
            if p.kids is None:
                p.region = every or pages < least_pages or p.stat[0] != p.stat[1]
            elif not p.label.startswith("!"):
                mark(p.kids)

    mark(here)


def _settle(part: Item, texts: Item | None = None) -> None:
    """Texts of a page's part are judged by ``texts``, or by their own parts."""
    for r in part.runs:
        r[2] = texts or part
    for k in part.kids or ():
        _settle(k)


def pick(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """Let the wrapper's slots judge the page's texts; parts of the page that
    match nothing of the wrapper are returned."""
    if [x.label for x in wrapper] == [x.label for x in page]:
        pairs, rest = list(zip(wrapper, page)), []
    else:
        page = _regroup(page, wrapper)
        found = matches([x.label for x in wrapper], [x.label for x in page])
        pairs, rest = [(wrapper[i], page[j]) for i, j in found], [page[j] for j in sorted(set(range(len(page))) - {j for _, j in found})]
    for w, p in pairs:
        if p.kids is None:
            _settle(p, w)
        else:
            rest += pick(w.kids, p.kids)
    return rest


def judge_page(wrapper: list[Item], page: list[Item]) -> None:
    """Judge all texts of a page by the wrapper, and what it lacks by the page
    alone."""
    rest = pick(wrapper, page)
    if rest:
        decide(page, 1)
        for p in rest:
            _settle(p)


def article(runs: list[list]) -> str:
    """The blocks of a page's marked texts, joined by an empty line."""
    marked = [r[2] for r in runs if r[2] is not None and not r[1].isspace()]
    by_main = any(p.main for p in marked)
    blocks: dict[int, list[str]] = {}
    for no, text, part in runs:
        if part is None:
            if no in blocks:
                blocks[no].append(text)
        elif part.main if by_main else part.region:
            blocks.setdefault(no, []).append(text)
    clean = (_SPACES.sub(" ", "".join(b)).strip(" ") for b in blocks.values())
    return "\n\n".join(b for b in clean if b)
