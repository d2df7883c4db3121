"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks at block-level tags.  A logistic classifier, trained here
on pages that a seeded generator writes, gives each block log-odds of being article text;
scaled, they become capacities to the two terminals.  Neighbours in page order (the nearer
in the element tree, the stronger) and blocks under the same parent or grandparent are
joined by smoothness edges.  The minimum cut separates article from the rest: a short
paragraph among long ones, or a wordy line in a menu, follows its neighbours.  Scale and
edge weights are those with the best F1 on generated pages that the classifier has not
seen.  Blocks that no cut can flip (their terminal outweighs all their edges) are set
aside first, and Dinic's max-flow solves what is left.

Defined cases: null or empty html gives an empty text.  Script, style, title, textarea and
their like are read to their own closing tag; without one only the text up to the next tag
goes.  Other hidden elements (svg, select, canvas, ...) hide what stands up to their closing
tag if it comes before their parent's; self-closing forms and those without a closing tag
hide nothing, and an option without one hides the text up to the next tag.  Unclosed comments
and quotes are read to the end of the page; repeated rows are judged alike; extra columns
are ignored; nothing is cut off, however long the page.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

_TOKEN = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*+)>""")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_GAP = re.compile(r"\s+")

#: HTML element names by how they are read.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_HIDDEN = frozenset("noscript template svg math select datalist optgroup option object canvas audio video head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notice|gdpr|popup|modal|comments?|replies|disqus|related|share|social|widget|form|login|newsletter|subscribe|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|main|text|page)(?:$|[\s_-])", re.I)
_STOPS = ".!?…。:;"


class Block:
    __slots__ = ("text", "link", "parent", "above", "tag", "boiler", "bad", "good", "article", "header")

    def __init__(self, text, link, parent, above, tag, flags):
        self.text, self.link, self.parent, self.above, self.tag = text, link, parent, above, tag
        self.boiler, self.bad, self.good, self.article, self.header = flags


#: Elements that the next one of their kind ends.
_ENDS_ITSELF = frozenset("li td th tr dd dt option".split())
_LEAVES = frozenset(["p", "li", "td", "th", "dd", "dt", *_HEADINGS])


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, text) of a page: kind is text, open, close or single (void or self-closing); comments and raw elements are gone."""
    out: list[tuple[str, str, str]] = []
    closers: dict[str, tuple[re.Pattern, int]] = {}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            out.append(("text", "", page[at:]))
            break
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if m[0] == "<!--":
            to = page.find("-->", at)
            at = n if to < 0 else to + 3
            continue
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            out.append(("close", tag, ""))
        elif attributes.endswith("/") and tag not in _INLINE or tag in _VOID:
            out.append(("single", tag, attributes))
        elif tag in _RAW:
            if tag not in closers:
                closer = re.compile(rf"</{tag}\b[^>]*>?", re.I)
                closers[tag] = closer, max((c.start() for c in closer.finditer(page)), default=-1)
            closer, last = closers[tag]
            if last >= at:
                at = closer.search(page, at).end()
            elif tag != "iframe":  # never closed: only what cannot be markup is its own
                to = page.find("<", at)
                at = n if to < 0 else to
        else:
            out.append(("open", tag, attributes))
    return out


def _closed(found: list[tuple[str, str, str]]) -> set[int]:
    """Places of hidden elements whose own closing tag comes before their parent's."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    for k, (kind, tag, _) in enumerate(found):
        if kind == "open" and tag not in _INLINE:
            stack.append((tag, k))
            opened[tag] = opened.get(tag, 0) + 1
        elif kind == "close" and opened.get(tag):
            while True:
                name, place = stack.pop()
                opened[name] -= 1
                if name == tag:
                    if tag in _HIDDEN:
                        out.add(place)
                    break
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; script, style and other hidden elements never become text."""
    found = tokens(page)
    closed = _closed(found)
    out: list[Block] = []
    stack: list[tuple[str, int, tuple]] = [("", 0, (False,) * 5)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    link = hidden = serial = 0
    in_link = skip = False

    def flush() -> None:
        nonlocal pieces, link, in_link
        if pieces:
            text = _GAP.sub(" ", _html.unescape("".join(pieces))).strip()
            if text:
                k = len(stack) - 1 if stack[-1][0] not in _LEAVES else len(stack) - 2
                out.append(Block(text, min(link, len(text)), stack[k][1], stack[max(k - 1, 0)][1], stack[-1][0], stack[-1][2]))
            pieces = []
        link = 0
        in_link = False

    def pop() -> str:
        nonlocal hidden
        name = stack.pop()[0]
        opened[name] -= 1
        hidden -= name in _HIDDEN
        return name

    for k, (kind, tag, rest) in enumerate(found):
        if kind == "text":
            if not hidden and not skip:
                pieces.append(rest)
                link += len(rest) * in_link
            continue
        skip = False
        if tag in _INLINE:
            if tag == "a":
                in_link = kind == "open"
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag in _HIDDEN and kind == "open" and k not in closed:
            skip = tag == "option"
            continue
        if tag not in _HIDDEN and not hidden:
            flush()
        if kind == "close":
            if opened.get(tag):
                while pop() != tag:
                    pass
        elif kind == "open":
            if not hidden and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in _ENDS_ITSELF)):
                pop()
            serial += 1
            opened[tag] = opened.get(tag, 0) + 1
            if tag in _HIDDEN:
                hidden += 1
                stack.append((tag, serial, stack[-1][2]))
                continue
            boiler, bad, good, article, header = stack[-1][2]
            hint = " ".join(x[0] or x[1] or x[2] for x in _HINT.findall(rest)) if rest else ""
            boiler = boiler or tag in _BOILER_TAGS
            header = header or (tag == "header" and not article)
            bad = bad or bool(hint and _BAD.search(hint))
            good = good or bool(hint and _GOOD.search(hint))
            article = article or tag in ("article", "main")
            stack.append((tag, serial, (boiler, bad, good, article, header)))
    flush()
    return out


def features(b: Block, before: Block | None, after: Block | None) -> list[float]:
    words = b.text.count(" ") + 1
    size = len(b.text)
    return [
        1.0, float(b.boiler), float(b.bad), float(b.good and not b.bad), float(b.article and not b.bad and not b.boiler), float(b.header),
        min(1.0, b.link / size), math.log1p(words) / 4, float(b.text[-1] in _STOPS), float(b.tag == "p"), float(b.tag in _HEADINGS), float(b.tag in ("li", "td", "dd")),
        math.log1p(before.text.count(" ") + 1) / 4 if before else 0.0, math.log1p(after.text.count(" ") + 1) / 4 if after else 0.0,
    ]


TRAIN_PAGES = 360


def training_pages(n: int = TRAIN_PAGES, seed: int = 11) -> Iterator[str]:
    """Pages whose boilerplate texts carry the mark ¤, which no feature sees.

    Half of them say by tags and class names what is what; in the others containers are bare or misleading, and article
    paragraphs may be as short as menu entries, so that a block alone cannot always tell.
    """
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    few = lambda a, b: int(r.integers(a, b))
    word = lambda: "".join(pick("th er on an in re la de ou ti es".split()) for _ in range(few(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k)) + pick([".", ".", ".", "!", "?", ""])
    boil = lambda k: text(k) + "¤"
    for _ in range(n):
        told = r.random() < 0.5
        name = lambda *xs: f' class="{pick(xs)}"' if told else pick(["", "", ' class="box"', ' class="row c2"', ' id="x7"'])  # noqa: E731, B023
        links = lambda: "".join(f'<li><a href="/x">{boil(few(1, 5))}</a></li>' for _ in range(few(2, 9)))
        mixed = lambda: "".join(f"<li>{boil(few(2, 12))}</li>" if r.random() < 0.2 else f'<li><a href="/x">{boil(few(1, 4))}</a></li>' for _ in range(few(3, 9)))
        plain = lambda a, z: "".join(f"<p>{boil(few(a, z))}</p>" for _ in range(few(1, 4)))
        around = [
            lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div{name('menu', 'nav-bar', 'top-menu')}><ul>{mixed()}</ul></div>", lambda: f"<header><div>{boil(few(1, 8))}</div></header>",  # noqa: B023
            lambda: f"<div{name('ad', 'ads', 'advert', 'sponsored')}>{boil(few(4, 25))}</div>", lambda: f"<aside>{plain(3, 30)}</aside>",  # noqa: B023
            lambda: f"<div{name('sidebar', 'widget')}><h3>{boil(few(1, 4))}</h3><ul>{mixed()}</ul></div>", lambda: f"<form><p>{boil(few(2, 12))}</p></form>",  # noqa: B023
            lambda: f"<div{name('cookie-notice', 'consent', 'cookie')}><p>{boil(few(4, 20))}</p></div>", lambda: f"<footer>{boil(few(3, 16))}</footer>",  # noqa: B023
            lambda: f"<div{name('footer')}><p>{boil(few(3, 12))}</p></div>", lambda: f'<{(t := pick(["section", "div"]))} class="comments">{plain(2, 40)}</{t}>',  # noqa: B023
            lambda: f"<ul>{links()}</ul>", lambda: f"<div>{boil(few(1, 5))}</div>", lambda: "".join(f'<article class="teaser"><h3><a href="/y">{boil(few(2, 6))}</a></h3></article>' for _ in range(few(2, 5))),
        ]
        short = 0.2 if told else 0.45
        one = lambda: text(few(1, 6)) if r.random() < short else text(few(8, 120))  # noqa: E731, B023
        body = f"<h1>{text(few(3, 10))}</h1>" + "".join(f"<p>{one()}{pick(['</p>', ''])}" for _ in range(few(2, 12)))
        if r.random() < 0.3:
            body += f"<h2>{text(few(2, 6))}</h2><ul>" + "".join(f"<li>{text(few(2, 20))}</li>" for _ in range(few(2, 5))) + f"</ul><p>{text(few(10, 60))}</p>"
        if r.random() < 0.15:
            body += f'<div class="ad">{boil(few(4, 14))}</div><p>{text(few(20, 60))}</p>'
        clear = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>")]
        a, z = pick(clear) if told else pick([*clear[:1], ("<div>", "</div>"), ('<div class="box">', "</div>")])
        a0, z0 = pick([("", ""), ('<div class="page">', "</div>"), ("<main>", "</main>")]) if r.random() < 0.3 else ("", "")
        yield f"<html><body>{a0}" + "".join(pick(around)() for _ in range(few(0, 4))) + a + body + z + "".join(pick(around)() for _ in range(few(0, 4))) + f"{z0}</body></html>"


def labelled(pages: list[str]) -> list[tuple[list[Block], np.ndarray, np.ndarray]]:
    """(blocks, features, 1 for article text) of generated pages."""
    out = []
    for page in pages:
        bs = blocks(page)
        y = np.array([0.0 if "¤" in b.text else 1.0 for b in bs])
        for b in bs:
            b.text = b.text.replace("¤", "") or "x"
        out.append((bs, np.array([features(b, bs[i - 1] if i else None, bs[i + 1] if i + 1 < len(bs) else None) for i, b in enumerate(bs)]), y))
    return out


def f1(kept: list[np.ndarray], truth: list[np.ndarray]) -> float:
    k, t = np.concatenate(kept) > 0, np.concatenate(truth) > 0
    return float(2 * (k & t).sum() / max(1, k.sum() + t.sum()))


@dataclass(frozen=True)
class Model:
    """Classifier weights, the scale of its log-odds, and the edges' weights."""

    weights: tuple[float, ...]
    scale: float
    adjacent: float
    sibling: float


MOST = 8.0
#: What calibration chooses from: scale of the log-odds, weight of neighbours in page order, weight of siblings.
SCALES, ADJACENT, SIBLING = (0.5, 1.0), (0.4, 0.8, 1.2), (0.2, 0.4, 0.8, 1.6)


def logits(x: np.ndarray, w: tuple[float, ...]) -> np.ndarray:
    return np.clip(x @ np.array(w), -MOST, MOST)


def smoothness(bs: list[Block], adjacent: float, sibling: float) -> list[tuple[int, int, float]]:
    """Edges of neighbours in page order, by their distance in the element tree, and of consecutive blocks of one parent or grandparent."""
    edges = []
    for i in range(len(bs) - 1):
        a, b = bs[i], bs[i + 1]
        edges.append((i, i + 1, adjacent * (1.0 if a.parent == b.parent else 0.5 if a.above == b.above or a.parent == b.above or a.above == b.parent else 0.25)))
    last: dict[int, int] = {}
    upper: dict[int, int] = {}
    for i, b in enumerate(bs):
        if b.parent in last:
            edges.append((last[b.parent], i, sibling))
        elif b.above in upper:
            edges.append((upper[b.above], i, sibling / 2))
        last[b.parent] = upper[b.above] = i
    return edges


def fit(x: np.ndarray, t: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (t - p) - w)
    return tuple(float(v) for v in w)


@lru_cache(maxsize=1)
def model() -> Model:
    """Weights from two thirds of the generated pages; scale and edges with the best F1 on the others (ties: least edges)."""
    data = labelled(list(training_pages()))
    seen, held = [d for i, d in enumerate(data) if i % 3], data[::3]
    w = fit(np.concatenate([d[1] for d in seen]), np.concatenate([d[2] for d in seen]))
    logit = [logits(d[1], w) for d in held]
    best = (-1.0, 0.0, None)
    for scale in SCALES:
        for a in ADJACENT:
            for s in SIBLING:
                kept = [np.array(max_flow_labels((scale * z).tolist(), smoothness(d[0], a, s))) for d, z in zip(held, logit, strict=True)]
                best = max(best, (round(f1(kept, [d[2] for d in held]), 6), -a - s, Model(w, scale, a, s)), key=lambda b: b[:2])
    return best[2]


def max_flow_labels(logit: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the source side of the minimum cut: logit > 0 pulls to the source, each edge costs its weight when cut."""
    n = len(logit)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    pull, label, todo = list(logit), [None] * n, deque(range(n))
    while todo:  # a block whose terminal outweighs its edges is on that side in every minimum cut
        i = todo.popleft()
        if label[i] is None and abs(pull[i]) >= sum(near[i].values()):
            label[i] = pull[i] > 0
            for j, w in near[i].items():
                pull[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {v: k for k, v in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        graph: list[list[int]] = [[] for _ in range(t + 1)]
        to: list[int] = []
        cap: list[int] = []

        def add(u: int, v: int, there: float, back: float) -> None:
            graph[u].append(len(to))
            to.append(v)
            cap.append(round(there * 4096))
            graph[v].append(len(to))
            to.append(u)
            cap.append(round(back * 4096))

        for i in rest:
            add(s, place[i], max(pull[i], 0.0), 0.0)
            add(place[i], t, max(-pull[i], 0.0), 0.0)
            for j, w in near[i].items():
                if j > i:
                    add(place[i], place[j], w, w)
        while True:
            level = [-1] * (t + 1)
            level[s] = 0
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in graph[u]:
                    if cap[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[t] < 0:
                break
            used = [0] * (t + 1)
            path: list[int] = []
            u = s
            while True:  # depth first without recursion
                if u == t:
                    flow = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    cut = next(k for k, e in enumerate(path) if cap[e] == 0)
                    u = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while used[u] < len(graph[u]):
                    e = graph[u][used[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        break
                    used[u] += 1
                else:
                    if u == s:
                        break
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                    continue
                path.append(e)
                u = to[e]
        for i in rest:
            label[i] = level[place[i]] >= 0
    return [bool(x) for x in label]


def labels(bs: list[Block], m: Model) -> tuple[list[bool], list[bool]]:
    """(labels by the cut, by the classifier alone) of a page's blocks."""
    x = np.array([features(b, bs[i - 1] if i else None, bs[i + 1] if i + 1 < len(bs) else None) for i, b in enumerate(bs)])
    logit = (m.scale * logits(x, m.weights)).tolist()
    return max_flow_labels(logit, smoothness(bs, m.adjacent, m.sibling)), [z > 0 for z in logit]


def main_text(page: str | None, m: Model | None = None) -> str:
    bs = blocks(page) if page else []
    if not bs:
        return ""
    return "\n\n".join(b.text for b, keep in zip(bs, labels(bs, m or model())[0], strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns and ``text``, one row a page.  One narrow pass; the model is 17 numbers, trained once on the driver."""
    small_batches(pages)
    pages = pages.select(*keep, html)
    m = model()
    schema = T.StructType([*pages.schema.fields[: len(keep)], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(x.as_py(), m) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], schema.names)

    return pages.mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
