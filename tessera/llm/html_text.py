"""Main text of HTML pages: a linear-chain conditional random field over the DOM's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

#: Generated labelled pages that the field is trained on, and training steps.
TRAINING_PAGES, STEPS = 500, 200

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math select button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div section table ul ol dl nav header footer main form td th figure blockquote details".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "head", "title", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "table", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "div", "a", "label", "button", "body", "address", "details", "dialog", "menu", "search")
#: Words of class, id and role attributes, by what they hint at.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar tabs", "head": "header masthead banner top logo branding", "foot": "footer foot bottom copyright colophon contentinfo legal",
    "side": "sidebar side aside widget widgets complementary rail related recommended popular trending", "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsbox", "notice": "cookie cookies consent gdpr notice alert modal popup overlay disclaimer warning newsletter subscribe paywall",
    "comment": "comment comments reply replies discussion disqus respond commentlist feedback reviews", "social": "share sharing social follow tags meta byline", "form": "form login signup search contact",
    "main": "article content main post entry story body text page prose maincontent articlebody",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_MARKS = ("cookie", "copyright", "©", "rights reserved", "subscribe", "sign up", "log in", "advert", "sponsored", "comment", "reply", "share", "privacy", "http", "@")


class Leaf:
    """Text between block tags, its ancestors' tags and hints, and how much of it stands in links."""

    __slots__ = ("hints", "linked", "parent", "tags", "text")

    def __init__(self, text, tags, hints, linked):
        self.text, self.tags, self.hints, self.linked, self.parent = text, tags, hints, linked, tags[-1] if tags else ""


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks with text, in page order: character references decoded, white space one space, trimmed.

    Comments, scripts, styles, templates and form controls' contents aren't text. Unclosed and stray tags are taken as
    browsers take them, by and large: a block ends an open p, an li an open li; a close tag ends what it encloses.
    """
    out, stack, buf, linked, link_depth, at = [], [], [], 0, 0, 0  # stack: (tag, hints)
    n = len(page)

    def flush():
        nonlocal buf, linked
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                hints = frozenset().union(*(h for _, h in stack)) if stack else frozenset()
                out.append(Leaf(text, tuple(t for t, _ in stack if t in BLOCK), hints, min(1.0, linked / max(1, len(text)))))
        buf, linked = [], 0

    def close(to: int):
        nonlocal link_depth
        for t, _ in stack[to:]:
            link_depth -= t == "a"
        del stack[to:]

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            buf.append(text)
            if link_depth > 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCK:
                flush()
            if place is not None and (name in BLOCK or not any(t in SCOPE for t, _ in stack[place + 1 :])):
                close(place)
            continue
        if name in RAW:
            if name == "title" or name in ("button", "select", "svg", "math") or name in BLOCK:
                flush()
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" or t in CLOSED_BY.get(name, ()):
                    close(i)
                    break
                if t in SCOPE and not (t in ("td", "th") and name in CLOSED_BY):
                    break
        elif name == "br":
            buf.append(" ")
        if name in VOID:
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        hints = set()
        for a in _ATTR.finditer(m[3]):
            value = (a[1] or a[2] or a[3] or "").lower()
            hints.update(_HINT[w] for w in _WORD.findall(value) if w in _HINT)
        stack.append((name, frozenset(hints)))
        link_depth += name == "a"
    flush()
    return out


_NAMES = (
    *(f"in:{t}" for t in TAGS), *(f"parent:{t}" for t in TAGS), *(f"hint:{h}" for h in HINTS), *(f"mark:{m}" for m in _MARKS),
    *(f"words>={n}" for n in (2, 4, 8, 16, 32, 64)), *(f"linked>={x}" for x in (0.1, 0.5, 0.9)), "ends", "commas", "upper", "digits", "first", "last", "in-unknown", "marked-in-unknown", "marks>=2", "marks>=3", "bias",
)
_TAG_AT, _PARENT_AT = {t: i for i, t in enumerate(TAGS)}, {t: i + len(TAGS) for i, t in enumerate(TAGS)}
_HINT_AT = {h: 2 * len(TAGS) + i for i, h in enumerate(HINTS)}
_MARK_AT = 2 * len(TAGS) + len(HINTS)
_REST = _MARK_AT + len(_MARKS)


@lru_cache(4096)
def _place(tags: tuple[str, ...], hints: frozenset[str]) -> tuple[int, ...]:
    """Feature numbers of a block's ancestors and hints."""
    at = {_TAG_AT[t] for t in tags if t in _TAG_AT} | {_HINT_AT[h] for h in hints}
    if tags and tags[-1] in _PARENT_AT:
        at.add(_PARENT_AT[tags[-1]])
    return tuple(sorted(at))


def features(blocks: list[Leaf]) -> np.ndarray:
    x = np.zeros((len(blocks), len(_NAMES)), np.float32)
    for i, b in enumerate(blocks):
        x[i, list(_place(b.tags, b.hints))] = 1
        text = b.text
        low, marks = b.text.lower(), 0
        for j, m in enumerate(_MARKS):
            if m in low:
                x[i, _MARK_AT + j] = 1
                marks += 1
        words = text.count(" ") + 1
        at = _REST
        for limit in (2, 4, 8, 16, 32, 64):
            x[i, at] = words >= limit
            at += 1
        for limit in (0.1, 0.5, 0.9):
            x[i, at] = b.linked >= limit
            at += 1
        x[i, at : at + 4] = text[-1] in ".!?\"'”»…", text.count(",") / words, text.isupper(), sum(map(str.isdigit, text)) > 0.2 * len(text)
        x[i, at + 4] = i == 0
        x[i, at + 5] = i == len(blocks) - 1
        x[i, at + 6] = not any(t in ("article", "main", "nav", "header", "footer", "aside", "form") for t in b.tags) and not b.hints
        x[i, at + 7] = marks > 0 and x[i, at + 6]
        x[i, at + 8 : at + 10] = marks > 1, marks > 2
    x[:, -1] = 1
    return x


class Field:
    """Two labels (0 other, 1 main text): a weight per feature and label, and per pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @staticmethod
    def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Field:
        """Maximise the labels' conditional log likelihood (forward-backward, Adam, a little weight decay)."""
        longest, d = max(len(y) for _, y in pages), pages[0][0].shape[1]
        n = len(pages)
        x, y, live = np.zeros((n, longest, d), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (a, b) in enumerate(pages):
            x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
        flat, theta = x.reshape(-1, d), np.zeros(2 * d + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        gold = np.eye(2)[y] * live[..., None]
        both = live[:, 1:] & live[:, :-1]
        gold_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        for step in range(1, steps + 1):
            w, t = theta[: 2 * d].reshape(d, 2), theta[2 * d :].reshape(2, 2)
            s = (flat @ w).reshape(n, longest, 2)
            forward, backward = s.copy(), np.zeros_like(s)
            for i in range(1, longest):
                forward[:, i] += np.where(live[:, i, None], np.logaddexp(forward[:, i - 1, 0, None] + t[0], forward[:, i - 1, 1, None] + t[1]), 0)
            for i in range(longest - 2, -1, -1):
                after = s[:, i + 1] + backward[:, i + 1]
                backward[:, i] = np.where(live[:, i + 1, None], np.logaddexp(t[:, 0] + after[:, 0, None], t[:, 1] + after[:, 1, None]), 0)
            z = np.logaddexp.reduce(forward[:, 0] + backward[:, 0], axis=1)
            p = np.exp(forward + backward - z[:, None, None]) * live[..., None]
            pair = np.exp(forward[:, :-1, :, None] + t + (s + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
            grad = np.concatenate([(flat.T @ (gold - p).reshape(-1, 2)).ravel(), (gold_pairs - pair.sum((0, 1))).ravel()]) / n - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Field(theta[: 2 * d].reshape(d, 2), theta[2 * d :].reshape(2, 2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels, by Viterbi."""
        if not len(x):
            return np.zeros(0, np.int64)
        s, (t00, t01, t10, t11) = (x @ self.weights).tolist(), self.pairs.ravel().tolist()
        a, b = s[0]
        back = []
        for e0, e1 in s[1:]:
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
            back.append((from0, from1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


# --- labelled pages


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A generated page of one of many layouts, and a label for each of its leaf blocks."""
    syllables = "ba co de fi lu mo ne pa ri so ta ve the ing er on at is an or".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    inline = lambda t: rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<em>{}</em> " + some(1, 3), "<span>{}</span>", "{} <a href=/x>" + some(1, 3) + "</a> " + some(2, 6)]).format(t)
    sentence = lambda: some(4, 18).capitalize() + rng.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    says = lambda: rng.choice(["We use cookies", "Copyright " + word(), "All rights reserved", "Subscribe to our newsletter", "Sign up", "Advertisement", "Read our privacy notice", "Your privacy"]) + rng.choice([". ", " " + sentence() + " "])
    passing = lambda: prose() + " " + some(2, 6).capitalize() + rng.choice([" cookie ", " reply ", " share ", " comment ", " privacy ", " subscribe ", " http://x.org/ ", " a@b.org ", " copyright "]) + some(2, 6) + ". " + prose()
    out: list[str] = []
    labels: list[int] = []

    def put(tag: str, text: str, label: int, attrs: str = "", shut: bool = True):
        out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if shut else ""))
        labels.append(label)

    def links(label: int = 0, n: int = 6):
        out.append("<ul>")
        for _ in range(rng.randint(2, n)):
            put("li", f'<a href="/{word()}">{some(1, 3)}</a>', label)
        out.append("</ul>")

    def named(*names: str) -> str:
        key = rng.choice(["class", "class", "id"])
        return f' {key}="{rng.choice(names)}{rng.choice(["", "", "-box", "-1", " wide"])}"'

    def boilerplate(kind: str):
        if kind == "nav":
            tag, attrs = rng.choice([("nav", ""), ("div", named("menu", "nav", "navbar", "breadcrumb")), ("nav", named("menu"))])
            out.append(f"<{tag}{attrs}>")
            links()
        elif kind == "header":
            tag, attrs = rng.choice([("header", ""), ("div", named("header", "masthead", "top"))])
            out.append(f"<{tag}{attrs}>")
            put(rng.choice(["h1", "h2", "div", "p", "a"]) if rng.random() < 0.6 else "p", some(1, 5), 0)
            if rng.random() < 0.5:
                put("p", some(2, 8), 0)
            if rng.random() < 0.5:
                links()
        elif kind == "aside":
            tag, attrs = rng.choice([("aside", ""), ("div", named("sidebar", "widget", "related")), ("aside", named("sidebar"))])
            out.append(f"<{tag}{attrs}>")
            put(rng.choice(["h2", "h3", "h4", "p"]), some(1, 3), 0)
            if rng.random() < 0.6:
                links()
            if rng.random() < 0.6:
                put("p", prose(), 0)
        elif kind in ("ad", "notice"):
            tag, attrs = rng.choice(["div", "div", "section", "aside"]), named(*(("ad", "ads", "advert", "sponsored", "promo") if kind == "ad" else ("cookie", "notice", "consent", "newsletter", "popup")))
            out.append(f"<{tag}{attrs}>")
            text = prose() if kind == "ad" or rng.random() < 0.4 else "We use cookies. " + prose()
            if rng.random() < 0.6:
                out.append(text)
                labels.append(0)
            else:
                put("p", text, 0)
                if rng.random() < 0.3:
                    put("p", some(1, 4), 0)
        elif kind == "plain":  # a notice, of any length, in a container without a telling tag, class or id
            tag = rng.choice(["div", "div", "section"])
            out.append(f"<{tag}>")
            text = "".join(says() + rng.choice(["", prose() + " "]) for _ in range(rng.choice([1, 1, 2, 3]))) + rng.choice(["", prose(), " ".join(prose() for _ in range(4))])
            if rng.random() < 0.4:
                out.append(text)
                labels.append(0)
            else:
                put("p", text, 0)
        elif kind == "form":
            tag = "form"
            out.append(f"<form{rng.choice(['', named('search', 'login', 'contact')])}>")
            put(rng.choice(["p", "div", "label"]) if rng.random() < 0.9 else "h3", some(1, 8), 0)
            if rng.random() < 0.6:
                put("p", some(1, 6), 0)
            out.append("<input name=q><button>ok</button>")
        elif kind == "comments":
            tag, attrs = rng.choice([("div", named("comments", "comment", "discussion", "replies")), ("section", named("comments", "comments", "reviews"))])
            out.append(f"<{tag}{attrs}>")
            if rng.random() < 0.6:
                put(rng.choice(["h2", "h3"]), rng.choice(["Comments", some(1, 3)]), 0)
            inner = rng.choice(["div", "li", "article", "p"])
            for _ in range(rng.randint(1, 5)):
                if inner == "p":
                    put("p", prose(), 0)
                else:
                    out.append(f"<{inner}{rng.choice(['', ' class=comment'])}>")
                    if rng.random() < 0.5:
                        put("p", some(1, 2), 0)
                    put("p", prose(), 0)
                    out.append(f"</{inner}>")
        else:
            tag, attrs = rng.choice([("footer", ""), ("div", named("footer", "copyright", "bottom"))])
            out.append(f"<{tag}{attrs}>")
            text = rng.choice(["&copy; ", "", "Copyright "]) + some(1, 4) + rng.choice(["", " &middot; " + prose()])
            if rng.random() < 0.5:
                out.append(text)
                labels.append(0)
            else:
                put("p", text, 0)
                if rng.random() < 0.4:
                    links()
        out.append(f"</{tag}>")

    def article():
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", named("content", "article", "post", "entry", "main")), ("section", named("content", "story")), ("article", named("post")), ("div", "")])
        out.append(f"<{tag}{attrs}>")
        inner = rng.random() < 0.25
        if inner:
            out.append(rng.choice(["<div>", '<div class="body">', "<section>"]))
        if rng.random() < 0.85:
            put(rng.choice(["h1", "h1", "h2"]), some(2, 10), 1)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.72:
                put("p", inline(passing() if rng.random() < 0.1 else prose()), 1, shut=rng.random() < 0.9)
            elif kind < 0.8:
                put(rng.choice(["h2", "h3"]), some(1, 6), 1)
            elif kind < 0.86:
                out.append(ls := rng.choice(["<ul>", "<ol>"]))
                for _ in range(rng.randint(1, 5)):
                    put("li", some(1, 14), 1)
                out.append(ls.replace("<", "</"))
            elif kind < 0.9:
                put("blockquote", prose(), 1)
            elif kind < 0.93:
                out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(2):
                        put("td", some(1, 4), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.95:
                put("pre", some(3, 12), 1)
            elif kind < 0.97:
                out.append("<figure>")
                put("figcaption", some(3, 10), 1)
                out.append("</figure>")
            else:
                boilerplate(rng.choice(["ad", "ad", "notice", "form", "aside"]))
        if inner:
            out.append("</div>" if "<div" in "".join(out[-60:]) and "<section>" not in out else "</section>")
        out.append(f"</{tag}>")

    out.append(f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
    wrap = rng.random() < 0.3
    if wrap:
        out.append(rng.choice(["<div>", '<div id="page">', '<div class="wrapper">']))
    for kind, share in (("notice", 0.25), ("header", 0.45), ("nav", 0.8), ("notice", 0.1), ("plain", 0.2), ("ad", 0.45), ("aside", 0.15), ("form", 0.1)):
        if rng.random() < share:
            boilerplate(kind)
    article()
    for kind, share in (("comments", 0.45), ("aside", 0.35), ("ad", 0.25), ("form", 0.25), ("nav", 0.1), ("notice", 0.15), ("plain", 0.25), ("footer", 0.85)):
        if rng.random() < share:
            boilerplate(kind)
    if wrap:
        out.append("</div>")
    out.append("</body></html>")
    return "".join(out), labels


@lru_cache(2)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Field:
    """The field, trained on generated pages whose blocks and labels match one to one."""
    rng, rows = random.Random(seed), []
    while len(rows) < pages:
        page, labels = labelled_page(rng)
        blocks = leaves(page)
        if len(blocks) == len(labels):
            rows.append((features(blocks), np.array(labels)))
    return Field.train(rows)


def main_text(page: str, field: Field) -> str:
    blocks = leaves(page)
    keep = field.decode(features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """Per page row: page_id, url, text (main text; blocks in page order joined by a newline), n_chars (code points).

    pages: page_id, url, html; further columns are ignored. Null and empty html give an empty text, never null. Rows
    repeating an id are read one by one, null ids too. An empty table gives no rows. Whole pages are parsed where they
    are read; nothing is shuffled. The field is trained on training_pages generated pages, independent of the data.
    """
    field = trained(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(h, field) if h else "" for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    base = pick(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("string"))
    kinds = dict(base.dtypes)
    return base.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
