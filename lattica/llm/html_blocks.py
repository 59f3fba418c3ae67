"""HTML extraction by a recurrent block labeller (operator 4).

A page becomes its sequence of leaf blocks (text between block-level tags).  Each
block is read as a vector of its tag path (tags, classes, ids and roles of all open
elements, hashed), of its words (hashed) and of a few plain features; a
bidirectional LSTM in numpy runs over the whole sequence, so a block is labelled
in the light of the whole document.  The text of blocks labelled main, in page
order, is the page's text.

The network is trained here, on pages that ``training_page`` lays out from random
templates with known main blocks; ``TRAIN_PAGES`` and the seed are parameters.
Weights (some hundred kB, a fixed size) are trained once on the driver and kept in
the shared folder.

Defined results: null or empty html gives an empty text; a page without main
blocks gives an empty text; broken html is read by the standard's rules, never
refused: a stray quote is a character, an unclosed element reaches to where its parent
ends, an unclosed script or style to the end of the page; ``<br>`` ends a block; rows with equal or null ids keep a row each; an empty table gives no
rows; other columns are not handed on.
"""

from __future__ import annotations

import collections
import functools
import html
import random
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, shared_dir, ship, text_slices

PATH_SLOTS, WORD_SLOTS, PLAIN = 256, 64, 8
HIDDEN = 16
TRAIN_PAGES, EPOCHS, SEED = 2000, 12, 7

#: A tag by the standard's rules: a quote opens a value only right behind ``=``; elsewhere it is a character like others.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?)*+)>?|<[!?][^>]*>?|[^<]+|<""",
    re.S,
)
_ATTR = re.compile(r"""(?<![^\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements of the HTML standard by how their text is laid out.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, form values, fallbacks for what the page shows otherwise.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes select".split())
#: Without an end tag these reach to the end of the page, as in a browser; others are passed over.
CODE = frozenset(("script", "style"))
#: A start tag closes an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CLOSES |= {t: ("p",) for t in BLOCKS - set(CLOSES) - {"br", "button", "label", "body", "html", "head"}}
STOPS = frozenset("ul ol dl table article section div main aside nav header footer form body".split())


_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class TagPath:
    """An open element and, by its parent, all around it; what features need of the whole path is added up on the way down."""

    __slots__ = ("up", "names", "length", "slots")

    def __init__(self, up: "TagPath | None" = None, names: tuple[str, ...] = ()):
        self.up, self.names = up, names
        self.length = (up.length if up else 0) + len(names)
        self.slots = (up.slots if up else 0) | _slots_of(names)

    def __len__(self) -> int:
        return self.length

    def __contains__(self, name: str) -> bool:
        at: TagPath | None = self
        while at:
            if name in at.names:
                return True
            at = at.up
        return False

    def __bool__(self) -> bool:
        return True


def leaf_blocks(page: str | None) -> list[tuple[TagPath, str, int]]:
    """(tag path, text, characters within links) of the page's leaf blocks, in order."""
    out: list[tuple[TagPath, str, int]] = []
    stack: list[tuple[str, TagPath]] = []
    opened: collections.Counter[str] = collections.Counter()
    held: list[str] = []
    linked = 0
    root = where = TagPath()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((where, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def shut_from(i: int) -> None:
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    page = page or ""
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0][0] == "<" and len(m[0]) > 1:
                continue
            if not held:
                where = stack[-1][1] if stack else root
            piece = html.unescape(m[0])
            held.append(piece)
            if opened["a"]:
                linked += len(piece)
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m["close"]:
                if tag in BLOCKS:
                    flush()
                end = _END[tag].search(page, at)
                if end or tag in CODE:
                    at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
        if m["close"]:
            if opened[tag]:
                shut_from(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID:
            continue
        for shut in CLOSES.get(tag, ()):
            for i in range(len(stack) - 1, -1, -1) if opened[shut] else ():
                if stack[i][0] == shut:
                    shut_from(i)
                    break
                if stack[i][0] in STOPS:
                    break
        names = (tag,)
        if m["attrs"]:
            names += tuple(f"{k.lower()}={w}" for k, *v in _ATTR.findall(m["attrs"]) for w in "".join(v).lower().split())
        stack.append((tag, TagPath(stack[-1][1] if stack else root, names)))
        opened[tag] += 1
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def _slot(name: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(name, seed=slots) % slots


@functools.lru_cache(maxsize=50_000)
def _slots_of(names: tuple[str, ...]) -> int:
    """A bit for each slot that the names or their parts fall into."""
    bits = 0
    for name in names:
        for part in {name, *re.split(r"[-_=]", name)} - {""}:  # a class is read whole and by its parts
            bits |= 1 << _slot(part, PATH_SLOTS)
    return bits


def features(pages: list[list[tuple[TagPath, str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks per page, block vectors of all pages)."""
    n = np.array([len(p) for p in pages], np.int64)
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), PATH_SLOTS + WORD_SLOTS + PLAIN), np.float32)
    if not flat:
        return n, x
    bits = np.frombuffer(b"".join(p.slots.to_bytes(PATH_SLOTS // 8, "little") for p, _, _ in flat), np.uint8).reshape(len(flat), -1)
    x[:, :PATH_SLOTS] = np.unpackbits(bits, axis=1, bitorder="little")
    texts = pa.array([t for _, t, _ in flat], pa.string())
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    slot = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_SLOTS for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    words = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    cell = np.repeat(np.arange(len(flat)), words) * WORD_SLOTS + slot[coded.indices.to_numpy(zero_copy_only=False)]
    bags = np.bincount(cell, minlength=len(flat) * WORD_SLOTS).reshape(len(flat), WORD_SLOTS)
    x[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = bags / np.maximum(words, 1)[:, None]
    chars = np.array([len(t) for _, t, _ in flat], np.float32)
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(flat)) - starts[owner]) / np.maximum(n[owner], 1)
    plain = [np.log1p(chars) / 5, np.log1p(words) / 4, np.array([k for _, _, k in flat], np.float32) / np.maximum(chars, 1), place, [t[-1] in ".!?…:;\"'»”" for _, t, _ in flat], [t.count(",") / 5 for _, t, _ in flat], [len(p) / 10 for p, _, _ in flat], [1.0] * len(flat)]
    x[:, PATH_SLOTS + WORD_SLOTS :] = np.minimum(np.stack([np.asarray(c, np.float32) for c in plain], 1), 4)
    return n, x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * z)


class BiLSTM:
    """Two LSTMs, one in each direction, and a logistic layer over both states."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p[f"W{d}"] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
            self.p[f"U{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["V"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """States of one direction; x and mask are (time, pages, ...)."""
        steps, pages = mask.shape
        h = np.zeros((pages, self.hidden), np.float32)
        c = np.zeros_like(h)
        zx = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out = np.zeros((steps, pages, self.hidden), np.float32)
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = zx[t] + h @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * self.hidden])
            i, f, o = np.split(gates, 3, 1)
            g = np.tanh(z[:, 3 * self.hidden :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h = np.where(m, o * tc, h)
            c = np.where(m, c_new, c)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], 2)
        return (h @ self.p["V"] + self.p["v"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in ("f", "b")}
        h = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        z = (h @ self.p["V"] + self.p["v"])[:, :, 0]
        dz = ((_sigmoid(z) - y) * mask / max(mask.sum(), 1))[:, :, None].astype(np.float32)
        grads = {"V": np.einsum("tph,tpk->hk", h, dz), "v": dz.sum((0, 1))}
        dh_all = dz @ self.p["V"].T
        for k, d in enumerate(("f", "b")):
            part = dh_all[:, :, k * self.hidden : (k + 1) * self.hidden]
            dW, dU, db = (np.zeros_like(self.p[f"{n}{d}"]) for n in "WUc")
            dh = np.zeros((x.shape[1], self.hidden), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, g, tc, m in reversed(runs[d][1]):
                dh = dh + part[t]
                dn = dc + dh * o * (1 - tc * tc)
                d_in = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], 1) * m
                dW += x[t].T @ d_in
                dU += h0.T @ d_in
                db += d_in.sum(0)
                dh = np.where(m, d_in @ self.p[f"U{d}"].T, dh)
                dc = np.where(m, dn * f, dc)
            grads |= {f"W{d}": dW, f"U{d}": dU, f"c{d}": db}
        return grads


def padded(n: np.ndarray, x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(n) - n
    steps = int(n[which].max()) if len(which) else 0
    out = np.zeros((steps, len(which), x.shape[1]), np.float32)
    mask = np.zeros((steps, len(which)), bool)
    for j, i in enumerate(which):
        out[: n[i], j] = x[starts[i] : starts[i] + n[i]]
        mask[: n[i], j] = True
    return out, mask


#: Made-up syllables of training texts.
SYLLABLES = "ta re mi on der the and of le la ción es en st ing ou er ge au va lo".split()


#: Words that training pages put in front of some texts, by what the block is; the pages of one in three have none.
USUAL = {
    "nav": "home about contact menu start inicio accueil archive help login".split(),
    "notice": "cookies cookie privacy accept subscribe newsletter consent akzeptieren suscribirse accepter".split(),
    "footer": "copyright rights reserved imprint impressum privacy terms legal mentions aviso".split(),
    "ad": "sponsored advertisement anzeige publicidad publicité offer buy sale now".split(),
    "comments": "comments reply says wrote antworten responder répondre kommentare".split(),
    "aside": "related popular more recent tags share ähnliche relacionados".split(),
    "form": "search email password send submit name suchen buscar".split(),
}


def _prose(rng: random.Random, words: int, kind: str = "") -> str:
    usual = USUAL.get(kind, ())
    out = [rng.choice(usual) if usual and rng.random() < 0.3 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + ("," if rng.random() < 0.08 else "") for _ in range(words)]
    return (" ".join(out).capitalize() + rng.choice(["."] * 8 + ["!", "?", ""])).replace("&", "&amp;")


def _name(rng: random.Random) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7)))


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page from a random template, and for each of its leaf blocks whether it belongs to the main text."""
    parts: list[str] = []
    labels: list[bool] = []

    names_tell, words_tell = rng.random() < 0.65, rng.random() < 0.65
    doing = ""

    def add(before: str, n: int, main: bool, after: str = "") -> None:
        if not names_tell:  # a page whose classes say nothing: names are left out or made up
            before = re.sub(r'\s(class|id)=("[^"]*"|[^\s>]+)', lambda m: rng.choice(["", f" {m[1]}={_name(rng)}"]), before)
        parts.append(before + _prose(rng, n, "" if main or not words_tell else doing) + after)
        labels.append(main)

    def say(tag: str) -> str:
        """A name of an element, made up on pages whose names tell nothing."""
        return tag if names_tell or "=" not in tag else re.sub(r'=("[^"]*"|\S+)', lambda m: f"={_name(rng)}", tag)

    def links(tag: str, name: str, count: int) -> None:
        parts.append(f'<{say(tag + rng.choice(["", f" class={chr(34)}{name}{chr(34)}", f" id={chr(34)}{name}{chr(34)}"]))}><ul>')
        for _ in range(count):
            add('<li><a href="/x">', rng.randint(1, 4), False, "</a></li>")
        parts.append(f"</ul></{tag}>")

    def boiler(kind: str) -> None:
        nonlocal doing
        doing = kind
        if kind == "nav":
            links(rng.choice(["nav", "nav", "div"]), rng.choice(["nav", "menu", "navbar", "topnav", "site-menu"]), rng.randint(3, 9))
        elif kind == "aside":
            side = rng.choice(["aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"'])
            parts.append(f"<{say(side)}>")
            add(rng.choice(["<h3>", "<h4>", "<p>"]), rng.randint(1, 4), False)
            for _ in range(rng.randint(0, 4)):
                add(rng.choice(["<p>", "<li>", "<div>"]), rng.randint(3, 40), False)
            parts.append(f"</{side.split()[0]}>")
        elif kind == "ad":
            name = rng.choice(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"])
            add(f'<{rng.choice(["div", "div", "aside", "section"])} class="{name}">', rng.randint(2, 30), False, "</div></aside></section>")
        elif kind == "notice":
            name = rng.choice(["cookie", "cookie-notice", "notice", "consent", "gdpr", "newsletter", "popup", "alert", "modal"])
            parts.append("<" + say(f'div class="{name}"') + ">")
            for _ in range(rng.randint(1, 2)):
                add(rng.choice(["<p>", ""]), rng.randint(4, 30), False, rng.choice(["</p>", "<br>"]))
            if rng.random() < 0.5:
                add("<button>", rng.randint(1, 2), False, "</button>")
            parts.append("</div>")
        elif kind == "form":
            parts.append(f'<form{rng.choice(["", " class=search", " id=login"])}>')
            for _ in range(rng.randint(1, 3)):
                add("<label>", rng.randint(1, 4), False, '</label><input name="q">')
            add("<button>", 1, False, "</button></form>")
        elif kind == "comments":
            parts.append("<" + say(f'{rng.choice(["div", "section"])} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "reader-comments", "discussion", "replies"])}"') + ">")
            add("<h3>", rng.randint(1, 3), False, "</h3>")
            for _ in range(rng.randint(1, 6)):
                parts.append("<" + say('div class="comment"') + ">" if rng.random() < 0.7 else "<li>")
                add("<p>", rng.randint(3, 60), False, "</p>")
                parts.append("</div>")
            parts.append("</section></div>")
        elif kind == "header":
            add(f'<header{rng.choice(["", " class=site-header"])}>{rng.choice(["<h1>", "<div>", "<p>", "<a href=/>"])}', rng.randint(1, 8), False, "</header>")
        else:
            add(f'<{rng.choice(["footer", "footer", "div class=footer", "div id=footer"])}>{rng.choice(["", "<p>", "&copy; ", "&copy; example.org &middot; "])}', rng.randint(1, 30), False, "</footer></div>")

    def article() -> None:
        shell = rng.choice(["article"] * 5 + ["main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'main><article'])
        parts.append(f"<{say(shell) if rng.random() < 0.5 else shell}>")
        if rng.random() < 0.85:
            add(rng.choice(["<h1>", "<h1>", "<h2>", '<h1 class="title">']), rng.randint(1, 14), True, "</h1></h2>")
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40])):
            kind = rng.random()
            if kind < 0.68:
                add("<p>", rng.choice([1, 2, 5, 12, 30, 60, 120]), True, rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.78:
                add("<p><b>", rng.randint(1, 30), True, "<br>")
            elif kind < 0.86:
                add(rng.choice(["<h2>", "<h3>"]), rng.randint(1, 6), True, "</h2></h3>")
            elif kind < 0.94:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>")
                for _ in range(rng.randint(1, 4)):
                    add("<li>", rng.randint(1, 14), True, "</li>")
                parts.append(f"</{tag}>")
            elif kind < 0.98:
                add(rng.choice(["<blockquote>", "<pre>", "<figure><figcaption>"]), rng.randint(2, 30), True, "</blockquote></pre></figcaption></figure>")
            else:
                boiler("ad")
        parts.append("</article></main></section></div>" if rng.random() < 0.95 else "")

    parts.append("<!DOCTYPE html><html><head><meta charset='utf-8'><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    for kind in rng.choices(["nav", "header", "ad", "notice", "form", "aside"], [5, 3, 3, 2, 1, 1], k=rng.randint(0, 4)):
        boiler(kind)
    article()
    for kind in rng.choices(["footer", "comments", "aside", "ad", "form", "notice", "nav"], [6, 3, 3, 2, 1, 1, 1], k=rng.randint(0, 4)):
        boiler(kind)
    parts.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(parts), labels


def training_pages(count: int, seed: int) -> list[tuple[list, list[bool]]]:
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        page, labels = training_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLSTM:
    """The network, by Adam on batches of pages of like length."""
    data = training_pages(pages, seed)
    n, x = features([b for b, _ in data])
    y = np.array([v for _, labels in data for v in labels], np.float32)
    net = BiLSTM(x.shape[1], seed=seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.argsort(n, kind="stable")
    batches = [order[i : i + 8] for i in range(0, len(order), 8)]
    starts = np.cumsum(n) - n
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            which = batches[k]
            xs, mask = padded(n, x, which)
            ys = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(which):
                ys[: n[i], j] = y[starts[i] : starts[i] + n[i]]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) ** 1.5
            for name, g in net.gradients(xs, mask, ys).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: BiLSTM, pages: list[list]) -> list[np.ndarray]:
    """For each page, which of its blocks are main; pages of like length run together."""
    n, x = features(pages)
    starts = np.cumsum(n) - n
    out = [np.zeros(int(k), bool) for k in n]
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        size = max(1, min(256, 40_000 // int(n[order[min(at + 255, len(order) - 1)]])))
        which = order[at : at + size]
        z = net.logits(*padded(n, x, which))
        for j, i in enumerate(which):
            out[i] = z[: n[i], j] > 0
        at += size
    return out


def weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """Trained weights: made once and kept in the shared folder under a name that tells their parameters and this code."""
    source = Path(__file__)
    code = source.read_bytes() if source.exists() else b""  # within an archive the parameters alone name them
    name = xxhash.xxh64_hexdigest(repr((PATH_SLOTS, WORD_SLOTS, PLAIN, HIDDEN, TRAIN_PAGES, EPOCHS, SEED)).encode() + code)
    path = f"{shared_dir(spark)}/lattica/html-weights-{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        rows = [(k, list(v.shape), v.astype("<f4").tobytes()) for k, v in trained().p.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, value binary").coalesce(1).write.mode("overwrite").parquet(path)
    return {r["name"]: np.frombuffer(r["value"], "<f4").reshape(r["shape"]) for r in spark.read.parquet(path).collect()}  # six rows


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(kept columns, text, n_chars) of every page."""
    ship(pages.sparkSession)
    held = weights(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLSTM(PATH_SLOTS + WORD_SLOTS + PLAIN)
        net.p = held
        for b in text_slices(batches, "_html", 4_000_000):
            blocks = [leaf_blocks(h) for h in b.column("_html").to_pylist()]
            texts = ["\n".join(t for (_, t, _), main in zip(page, mark) if main) for page, mark in zip(blocks, label(net, blocks))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(column).alias("_html")).mapInArrow(rows, f"{kept}, text string, n_chars long")
