"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags. A block is read as two hashed vectors, one of its tag path (names, classes,
ids and roles of its innermost ``PATH_ELEMENTS`` open elements) and one of its
words, with a few lengths. A bidirectional LSTM in numpy reads the whole sequence,
so every block is classified in the light of everything before and after it;
blocks labelled main are joined.

No page says which of its blocks are main, so the labeller learns from the pages
themselves: on at most ``SAMPLE_PAGES`` pages of up to ``SAMPLE_CHARS`` characters,
chosen by a hash of their url and html, landmark elements and telling class names label the blocks that they hold,
and other blocks inherit from article-like or prose-like surroundings. Copies of
these pages with furniture of kinds that they may lack (comments, sidebars,
notices, forms, headers) are added, as ``FURNITURE`` lists it, and copies whose
landmarks and names are hidden (``plain_names``) with the labels that these gave:
there only words, links, lengths and neighbours can tell.

Learning and extraction read all blocks of a page, ``WINDOW`` at a time. In
extraction both directions carry their state from window to window, so a page of
any length is one sequence, and a step holds ``CELLS`` blocks at most.

Pages are scanned as browsers do it, but so that an article is not lost to bad
markup: a head ends at the first element of a body; quotes count only behind an
equals sign; a comment without an end ends at its first ``>``; an element whose
content is skipped (``SKIPPED``) needs an end tag, nested ones are counted, and
one without an end is as if it had not been opened. Only script, style and the
other elements of raw text without an end take the rest of the page, as in
browsers. Elements are nested 512 deep at most, deeper ones are siblings.

Defined results: a null or blockless html gives ``""``; repeated rows get equal
texts; null ids and urls are passed on; an empty table stays empty; columns other
than those named are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import small_batches

SAMPLE_PAGES, WINDOW = 160, 400
#: Longer pages are not learned from; if all are longer, the shortest is.
SAMPLE_CHARS = 200_000
PATH_DIM, WORD_DIM, HIDDEN = 192, 32, 16
EXTRA = 6
INPUT = PATH_DIM + WORD_DIM + EXTRA
EPOCHS, RATE, PAGES_A_STEP = 6, 0.02, 24
#: Blocks x pages read at once.
CELLS = 8192
PATH_ELEMENTS, NAMES_AN_ELEMENT, DEEPEST = 32, 16, 512

_MARKUP = r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z"
_TAG = re.compile(rf"<!--(?:-?>|.*?--!?>)|{_MARKUP}", re.S)
#: Behind the last end of a comment.
_TAG_LAST = re.compile(_MARKUP, re.S)
_NAMED = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Fixed values of the HTML standard: elements without content, of raw text, inside a line, and of a head.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("svg math object canvas template noscript select datalist button audio video".split())
#: An opening tag of the second kind ends an open element of the first.
ENDS = {"p": frozenset("p div ul ol dl li table section article aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre hr main figure".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words in tag names, classes, ids and roles that mark furniture, and main matter.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer foot copyright aside sidebar side rail widget ad ads advert advertisement sponsor "
    "sponsored promo promotion cookie cookies consent notice notification alert popup modal overlay form search login signup newsletter subscribe comment comments "
    "respond reply disqus share social sharing related recommended tags pagination pager toolbar skip button".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text maincontent articlebody".split())
#: Furniture added to copies of the sampled pages: (before, after) the words of a block.
FURNITURE = (
    ('<section class="comments"><div class="comment"><p>', "</p></div></section>"),
    ('<div id="comments"><ol class="comment-list"><li>', "</li></ol></div>"),
    ('<aside class="sidebar"><h3>', "</h3></aside>"),
    ('<div class="sidebar"><ul><li><a href="/x">', "</a></li></ul></div>"),
    ('<div class="cookie-notice"><p>', "</p></div>"),
    ('<div class="notice">', "</div>"),
    ('<form action="/s"><label>', "</label><input><button>Go</button></form>"),
    ('<header class="site-header"><p>', "</p></header>"),
    ('<div class="ad-slot advertisement"><p>', "</p></div>"),
    ('<div class="related"><h4>', "</h4></div>"),
    ('<div class="newsletter"><p>', "</p></div>"),
    ('<div class="footer"><p>', "</p></div>"),
    ('<div class="menu"><a href="/y">', "</a></div>"),
    ('<div class="share-buttons"><span>', "</span></div>"),
    ('<div class="advertisement"><p>', "</p></div>"),
    ('<div class="promo banner">', "</div>"),
    ('<div class="social"><a href="#">', "</a></div>"),
)
#: Names of the main part on copies that have no article element.
MAIN_NAMES = ('class="post-content"', 'id="story"', 'class="entry"', 'class="story-body"', 'id="content"', 'class="article-text"', 'class="main post"', 'class="content"')
#: Main matter added within the main part of copies: what pages may lack beside headings and paragraphs.
MATTER = (
    ("<h2>", "</h2>"),
    ("<ul><li>", "</li></ul>"),
    ("<blockquote>", "</blockquote>"),
    ("<ol><li>", "</li></ol>"),
    ("<h3>", "</h3>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ("<pre>", "</pre>"),
)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


class Tag:
    __slots__ = ("start", "end", "closing", "name", "rest")

    def __init__(self, start: int, end: int, closing: bool, name: str | None, rest: str):
        self.start, self.end, self.closing, self.name, self.rest = start, end, closing, name, rest


def tags(source: str) -> list[Tag]:
    """All tags and comments (which have no name) in order; raw text is part of its element's opening tag."""
    out: list[Tag] = []
    endless: set[str] = set()
    pos, last = 0, max(source.rfind("-->"), source.rfind("--!>"), source.rfind("<!-->"))
    while (m := (_TAG if pos <= last else _TAG_LAST).search(source, pos)) is not None:
        pos = m.end()
        name = m[2].lower() if m[2] else None
        tag = Tag(m.start(), pos, bool(m[1]), name, m[3] or "")
        out.append(tag)
        if name in RAW and not tag.closing:
            end = None if name in endless else re.compile(rf"</{name}(?=[\s>/])", re.I).search(source, pos)
            if end is not None:  # tags named inside it are text
                close = _TAG_LAST.match(source, end.start())
                tag.end = pos = close.end() if close else len(source)
            elif name in ("title", "textarea") or tag.rest.endswith("/"):
                endless.add(name)
            else:
                tag.end = len(source)
                break
    return out


def _skips(found: list[Tag]) -> dict[int, int]:
    """Opening tags whose content is skipped, each with the tag that ends it; nested ones of a name are counted."""
    open_: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for k, tag in enumerate(found):
        if tag.name in SKIPPED:
            if not tag.closing:
                if not (tag.name in ("svg", "math") and tag.rest.endswith("/")):
                    open_.setdefault(tag.name, []).append(k)
            elif open_.get(tag.name):
                out[open_[tag.name].pop()] = k
    return out


def _names(tag: Tag) -> tuple[str, ...]:
    own = [tag.name]
    if tag.rest:
        for a in _NAMED.finditer(tag.rest):
            own += [f".{x}" for x in _SPLIT.split((a[1] or a[2] or a[3] or "").lower()) if x]
            if len(own) > NAMES_AN_ELEMENT:
                break
    return tuple(own[:NAMES_AN_ELEMENT])


def blocks(source: str) -> list[Block]:
    """The leaf blocks of a page in order; scripts, styles, comments and skipped elements hold none."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = at = 0
    path: tuple[str, ...] = ()
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, paths.setdefault(path, path), linked))
        parts, linked = [], 0

    def cut(k: int) -> None:
        for name, _ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    found = tags(source)
    skips = _skips(found)
    k = -1
    while k + 1 < len(found):
        k += 1
        tag = found[k]
        if tag.start > at:
            piece = source[at : tag.start]
            if not parts:
                path = tuple(x for _, own in stack[-PATH_ELEMENTS:] for x in own)
            if open_.get("head") and not piece.isspace():
                cut(next(i for i, (n, _) in enumerate(stack) if n == "head"))
            parts.append(piece)
            if open_.get("a"):
                linked += len(piece)
        at = tag.end
        name = tag.name
        if name is None:
            continue
        if tag.closing:
            if name == "p" and not open_.get("p") or name == "br":  # browsers open an element here
                flush()
            elif name not in INLINE:
                flush()
            if open_.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        cut(i)
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break
            continue
        if k in skips:
            k = skips[k]
            at = found[k].end
            continue
        if open_.get("head") and name not in HEAD:
            cut(next(i for i, (n, _) in enumerate(stack) if n == "head"))
        if name in RAW:
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        for i in range(len(stack) - 1, -1, -1):
            if name in ENDS.get(stack[i][0], ()):
                cut(i)
                break
            if stack[i][0] not in INLINE:
                break
        if name not in VOID and not tag.rest.endswith("/"):
            if len(stack) >= DEEPEST:
                cut(DEEPEST - 1)
            stack.append((name, _names(tag)))
            open_[name] = open_.get(name, 0) + 1
    if at < len(source):
        if not parts:
            path = tuple(x for _, own in stack[-PATH_ELEMENTS:] for x in own)
        parts.append(source[at:])
    flush()
    return out


def _place(token: str) -> int:
    """A checksum of a token, the same in every process."""
    h = crc32(token.encode())
    return h ^ h >> 15


def features(page: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
    """Input vectors of the blocks first .. end of a page."""
    end = len(page) if end is None else end
    part, whole = page[first:end], len(page)
    x = np.zeros((len(part), INPUT), np.float32)
    paths: dict[int, np.ndarray] = {}
    kinds_of, sizes, extra = [], [], []
    for i, b in enumerate(part):
        own = paths.get(id(b.path))
        if own is None:
            own = paths[id(b.path)] = np.bincount([_place(t) % PATH_DIM for t in set(b.path)] or [0], minlength=PATH_DIM).astype(np.float32) * bool(b.path)
        x[i, :PATH_DIM] = own
        words = b.text.lower().split()
        kinds = set(words)
        kinds_of += [crc32(w.encode()) for w in kinds]
        sizes.append(len(kinds))
        n = len(b.text)
        extra.append((n, min(b.linked / n, 1.0), len(words), b.text[-1] in ".!?…"))
    if part:
        size = np.array(sizes)
        flat = np.bincount(np.repeat(np.arange(len(part)), size) * WORD_DIM + (np.array(kinds_of, np.int64) >> 9) % WORD_DIM, minlength=len(part) * WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = flat.reshape(-1, WORD_DIM) / np.maximum(size, 1)[:, None]
        e = np.array(extra, float)
        e[:, 0], e[:, 2] = np.log1p(e[:, 0]) / 6, np.log1p(e[:, 2]) / 4
        x[:, -EXTRA:-2] = e
        at = np.arange(first, end)
        x[:, -2], x[:, -1] = at / whole, (whole - 1 - at) / whole
    return x


def taught(page: list[Block]) -> np.ndarray:
    """Labels by landmarks and telling names; the innermost telling element decides."""
    y = np.zeros(len(page), np.float32)
    for i, b in enumerate(page):
        sign = 0
        for token in b.path:
            word = token.lstrip(".")
            if word in FURNITURE_WORDS:
                sign = -1
            elif word in MAIN_WORDS and token != "body" and sign >= 0:
                sign = 1
        prose = len(b.text.split()) >= 12 and b.linked < 0.3 * len(b.text)
        y[i] = sign > 0 or (sign == 0 and prose)
    return y


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b))).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = shape(INPUT + HIDDEN, 4 * HIDDEN)
            self.p[f"w{d}"][:INPUT] *= 0.2  # a name or word never learned says next to nothing
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open
        self.p["o"] = shape(2 * HIDDEN, 1)
        self.p["k"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, before: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states (steps, pages, HIDDEN) of one direction; x is laid out in its order."""
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        inputs = x @ w[:INPUT] + c0
        steps, n = x.shape[:2]
        h, c = before if before is not None else (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        tape = []
        for t in range(steps):
            z = inputs[t] + h @ w[INPUT:]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = m * (f * c + i * a) + (1 - m) * c
            tanh = np.tanh(new)
            nh = m * (o * tanh) + (1 - m) * h
            if keep:
                tape.append((h, c, i, f, o, a, tanh, m))
            h, c = nh, new
            out[t] = h
        return out, tape, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, tf, _ = self._run("f", x, mask, keep)
        hb, tb, _ = self._run("b", x[::-1], mask[::-1], keep)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        return 1 / (1 + np.exp(-np.clip((both @ self.p["o"])[..., 0] + self.p["k"], -30, 30))), both, tf, tb

    def _back(self, d: str, x: np.ndarray, dh_out: np.ndarray, tape, grads: dict) -> None:
        w = self.p[f"w{d}"]
        dw, db = np.zeros_like(w), np.zeros_like(self.p[f"c{d}"])
        dh = np.zeros(dh_out.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, a, tanh, m = tape[t]
            dh = dh + dh_out[t]
            inner = m * dh
            d_c = m * dc + inner * o * (1 - tanh * tanh)
            dz = np.concatenate([d_c * a * i * (1 - i), d_c * c * f * (1 - f), inner * tanh * o * (1 - o), d_c * i * (1 - a * a)], axis=1)
            dw[:INPUT] += x[t].T @ dz
            dw[INPUT:] += h.T @ dz
            db += dz.sum(axis=0)
            dh = dz @ w[INPUT:].T + (1 - m) * dh
            dc = d_c * f + (1 - m) * dc
        grads[f"w{d}"], grads[f"c{d}"] = dw, db

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), PAGES_A_STEP):
                x, mask, y = _padded([pages[i] for i in order[a : a + PAGES_A_STEP]])
                p, both, tf, tb = self.forward(x, mask, keep=True)
                slope = ((p - y) * mask / mask.sum()).astype(np.float32)
                grads = {"o": np.tensordot(both, slope, ([0, 1], [0, 1]))[:, None], "k": np.array([slope.sum()], np.float32)}
                d_both = slope[..., None] * self.p["o"][:, 0]
                self._back("f", x, d_both[..., :HIDDEN], tf, grads)
                self._back("b", x[::-1], d_both[::-1, :, HIDDEN:], tb, grads)
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main; short pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        rows: list[int] = []

        def read() -> None:
            x, mask, _ = _padded([(features(pages[i]), None) for i in rows])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(rows):
                out[i] = p[: len(pages[i]), k] >= 0.5
            rows.clear()

        for i in sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])):
            if len(pages[i]) > CELLS:
                out[i] = self._long(pages[i])
                continue
            if rows and (len(rows) + 1) * len(pages[i]) > CELLS:
                read()
            rows.append(i)
        if rows:
            read()
        return out

    def _long(self, page: list[Block]) -> np.ndarray:
        """A page beyond CELLS: each direction goes over it in windows and carries its state."""
        score = np.full(len(page), self.p["k"][0], np.float32)
        starts = range(0, len(page), CELLS)
        for d, order, o in (("f", starts, self.p["o"][:HIDDEN, 0]), ("b", reversed(starts), self.p["o"][HIDDEN:, 0])):
            state = None
            for a in order:
                x = features(page, a, min(a + CELLS, len(page)))[:, None]
                x = x if d == "f" else x[::-1]
                h, _, state = self._run(d, x, np.ones(x.shape[:2], np.float32), False, state)
                h = h[:, 0] @ o
                score[a : a + CELLS] += h if d == "f" else h[::-1]
        return score >= 0


def _padded(pages: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(x) for x, _ in pages)
    x = np.zeros((longest, len(pages), INPUT), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    y = np.zeros((longest, len(pages)), np.float32)
    for k, (f, t) in enumerate(pages):
        x[: len(f), k], mask[: len(f), k] = f, 1
        if t is not None:
            y[: len(f), k] = t
    return x, mask, y


def furnished(source: str, k: int, words: list[str]) -> str:
    """A copy of a page with furniture k before and after its main part."""
    before, after = FURNITURE[k % len(FURNITURE)]
    early, late = FURNITURE[(k * 5 + 3) % len(FURNITURE)]
    pick = " ".join(words[(k * 7) % max(len(words), 1) :][: 3 + k * 13 % 60])
    body = re.search(r"<body[^>]*>", source)
    at = body.end() if body else 0
    end = source.find("</article>")
    end = end + len("</article>") if end >= 0 else len(source)
    spots = [m.end() for m in re.finditer("</p>", source[:end]) if m.start() >= at]
    added = []
    if spots and k % 5 in (1, 2, 3):  # furniture can stand within the main part too
        extra, done = FURNITURE[(k * 3 + 1) % len(FURNITURE)]
        added.append((spots[k * 3 % len(spots)], extra + pick + done))
    if spots and k % 3 != 1:
        for j in range(2):
            extra, done = MATTER[(k + 3 * j) % len(MATTER)]
            some = " ".join(words[(k * 11 + j * 29) % max(len(words), 1) :][: 2 + (k * 5 + j * 7) % 14])
            added.append((spots[(k * 7 + j) % len(spots)], extra + some + done + (extra + some[::-1] + done if "li>" in extra else "")))
    for spot, text in sorted(added, reverse=True):
        source = source[:spot] + text + source[spot:]
        end += len(text)
    page = source[:at] + early + pick + late + source[at:end] + before + pick + after + source[end:]
    # Some pages name their main part by a class only, are wrapped, or have no other furniture.
    if k % 2:
        page = page.replace("<body>", '<body><div class="page wrap">', 1).replace("<h1", "<h2").replace("</h1>", "</h2>")
    if k % 3 == 1:
        page = page.replace("<article", f"<div {MAIN_NAMES[k // 3 % len(MAIN_NAMES)]}").replace("</article>", "</div>")
    if k % 4 == 2:
        page = re.sub(r"<nav.*?</nav>|<footer.*?</footer>", "", page, flags=re.S)
    return page


_LANDMARK = re.compile(r"<(/?)(?:article|main|nav|aside|footer|header|section|form)(?=[\s>/])", re.I)


def plain_names(source: str) -> str:
    """A copy of a page in which no element's name, class, id or role tells what it is for."""
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", _LANDMARK.sub(r"<\1div", source))


def learn(sources: list[str]) -> Labeller:
    model = Labeller()
    pages = []
    for k, source in enumerate(sources):
        plain = blocks(source)
        words = [w for b in plain for w in b.text.split()]
        for j, text in enumerate((source, *(furnished(source, 3 * k + j, words) for j in range(3)))):
            page = blocks(text)
            if not page:
                continue
            y = taught(page)
            hidden = blocks(plain_names(text)) if (k + j) % 2 else []
            for own in (page, hidden if [b.text for b in hidden] == [b.text for b in page] else []):
                pages += [(features(own, a, min(a + WINDOW, len(own))), y[a : a + WINDOW]) for a in range(0, len(own), WINDOW)]
    if pages:
        model.fit(pages)
    return model


def _extractor(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Labeller = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                pages = [blocks(h) if h else [] for h in part.column("__html").to_pylist()]
                marks = model.label(pages)
                texts = ["\n".join(b.text for b, main in zip(p, m) if main) for p, m in zip(pages, marks)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int64())],
                    [*part.schema.names[:2], "text", "n_chars", "n_blocks"],
                )

    return extract


def html_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """id, url, text, n_chars and n_blocks of each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    size = F.length(html_col)
    rows = df.where(F.col(html_col).isNotNull()).select(F.xxhash64(url_col, html_col).alias("h"), size.alias("n"), F.col(html_col).alias("x"))
    # Ids of the sample first, so that only its own pages are sorted or sent.
    keys = rows.where(F.col("n") <= SAMPLE_CHARS).select("h").distinct().orderBy("h").limit(sample)
    if keys.isEmpty():
        keys = rows.groupBy("h").agg(F.min("n").alias("n")).orderBy("n", "h").limit(1).select("h")
    chosen = rows.join(F.broadcast(keys), "h", "left_semi").dropDuplicates(["h"]).orderBy("h").select("x")
    model = learn([r["x"] for r in chosen.collect()])
    pages = df.select(id_col, url_col, F.col(html_col).alias("__html"))
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"`{id_col}` {kind(id_col)}, `{url_col}` {kind(url_col)}, text string, n_chars long, n_blocks long"
    return pages.mapInArrow(_extractor(spark.sparkContext.broadcast(model)), schema)
