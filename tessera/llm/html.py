"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks (text between block-level tags). Each has features of its ancestors (tags, kinds of class and id words) and of its text (length, link share,
punctuation, marks of copyright); a two-state chain (main, other) is trained by exact gradients from forward-backward on labelled pages that `labelled_pages` lays out from a seed, and
decoded by Viterbi. Scripts, styles, forms and other elements without prose never become blocks; a form that wraps a page's content (an article, a main part, a first heading or three
paragraphs) is no form in this sense.

Cases: null or empty html gives an empty text; broken, unclosed and deeply nested markup is parsed as far as it goes, in one pass: a tag without an end is text, a head without an end
ends at the first element that can't be in it; text after the last tag is kept as a block; repeated rows and equal pages get equal results; a null page_id or url is returned as it is;
nothing is cut; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_batch, map_text, pick

#: Kinds of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("audio button canvas datalist head iframe noframes noscript object optgroup option select svg template video".split())
RAW = ("script", "style", "textarea", "title", "xmp")
#: Words of class and id names by the kind of block they tell.
KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner adsense",
    "foot": "footer foot copyright legal colophon credits",
    "head": "header masthead topbar branding logo",
    "side": "sidebar side aside widget related recommended trending popular rail",
    "notice": "notice cookie cookies consent gdpr popup modal alert newsletter subscribe signup paywall overlay share social",
    "comment": "comment comments commentlist reply replies disqus respond discussion",
    "form": "form login search signin register",
    "main": "article content post entry main story text prose",
}
KIND = {w: k for k, words in KINDS.items() for w in words.split()}
_OPEN = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_STOP = re.compile("[<>\"']")
_END = re.compile("[<>]")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Fixed value: what may stand in a head; the first other element ends it.
HEAD = frozenset("base head link meta noscript script style template title".split())
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SAME = frozenset("p li dt dd tr td th option".split())
_LISTS = frozenset("ul ol dl table div section article body".split())


class Block:
    __slots__ = ("text", "tags", "kinds", "linked")

    def __init__(self, text: str, tags: frozenset[str], kinds: frozenset[str], linked: int) -> None:
        self.text, self.tags, self.kinds, self.linked = text, tags, kinds, linked


def tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of tags in one pass; comments, declarations, and elements of raw text with their content have no name. A tag that has no end before the next < is
    text; a quote that is never closed is a character like others."""
    out, at, size = [], 0, len(page)
    never: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in never:
            return -1
        if (i := page.find(what, start)) < 0:
            never.add(what)
        return i

    while (lt := page.find("<", at)) >= 0:
        at = lt + 1
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = size if end < 0 else end + 3
            out.append((lt, at, "", False, ""))
            continue
        if page[at : at + 1] in ("!", "?"):
            if (end := find(">", at)) >= 0:
                at = end + 1
                out.append((lt, at, "", False, ""))
            continue
        m = _OPEN.match(page, lt)
        if not m:
            continue
        place, end = m.end(), -1
        while stop := _STOP.search(page, place):
            c, place = stop[0], stop.end()
            if c == ">":
                end = place
                break
            if c == "<":
                break
            if (closing := find(c, place)) >= 0:
                place = closing + 1
        if end < 0:
            # Quotes may have hidden the end: then it is the first > before another <.
            first = _END.search(page, m.end())
            if not first or first[0] == "<":
                continue
            end = first.end()
        name, closes = m[1].lower(), page[lt + 1] == "/"
        if name in RAW and not closes:
            last = _CLOSE[name].search(page, end)
            at = last.end() if last else size
            out.append((lt, at, "", False, ""))
            continue
        at = end
        out.append((lt, end, name, closes, page[m.end() : end - 1]))
    return out


def _wrappers(found: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Starts of the forms that wrap a page's content and not fields alone: those that hold an article, a main part, a first heading or three paragraphs."""
    out, open_at, score = set(), None, 0
    for start, _, name, closes, _ in found:
        if name == "form" and not closes and open_at is None:
            open_at, score = start, 0
        elif name == "form" and closes:
            open_at = None
        elif open_at is not None and not closes:
            score += 3 if name in ("article", "main", "h1") else name == "p"
            if score >= 3:
                out.add(open_at)
    return out


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    found: list[Block] = []
    open_tags: list[str] = []
    # Of each open element: the tags and the kinds of it and its ancestors; equal sets are one object.
    inside: list[tuple[frozenset[str], frozenset[str]]] = [(frozenset(), frozenset())]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    silent = links = linked = at = 0
    where: tuple | None = None

    def flush() -> None:
        nonlocal linked, where
        text = " ".join(unescape("".join(parts)).split())
        if text and where:
            found.append(Block(text, where[0], where[1], linked))
        parts.clear()
        linked, where = 0, None

    def add(piece: str) -> None:
        nonlocal linked, where
        if piece and not silent:
            parts.append(piece)
            if links:
                linked += len(piece)
            if where is None and not piece.isspace():
                where = inside[-1]

    def close(tag: str, until: frozenset[str] = frozenset()) -> None:
        nonlocal silent, links
        if not depth[tag]:
            return
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i] == tag:
                for t in open_tags[i:]:
                    silent -= t in SILENT or t == "form"
                    links -= t == "a"
                    depth[t] -= 1
                del open_tags[i:], inside[i + 1 :]
                return
            if open_tags[i] in until:
                return

    every = tags(page)
    wrappers = _wrappers(every)
    for start, end, tag, closes, attributes in every:
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in HEAD:
            close("head")
        if tag in BLOCKS or tag == "form":
            flush()
        if closes:
            close(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS or start in wrappers:
            continue
        if tag in _SAME:
            close(tag, _LISTS)
        elif tag in BLOCKS:
            close("p", _LISTS)
        names = " ".join(_NAME.findall(attributes)).lower() if "=" in attributes else ""
        kinds = frozenset(KIND[w] for w in _WORDS.findall(names) if w in KIND)
        tags_, kinds_ = inside[-1]
        open_tags.append(tag)
        depth[tag] += 1
        inside.append((tags_ if tag in tags_ else tags_ | {tag}, kinds_ if kinds <= kinds_ else kinds_ | kinds))
        silent += tag in SILENT or tag == "form"
        links += tag == "a"
    add(page[at:])
    flush()
    return found


def features(block: Block) -> list[str]:
    words = block.text.count(" ") + 1
    share = block.linked / max(1, len(block.text))
    out = ["bias", f"words:{min(6, words.bit_length())}", f"links:{0 if share < 0.2 else 1 if share < 0.6 else 2}"]
    out += [f"in:{t}" for t in block.tags if t not in ("html", "body", "p", "div", "section", "span")]
    out += [f"kind:{k}" for k in block.kinds]
    out.append("stop" if block.text[-1:] in ".!?…:;\"”»" else "open")
    if "©" in block.text or "all rights reserved" in block.text.lower():
        out.append("rights")
    return out


class Chain:
    """Two states: 0 other, 1 main."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.t = np.zeros((2, 2))

    def _codes(self, page: list[Block]) -> list[list[int]]:
        return [[self.names[f] for f in features(b) if f in self.names] for b in page]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Chain:
        for page, _ in pages:
            for b in page:
                for f in features(b):
                    self.names.setdefault(f, len(self.names))
        self.w = np.zeros((len(self.names), 2))
        gw, gt = np.full(self.w.shape, 1e-6), np.full((2, 2), 1e-6)
        coded = [(self._codes(p), y) for p, y in pages]
        for _ in range(epochs):
            for codes, y in coded:
                s = np.array([self.w[c].sum(axis=0) for c in codes])
                n = len(s)
                a, b = s.copy(), np.zeros((n, 2))
                for i in range(1, n):
                    a[i] += np.logaddexp(a[i - 1, 0] + self.t[0], a[i - 1, 1] + self.t[1])
                for i in range(n - 2, -1, -1):
                    x = s[i + 1] + b[i + 1]
                    b[i] = np.logaddexp(self.t[:, 0] + x[0], self.t[:, 1] + x[1])
                z = np.logaddexp(a[-1, 0], a[-1, 1])
                p = np.exp(a + b - z)
                dw, dt = -decay * self.w, -decay * self.t
                for i, c in enumerate(codes):
                    d = -p[i]
                    d[y[i]] += 1
                    dw[c] += d
                    if i:
                        dt[y[i - 1], y[i]] += 1
                        dt -= np.exp(a[i - 1][:, None] + self.t + (s[i] + b[i])[None, :] - z)
                gw += dw * dw
                gt += dt * dt
                self.w += rate * dw / np.sqrt(gw)
                self.t += rate * dt / np.sqrt(gt)
        return self

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely states, by Viterbi."""
        if not page:
            return []
        best, back = None, []
        t = self.t.tolist()
        for c in self._codes(page):
            s0, s1 = self.w[c].sum(axis=0).tolist()
            if best is None:
                best = (s0, s1)
                continue
            from0 = int(best[1] + t[1][0] > best[0] + t[0][0])
            from1 = int(best[1] + t[1][1] > best[0] + t[0][1])
            back.append((from0, from1))
            best = (best[from0] + t[from0][0] + s0, best[from1] + t[from1][1] + s1)
        out = [int(best[1] > best[0])]
        for f in reversed(back):
            out.append(f[out[-1]])
        return out[::-1]


def labelled_pages(n: int = 400, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages laid out at random from common templates: (html, texts of the main blocks)."""
    rng = np.random.default_rng(seed)
    made = []

    def words(low: int, high: int, stop: bool = True) -> str:
        text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(rng.integers(low, high + 1))).capitalize()
        return text + "." if stop and rng.random() < 0.9 else text

    def some(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    def link_list(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3, False)}</a></li>' for _ in range(k)) + "</ul>"

    def boxed(names: str, tags: str, inner: str) -> str:
        tag = some(*tags.split())
        name = some(*names.split())
        return f'<{tag} {some("class", "id")}="{name}">{inner}</{tag}>' if rng.random() < 0.8 or tag in ("div", "section") else f"<{tag}>{inner}</{tag}>"

    def other() -> str:
        k = rng.integers(7)
        prose = f"<p>{words(3, 40)}</p>" if rng.random() < 0.5 else words(3, 30)
        if k == 0:
            return boxed(KINDS["menu"], "nav nav div", link_list(rng.integers(2, 7)))
        if k == 1:
            return boxed(KINDS["advert"], "div aside section", prose)
        if k == 2:
            return boxed(KINDS["side"], "aside aside div", prose + link_list(rng.integers(1, 4)))
        if k == 3:
            return boxed(KINDS["notice"], "div section", prose)
        if k == 4:
            return boxed(KINDS["comment"], "section div", "".join(f'<div class="comment"><p>{words(3, 40)}</p></div>' for _ in range(rng.integers(1, 4))))
        if k == 5:
            return f"<form><label>{words(1, 3, False)}</label><input></form>"
        return f"<script>var a = 1;</script><!-- {words(1, 4)} -->"

    for _ in range(n):
        main: list[str] = []
        body = []
        title = words(2, 10, rng.random() < 0.5)
        main.append(title)
        head = f"<h1>{title}</h1>"
        for _ in range(rng.integers(1, 12)):
            text = words(1, 90)
            main.append(text)
            k = rng.random()
            if k < 0.65:
                body.append(f"<p>{text}</p>")
            elif k < 0.75:
                body.append(f"<p><b>{text}<br>")
            elif k < 0.83:
                body.append(f"<h2>{text}</h2>")
            elif k < 0.9:
                body.append(f"<ul><li>{text}</li></ul>")
            elif k < 0.95:
                body.append(f"<blockquote>{text}</blockquote>")
            else:
                cut_at = text.find(" ", len(text) // 2) + 1
                body.append(f'<p>{text[:cut_at]}<a href="/y">{text[cut_at:]}</a></p>')
            if rng.random() < 0.12:
                body.append(other())
        inner = head + "".join(body)
        k = rng.random()
        if k < 0.5:
            inner = f"<article>{inner}</article>"
        elif k < 0.75:
            inner = f"<main>{inner}</main>"
        else:
            inner = f'<div {some("class", "id")}="{some(*KINDS["main"].split())}">{inner}</div>'
        top = "".join(other() for _ in range(rng.integers(0, 4)))
        if rng.random() < 0.5:
            top = boxed(KINDS["head"], "header header div", words(1, 6, False)) + top
        end = "".join(other() for _ in range(rng.integers(0, 3)))
        end += boxed(KINDS["foot"], "footer footer div", some("&copy; ", "Copyright ", "") + words(2, 20)) if rng.random() < 0.9 else ""
        made.append((f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{top}{inner}{end}</body></html>", main))
    return made


@lru_cache(maxsize=1)
def model() -> Chain:
    pages = []
    for page, main in labelled_pages():
        found, left = blocks(page), list(main)
        labels = []
        for b in found:
            hit = bool(left) and b.text == left[0] and not (b.kinds & {"menu", "advert", "side", "notice", "comment", "foot", "head"})
            labels.append(int(hit))
            if hit:
                left.pop(0)
        pages.append((found, labels))
    return Chain().fit(pages)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, chain.decode(found)) if y)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    chain = model()
    d = pick(pages, "page_id", "url", "html")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(p.as_py(), chain) for p in batch.column(2)]
        schema = pa.schema([("page_id", batch.schema.field(0).type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        yield as_batch([batch.column(0), batch.column(1), texts, [len(t) for t in texts]], schema)

    return map_text(d, "html", run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
