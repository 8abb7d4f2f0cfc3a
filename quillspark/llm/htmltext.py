"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: texts between block-level tags, each with the path of tags, classes and ids above it. A bidirectional
LSTM in numpy reads a vector of the hashed path, the hashed words and a few measures of each block in page order, and tells of every block, in
the context of the whole page, whether it belongs to the article. It is trained on pages made by rule, in which the place of every block is known.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"""['">]""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ANY = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_PARTS = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Fixed values of the HTML standard: elements without content, elements whose text isn't shown, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object audio video canvas select datalist textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input nobr".split())
#: A start tag of the key ends an open element of the values, if it's found before one of the stops.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table body html article section div aside main header footer nav form".split())
_WALLS = _STOPS | {"p", "li", "td", "th", "dd", "blockquote"}

PATH_SIZE, WORD_SIZE, MEASURES = 512, 64, 6
SIZE = PATH_SIZE + WORD_SIZE + MEASURES


class Path:
    """The names of an element after those of the elements around it, which it shares with what else is in them."""

    __slots__ = ("names", "around")

    def __init__(self, names: tuple[str, ...] = (), around: Path | None = None):
        self.names, self.around = names, around

    def __iter__(self) -> Iterator[str]:
        at: Path | None = self
        while at is not None:
            yield from at.names
            at = at.around


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{tag}>"]
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "")
        out += [f"{'@' if kind.lower() == 'role' else '.'}{x.lower()}" for x in _PARTS.findall(_CAMEL.sub(" ", value))]
    return tuple(out)


def _hidden(attributes: str) -> bool:
    """Whether an element has the attribute hidden, other than until-found, or a style by which it isn't shown."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, *values in _ANY.findall(attributes):
        value = entities.unescape(next((v for v in values if v), ""))
        if name.lower() == "hidden" and value.strip().lower() != "until-found" or name.lower() == "style" and _UNSHOWN.search(value):
            return True
    return False


class Markup:
    """The tags of a page, found in time linear in its length whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.broken = False  # whether a tag without end was met, after which tags are looked for with the places below
        self.ends: dict[int, int] = {}  # of a quote or >: where a tag ends that goes on there, -1: nowhere
        self.near = (0, -1)  # from the one to the other there is no quote or >
        self.closed: dict[str, int] = {}  # of a string searched for: the next place of it, -1: none
        self.pairs: dict[str, dict[int, int]] = {}  # of a tag: start to the end of its element

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """start, end, whether an end tag, tag, attributes of the next tag; for a comment or the like no tag, and what is text of it."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            after = page[i + 1 : i + 2]
            if after == "!" or after == "?":
                if page.startswith("<!--", i):
                    end = self.find("-->", i + 4)
                    return i, end + 3 if end >= 0 else len(page), False, None, ""
                if page.startswith("<![CDATA[", i) and (end := self.find("]]>", i + 9)) >= 0:
                    return i, end + 3, False, None, page[i + 9 : end]
                if i < self.last:
                    return i, page.index(">", i) + 1, False, None, ""
            elif i < self.last:
                if not self.broken:
                    if m := _TAG.match(page, i):
                        return i, m.end(), bool(m[1]), m[2].lower(), m[3]
                    self.broken = _NAME.match(page, i) is not None
                if self.broken and (m := _NAME.match(page, i)) and (end := self.tag_end(m.end())) >= 0:
                    return i, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            at = i + 1
        return None

    def find(self, what: str, at: int) -> int:
        """page.find, which doesn't look again for what isn't there."""
        known = self.closed.get(what, at - 1)
        if known != -1 and known < at:
            known = self.closed[what] = self.page.find(what, at)
        return known

    def special(self, at: int) -> int:
        m = _SPECIAL.search(self.page, at)
        return m.start() if m else len(self.page)

    def tag_end(self, at: int) -> int:
        """The place of the first > outside of quotes, -1 if there's none."""
        if not self.near[0] <= at <= self.near[1]:
            self.near = at, self.special(at)
        q, seen, end = self.near[1], [], -1
        while q < len(self.page):
            if q in self.ends:
                end = self.ends[q]
                break
            seen.append(q)
            if self.page[q] == ">":
                end = q
                break
            close = self.page.find(self.page[q], q + 1)
            if close < 0:
                break
            q = self.special(close + 1)
        for q in seen:
            self.ends[q] = end
        return end

    def element_end(self, tag: str, start: int) -> int:
        """The place after the end of the element whose start tag begins at `start`, -1 if it has none."""
        if tag not in self.pairs:
            pairs: dict[int, int] = {}
            open_: list[int] = []
            for m in re.compile(rf"<(/?){tag}(?![a-zA-Z0-9:-])[^>]*>", re.I).finditer(self.page, 0, self.last + 1):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        open_.append(m.start())
                elif open_:
                    pairs[open_.pop()] = m.end()
            self.pairs[tag] = pairs
        return self.pairs[tag].get(start, -1)


class Open:
    """The open elements, with the places of each kind at hand."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = [Path()]
        self.of: dict[str, list[int]] = {}
        self.outer: list[int] = []  # of elements that aren't inline
        self.stops: list[int] = []
        self.walls: list[int] = []  # of elements that a paragraph doesn't reach beyond, and of paragraphs

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        self.of.setdefault(tag, []).append(i)
        self.paths.append(self.paths[-1] if tag in INLINE else Path(names, self.paths[-1]))
        for kind, own in ((self.outer, tag not in INLINE), (self.stops, tag in _STOPS), (self.walls, tag in _WALLS)):
            if own:
                kind.append(i)

    def cut(self, i: int) -> None:
        """Close all elements from the i-th on."""
        while len(self.tags) > i:
            self.of[self.tags.pop()].pop()
            self.paths.pop()
        for kind in (self.outer, self.stops, self.walls):
            while kind and kind[-1] >= i:
                kind.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost such element, -1 if there's none."""
        places = self.of.get(tag)
        return places[-1] if places else -1


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order: entities decoded, white space as one space, none empty."""
    out: list[Block] = []
    markup, open_ = Markup(page), Open()
    parts: list[str] = []
    linked = 0
    solid = False  # whether a part has more than white space
    where = open_.paths[0]
    at = 0

    def flush() -> None:
        nonlocal linked, solid
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, where, linked))
            parts.clear()
        linked, solid = 0, False

    def add(text: str) -> None:
        nonlocal linked, where, solid
        if text:
            if not solid:
                own = bool(text.strip())
                if not parts or own or where is open_.paths[0]:
                    where = open_.paths[-1]
                solid = own
            parts.append(text)
            if open_.of.get("a"):
                linked += len(text)

    while found := markup.next(at):
        start, end, is_end, tag, attributes = found
        add(page[at:start])
        at = end
        if tag is None:
            add(attributes)
            continue
        if is_end:
            if tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            i = open_.last(tag)
            if i < 0:
                if tag not in INLINE:
                    flush()
                continue
            if tag in INLINE and open_.outer and open_.outer[-1] > i:
                continue
            if tag not in INLINE:
                flush()
            open_.cut(i)
            continue
        if tag in UNSEEN or tag not in VOID and _hidden(attributes):
            if attributes.endswith("/"):
                continue
            if tag not in UNSEEN:
                at = max(at, markup.element_end(tag, start))
                continue
            close = _close(markup, tag, at)
            if close < 0 and tag in ("head", "select", "button", "svg", "math"):
                continue
            at = close if close >= 0 else _parents_end(markup, open_.of, at)
            continue
        if tag in VOID:
            if tag in ("br", "img", "input"):
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if open_.walls and open_.tags[open_.walls[-1]] == "p":
                open_.cut(open_.walls[-1])
            if tag in _ENDS:
                i = max(map(open_.last, _ENDS[tag]))
                if i >= 0 and (not open_.stops or i > open_.stops[-1]):
                    open_.cut(i)
        if not attributes.endswith("/"):
            open_.push(tag, _names(tag, attributes))
    add(page[at:])
    flush()
    return out


def _close(markup: Markup, tag: str, at: int) -> int:
    """The place after the next end tag of that name, -1 if there's none."""
    known = markup.closed.get("/" + tag, at - 1)
    if known != -1 and known <= at:
        m = re.compile(rf"</{tag}\s*>", re.I).search(markup.page, at)
        known = markup.closed["/" + tag] = m.end() if m else -1
    return known


def _parents_end(markup: Markup, open_: dict[str, list[int]], at: int) -> int:
    """The place of the end tag that closes one of the open elements around an element without an end; the page's end if there is none."""
    depth: dict[str, int] = {}
    while found := markup.next(at):
        start, at, is_end, tag, attributes = found
        if not tag or tag in VOID or attributes.endswith("/"):
            continue
        if not is_end:
            depth[tag] = depth.get(tag, 0) + 1
        elif depth.get(tag):
            depth[tag] -= 1
        elif open_.get(tag):
            return start
    return len(markup.page)


@cache
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % PATH_SIZE


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = i = zlib.crc32(word.lower().strip(".,;:!?()").encode("utf-8", "replace")) % WORD_SIZE
        return i


_words = _Words()


def _masks(page: list[Block], known: frozenset[str]) -> Iterator[int]:
    """Of each block the buckets of its path's names, as bits. Names that training never saw say nothing, rather than what their bucket's others do."""
    seen: dict[int, int] = {}
    for b in page:
        chain, at = [], b.path
        while at is not None and id(at) not in seen:
            chain.append(at)
            at = at.around
        mask = seen[id(at)] if at is not None else 0
        for p in reversed(chain):
            for n in p.names:
                if n in known:
                    mask |= 1 << _bucket(n)
            seen[id(p)] = mask
        yield mask


def vectors(page: list[Block], known: frozenset[str], step: int = 0) -> Iterator[np.ndarray] | np.ndarray:
    """One row a block; with a step, in runs of so many rows."""
    if step:
        return _vectors(page, known, step)
    return next(_vectors(page, known, len(page)), np.zeros((0, SIZE), np.float32))


def _vectors(page: list[Block], known: frozenset[str], step: int) -> Iterator[np.ndarray]:
    masks = _masks(page, known)
    for a in range(0, len(page), step or 1):
        own = page[a : a + step]
        out = np.zeros((len(own), SIZE), np.float32)
        for i, b in enumerate(own):
            out[i, :PATH_SIZE] = np.unpackbits(np.frombuffer(next(masks).to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little")
            words = b.text.split()
            counts = np.bincount([_words[w] for w in words], minlength=WORD_SIZE)
            out[i, PATH_SIZE:-MEASURES] = counts / (2 * np.linalg.norm(counts))
            n = len(b.text)
            out[i, -MEASURES:] = np.log1p(n) / 8, min(1.0, b.linked / n), np.log1p(len(words)) / 6, b.text[-1] in ".!?。", (a + i) / len(page), min(len(page), 200) / 200
        yield out


@dataclass
class Labeller:
    """A bidirectional LSTM with a logistic unit over both directions."""

    known: frozenset[str]
    weights: dict[str, np.ndarray]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block of each page, from its vectors."""
        return self._labelled([self._inputs([x]) for x in pages])

    def of_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each block of each page. Vectors are made a few thousand at a time, so a page may have any number of blocks."""
        return self._labelled([self._inputs(vectors(b, self.known, 4096)) for b in pages])

    def _inputs(self, runs: Iterable[np.ndarray]) -> np.ndarray:
        """What the units of both directions get of each block's vector."""
        w = np.concatenate([self.weights["fw"], self.weights["rw"]], axis=1)
        made = [x @ w for x in runs]
        return (np.concatenate(made) if made else np.zeros((0, w.shape[1]), np.float32)) + np.concatenate([self.weights["fb"], self.weights["rb"]])

    def _labelled(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Pages go in batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + 64]
            while len(group) > 1 and len(group) * len(pages[group[-1]]) > 8192:
                group = group[: len(group) // 2]
            at += len(group)
            z, mask = _padded([pages[i] for i in group])
            half = z.shape[2] // 2
            p = _recur(self.weights, {"f": z[:, :, :half], "r": z[:, :, half:]}, mask)
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((n, len(pages), 1), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
    """Probabilities by block and page, and what the backward pass needs."""
    n, batch, _ = x.shape
    seen: dict = {"f": [], "r": []}
    z = {d: (x.reshape(-1, SIZE) @ w[d + "w"] + w[d + "b"]).reshape(n, batch, -1) for d in seen}
    return _recur(w, z, mask, seen), seen


def _recur(w: dict[str, np.ndarray], z: dict[str, np.ndarray], mask: np.ndarray, seen: dict | None = None) -> np.ndarray:
    """Probabilities by block and page, from the inputs of both directions; the steps are kept in `seen`."""
    n, batch, _ = mask.shape
    out = np.full((n, batch), w["b"][0], np.float32)
    for d in ("f", "r"):
        hidden = w[d + "u"].shape[0]
        h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = z[d][t] + h @ w[d + "u"]
            ifo, g = _sigmoid(a[:, : 3 * hidden]), np.tanh(a[:, 3 * hidden :])
            i, f, o = ifo[:, :hidden], ifo[:, hidden : 2 * hidden], ifo[:, 2 * hidden :]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if seen is not None:
                seen[d].append((t, h, c, i, f, o, g, tc))
            h, c = o * tc * mask[t], c2 * mask[t]
            out[t] += (h @ w[d + "o"])[:, 0]
    return _sigmoid(out)


def _backward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, error: np.ndarray, seen: dict) -> dict[str, np.ndarray]:
    """Gradients; error: of the logistic unit's input, by block and page."""
    grad = {"b": np.array([error.sum()], np.float32)}
    n, batch, _ = x.shape
    for d in ("f", "r"):
        hidden = w[d + "u"].shape[0]
        da = np.zeros((n, batch, 4 * hidden), np.float32)
        du, do = np.zeros_like(w[d + "u"]), np.zeros_like(w[d + "o"])
        dh_next, dc_next = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        for t, h, c, i, f, o, g, tc in reversed(seen[d]):
            do += (o * tc * mask[t]).T @ error[t][:, None]
            dh = (error[t][:, None] @ w[d + "o"].T + dh_next) * mask[t]
            dc = dh * o * (1 - tc * tc) + dc_next * mask[t]
            da[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            du += h.T @ da[t]
            dh_next, dc_next = da[t] @ w[d + "u"].T, dc * f
        flat = da.reshape(n * batch, -1)
        grad |= {d + "w": x.reshape(-1, SIZE).T @ flat, d + "b": flat.sum(axis=0), d + "u": du, d + "o": do}
    return grad


def train(pages: list[tuple[str, list[bool]]], hidden: int = 16, epochs: int = 8, seed: int = 3) -> Labeller:
    """From pages and whether each of their blocks belongs to the article; Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    cut = [(blocks(p), y) for p, y in pages]
    known = frozenset(n for b, _ in cut for x in b for n in x.path)
    data = sorted(((vectors(b, known), np.array(y, np.float32)) for b, y in cut if b), key=lambda v: len(v[1]))
    w: dict[str, np.ndarray] = {"b": np.zeros(1, np.float32)}
    for d in ("f", "r"):
        w[d + "w"] = (rng.standard_normal((SIZE, 4 * hidden)) * 0.1).astype(np.float32)
        w[d + "b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        w[d + "u"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        w[d + "o"] = (rng.standard_normal((hidden, 1)) / np.sqrt(hidden)).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    batches = [data[i : i + 48] for i in range(0, len(data), 48)]
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for j in rng.permutation(len(batches)):
            x, mask = _padded([a for a, _ in batches[j]])
            keep = rng.random((1, x.shape[1], SIZE)) > 0.02  # a name that a page lacks: others must do
            x *= keep
            y = np.zeros(x.shape[:2], np.float32)
            for i, (_, own) in enumerate(batches[j]):
                y[: len(own), i] = own
            p, seen = _forward(w, x, mask)
            error = (p - y) * mask[:, :, 0] / x.shape[1]
            t += 1
            for k, g in _backward(w, x, mask, error, seen).items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Labeller(known, {k: x.astype(np.float32) for k, x in w.items()})


@cache
def default_labeller(pages: int = 2000) -> Labeller:
    """Trained on so many made pages; once a process."""
    from .htmlpages import made_page

    rng = np.random.default_rng(11)
    return train([made_page(rng) for _ in range(pages)])


def main_text(page: str | None, labeller: Labeller) -> str:
    return main_texts([page], labeller)[0]


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The blocks of each page that belong to its article, joined by line feeds; null and empty pages: empty."""
    cut = [blocks(p or "") for p in pages]
    chances = labeller.of_blocks(cut)
    return ["\n".join(x.text for x, c in zip(b, p, strict=True) if c >= 0.5) for b, p in zip(cut, chances, strict=True)]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page's main text; html null or without an article: empty.

    pages needs page_id, url and html, and other columns aren't read; a null page_id or url stays null. Rows are taken each by itself, repeated ones too. A block at a chance of just 0.5
    belongs to the article. Time grows with a page's length in proportion, however broken its markup; very long pages, blocks and texts come out whole. Empty table: no rows.
    """
    labeller = labeller or default_labeller()

    def run(batch: pa.RecordBatch) -> dict:
        found = main_texts(batch.column("html").to_pylist(), labeller)
        return {"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", 64)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract of each row of pages."""
    return extract(table(spark, sf_dir, "pages"))
