"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between the tags of block elements, each under the path of its open elements.
A block becomes a vector of hashed path tokens (tags, words of class, id and role), hashed words and a few measures; a
bidirectional LSTM in numpy reads the vectors of the whole page and labels each block. What it labels as main text is
returned in page order, a line a block. Scripts, styles, comments and the head's title are never blocks.

The labeller is trained in this module on pages made from a seed: articles in many kinds of containers, with blocks
inside, between menus, page headers, notices, adverts, sidebars, forms, reader comments and footers. Its words are
invented, so that it learns where text stands, not what the pages to come say.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these kinds, if no element of the others stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PART = re.compile(
    r"""<!--.*?(?:-->|\Z)|<svg(?=[\s/])[^>]*/>|<(script|style|noscript|template|title|textarea|iframe|svg)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z|([^<]+|<)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATH_DIMS, WORD_DIMS, MEASURES = 256, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
#: Blocks of pages that are labelled together.
STEPS = 200_000


def blocks_of(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, characters in links) of the blocks of a page; references decoded, white space made one blank."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple[str, ...], str, int]] = []
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((tuple(x for _, own in stack for x in own), t, linked))
            text, linked = [], 0

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            links -= stack.pop()[0] == "a"

    for m in PART.finditer(page or ""):
        if (run := m[8]) is not None:
            run = entities.unescape(run) if "&" in run else run
            text.append(run)
            if links > 0:
                linked += len(run)
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCK_TAGS:
                flush()
            if at is not None:
                close(at)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            ends, stops = CLOSES.get(name, ({"p"}, set()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ends or stack[i][0] == "p":
                    close(i)
                    if stack and name not in ("tr",):
                        break
        if name in VOID_TAGS:
            continue
        attrs = m[4] or m[7] or ""
        named = [t.lower() for a in NAMED.findall(attrs) for t in TOKEN.findall("".join(a))] if "=" in attrs else []
        stack.append((name, ("<" + name, *named)))
        links += name == "a"
    flush()
    return out


@functools.lru_cache(1 << 14)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for n, x in enumerate(reversed(path)):
        v[zlib.crc32(x.encode("utf-8", "surrogatepass")) % (PATH_DIMS // 2)] = 1.0
        if n < 3:  # the innermost tokens once more on their own
            v[PATH_DIMS // 2 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (PATH_DIMS // 2)] = 1.0
    return v


def vectors(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    out = np.zeros((len(blocks), DIMS), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        out[i, :PATH_DIMS] = path_vector(path)
        words = {w for w in text.lower().split(" ") if w.isalnum()}
        for w in words:
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, PATH_DIMS + h % WORD_DIMS] += (0.2 if h >> 31 else -0.2) / len(words) ** 0.5
        n = text.count(" ") + 1
        out[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 5, np.log1p(len(text)) / 8, linked / max(1, len(text)), text[-1] in ".!?:;\"'”»", i / len(blocks), len(path) / 20)
    return out


def cells(x: np.ndarray, live: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, pages, HIDDEN) of one direction; live: (steps, pages), whether a page has the step."""
    steps, pages = live.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    pre = (x.reshape(steps * pages, -1) @ wx + b).reshape(steps, pages, -1)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = pre[t] + h @ wh
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        m = live[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        c = np.where(m, new, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out


def cells_back(grad: np.ndarray, x: np.ndarray, live: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list) -> list[np.ndarray]:
    """Gradients of wx, wh and b, given those of the hidden states."""
    steps, pages = live.shape
    dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = keep[t]
        m = live[t][:, None]
        dh = dh + grad[t]
        own = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([own * g * i * (1 - i), own * c * f * (1 - f), dh * tc * o * (1 - o), own * i * (1 - g**2)], 1) * m
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = np.where(m, dz @ wh.T, dh)
        dc = np.where(m, own * f, dc)
    flat = dz_all.reshape(steps * pages, -1)
    return [x.reshape(steps * pages, -1).T @ flat, dwh, flat.sum(0)]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (steps, pages, DIMS), the same with each page's blocks in reverse, and live."""
    steps = max(map(len, pages))
    x, r = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages), DIMS), np.float32)
    live = np.zeros((steps, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], r[: len(v), k], live[: len(v), k] = v, v[::-1], True
    return x, r, live


def flipped(out: np.ndarray, sizes: list[int]) -> np.ndarray:
    back = np.zeros_like(out)
    for k, n in enumerate(sizes):
        back[:n, k] = out[:n, k][::-1]
    return back


def scores(model: list[np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """The log odds of each block of each page to be main text."""
    x, r, live = padded(pages)
    sizes = [len(p) for p in pages]
    both = np.concatenate([cells(x, live, *model[:3]), flipped(cells(r, live, *model[3:6]), sizes)], 2)
    z = both @ model[6] + model[7]
    return [z[:n, k] for k, n in enumerate(sizes)]


def label(model: list[np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each block is main text. Pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    group: list[int] = []
    for n, i in enumerate(order):
        group.append(i)
        last = n + 1 == len(order)
        if last or (len(group) + 1) * len(pages[order[n + 1]]) > STEPS // 8 or len(pages[order[n + 1]]) > 1.5 * len(pages[group[0]]) + 4:
            for j, z in zip(group, scores(model, [pages[j] for j in group])):
                out[j] = z > 0
            group = []
    return out


# ---- training pages


def made_page(rng: random.Random) -> tuple[list, list[bool]]:
    """Blocks of a made page, and which are main text."""
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    text = lambda a, b: (" ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"]))
    parts: list[str] = []
    MARK = "⁣"

    def wrap(tag: str, names: list[str], inner: str) -> str:
        how = rng.random()
        extra = f' {rng.choice(["class", "id"])}="{rng.choice([word() + " ", ""])}{rng.choice(names)}{rng.choice(["", "-" + word(), str(rng.randint(1, 9))])}"' if names and how < 0.8 or tag == "div" and names else ""
        return f"<{tag}{extra}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{text(1, 3)}</a></li>' for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="#">{text(1, 3)}</a>' for _ in range(n))

    def para(lo: int = 1, hi: int = 90) -> str:
        t = MARK + text(lo, hi)
        style = rng.random()
        if style > 0.9:  # rows of cells, cries, one word over and over
            one = word()
            t = MARK + rng.choice([" | ".join(text(1, 2) for _ in range(rng.randint(2, 20))), t[1:].upper().replace(" ", "!! "), " ".join([one] * rng.randint(2, 80)), t[1:].replace(" ", "*** ")])
        if style < 0.12:
            t = f"<b>{t}"  # left open
        elif style < 0.3:
            t += f" <a href='x'>{text(1, 4)}</a> {text(1, 20)}"
        return f"<p>{t}" + rng.choice(["</p>", "</p>", "</p>", "<br>", ""])

    def foreign() -> str:
        k = rng.randrange(6)
        if k == 0:
            return wrap("aside", ["sidebar", "related", "promo"], f"<h3>{text(1, 4)}</h3>" + links(3))
        if k == 1:
            return wrap("div", ["ad", "ads", "advert", "sponsor", "banner"], text(2, 25))
        if k == 2:
            return wrap("form", ["subscribe", "newsletter", "search", "login"], f"<label>{text(1, 5)}</label><input type=text><button>{text(1, 2)}</button>")
        if k == 3:
            return wrap("div", ["share", "social", "tags", "breadcrumb", "related", "pagination"], links(rng.randint(2, 5)))
        if k == 4:
            return wrap("div", ["cookie", "consent", "notice", "popup", "modal", "alert"], f"<p>{text(4, 30)}</p><button>{text(1, 2)}</button>")
        return wrap(rng.choice(["section", "div"]), ["comments", "comment", "replies", "discussion"], "".join(wrap(rng.choice(["div", "li", "article"]), ["comment", "reply"], f"<p>{text(3, 50)}</p>") for _ in range(rng.randint(1, 4))))

    head = rng.random()
    if head < 0.75:
        parts.append(wrap("nav", ["menu", "nav", "navigation"], links(rng.randint(2, 8))))
    if head > 0.5:
        parts.append(wrap(rng.choice(["header", "div"]), ["header", "masthead", "top"], f"<h1>{text(1, 5)}</h1>" + links(rng.randint(1, 5))))
    for _ in range(rng.randint(0, 2)):
        parts.append(foreign())
    body: list[str] = []
    if rng.random() < 0.85:
        body.append(f"<h1>{MARK}{text(2, 12)}</h1>")
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        k = rng.random()
        if k < 0.72:
            body.append(para())
        elif k < 0.8:
            body.append(f"<h{rng.randint(2, 4)}>{MARK}{text(1, 8)}</h2>")
        elif k < 0.86:
            body.append("<ul>" + "".join(f"<li>{MARK}{text(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif k < 0.9:
            body.append(f"<blockquote><p>{MARK}{text(3, 40)}</p></blockquote>")
        elif k < 0.93:
            body.append("<table><tr>" + "".join(f"<td>{MARK}{text(1, 4)}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>")
        elif k < 0.95:
            body.append(f"<pre>{MARK}{text(3, 30)}</pre>")
        else:
            body.append(foreign())
    kind = rng.random()
    if kind < 0.6:
        parts.append(wrap("article", rng.choice([[], [], ["post", "entry", "story"]]), "".join(body)))
    elif kind < 0.75:
        parts.append(wrap("main", rng.choice([[], ["content"]]), "".join(body)))
    else:
        parts.append(wrap(rng.choice(["div", "section"]), ["content", "article", "post", "entry", "main", "story", "body"], "".join(body)))
    for _ in range(rng.randint(0, 2)):
        parts.append(foreign())
    if rng.random() < 0.9:
        parts.append(wrap(rng.choice(["footer", "footer", "div"]), ["footer", "copyright", "bottom"], f"&copy; {text(2, 15)}" + (links(3) if rng.random() < 0.4 else "")))
    page = "<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>"
    blocks = blocks_of(page)
    return [(p, t.replace(MARK, ""), n) for p, t, n in blocks], [MARK in t for _, t, _ in blocks]


@functools.lru_cache(1)
def trained(seed: int = 7, pages: int = 900, epochs: int = 10, batch: int = 50, rate: float = 0.015) -> tuple[np.ndarray, ...]:
    """The labeller's weights; a few seconds, the same for the same arguments."""
    made = [made_page(random.Random(seed * 100_003 + i)) for i in range(pages)]
    data = sorted(((vectors(b), np.array(y, np.float32)) for b, y in made if b), key=lambda d: len(d[0]))
    rng = np.random.default_rng(seed)
    new = lambda *shape: rng.normal(0, 0.08, shape).astype(np.float32)
    model = []
    for _ in range(2):
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1.0
        model += [new(DIMS, 4 * HIDDEN) * 0.3, new(HIDDEN, 4 * HIDDEN), b]
    model += [new(2 * HIDDEN), np.zeros(1, np.float32)]
    mean, square = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    step = 0
    for _ in range(epochs):
        for at in rng.permutation(range(0, len(data), batch)):
            some = data[at : at + batch]
            sizes = [len(v) for v, _ in some]
            x, r, live = padded([v for v, _ in some])
            y = np.zeros(live.shape, np.float32)
            for k, (_, own) in enumerate(some):
                y[: len(own), k] = own
            kf: list = []
            kb: list = []
            both = np.concatenate([cells(x, live, *model[:3], kf), flipped(cells(r, live, *model[3:6], kb), sizes)], 2)
            dz = (1 / (1 + np.exp(-(both @ model[6] + model[7]))) - y) * live / live.sum()
            dh = dz[:, :, None] * model[6]
            grads = cells_back(dh[:, :, :HIDDEN], x, live, model[0], model[1], kf) + cells_back(flipped(dh[:, :, HIDDEN:], sizes), r, live, model[3], model[4], kb)
            grads += [np.einsum("tb,tbh->h", dz, both), dz.sum(keepdims=True).reshape(1)]
            step += 1
            for p, g, m, s in zip(model, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g**2 - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return tuple(model)


def main_text(pages: DataFrame, model: tuple[np.ndarray, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the whole html is read, null counts as empty. Without main text, text
    is empty. Repeated and null ids keep their rows."""
    sent = pages.sparkSession.sparkContext.broadcast(list(model or trained()))  # about 150 kB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                some, n, end = [], 0, at
                while end < b.num_rows and n < STEPS // 10:
                    some.append(blocks_of(b.column(2)[end].as_py()))
                    n += len(some[-1])
                    end += 1
                keep = label(sent.value, [vectors(x) for x in some])
                texts = ["\n".join(t for (_, t, _), k in zip(x, y) if k) for x, y in zip(some, keep)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), b.column(1).slice(at, end - at), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = end

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
