"""Main text of pages by a recurrent block labeller, in numpy.

Each block of a page (``html_blocks``) becomes a vector: its tag path and its words, hashed
into fixed dimensions, and a few numbers (length, share of links, punctuation). A
bidirectional LSTM reads the blocks of the whole page in order, and a logistic layer on both
states says whether a block is main text.

The model is trained here, on ``train_pages`` pages that ``training_page`` writes with known
labels: main text in varying containers among menus, headers, footers, side bars,
notices, adverts, forms and reader comments. Training is seeded and takes seconds;
its cost does not depend on the input. Weights (some 100 KB) go to the tasks by closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from versight.llm import textscan
from versight.llm.html_blocks import Path, blocks_of

PATH_DIMS, WORD_DIMS, NUMBERS = 96, 48, 6
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS
HIDDEN = 20
STEP = re.compile(r"[a-z]+[0-9]?|[0-9]+")


@lru_cache(maxsize=100_000)
def _step_dims(step: str) -> tuple[int, ...]:
    """Dimensions of the tag and of the words of its names."""
    tag, _, names = step.partition(".")
    return (crc32(tag.encode()) % PATH_DIMS, *(crc32(b"." + w.encode()) % PATH_DIMS for w in STEP.findall(names)))


def _path_sums(path: Path | None) -> np.ndarray | float:
    """How often each dimension occurs along the path, kept on its steps so that each is added once."""
    todo: list[Path] = []
    while path is not None and path.sums is None:
        todo.append(path)
        path = path.parent
    sums = np.zeros(PATH_DIMS, np.float32) if path is None else path.sums
    for at in reversed(todo):
        sums = sums.copy()
        for d in _step_dims(at.step):
            sums[d] += 1
        at.sums = sums
    return sums


def vectors(blocks: list[tuple[Path | None, str, int]]) -> np.ndarray:
    """One row per block; the last three steps of its path count twice."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        if path is not None:
            x[i, :PATH_DIMS] = _path_sums(path) / 2
            for step in islice(path.steps(), 3):
                for d in _step_dims(step):
                    x[i, d] += 0.5
        n = len(text)
        x[i, -NUMBERS:] = (np.log1p(n) / 6, linked / n, text.count(" ") / 64 if n < 4096 else 1.0, min(1.0, 10 * sum(text.count(c) for c in ".,;!?") / n), text[-1] in ".!?:;\"'”»", 1.0)
    for first, group in textscan.word_hashes([t.encode("utf-8", "surrogatepass") for _, t, _ in blocks], lower=True):
        size = np.array([len(g) for g in group])
        if size.sum():
            h = np.concatenate(group)
            cell = np.repeat(np.arange(len(group)), size) * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64)
            counts = np.bincount(cell, minlength=len(group) * WORD_DIMS).reshape(len(group), WORD_DIMS)
            x[first : first + len(group), PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.maximum(1, np.sqrt((counts**2).sum(1)))[:, None]
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction over padded batches: x is (time, batch, dims), mask (time, batch, 1)."""

    def __init__(self, rng, dims: int, hidden: int):
        self.w = (rng.standard_normal((dims + hidden, 4 * hidden)) / np.sqrt(dims + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1.0

    def forward(self, x, mask, keep=False):
        steps, batch, dims = x.shape
        hidden = len(self.b) // 4
        h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        out, saved = np.zeros((steps, batch, hidden), np.float32), []
        projected = x.reshape(-1, dims) @ self.w[:dims] + self.b
        projected = projected.reshape(steps, batch, -1)
        for t in range(steps):
            z = projected[t] + h @ self.w[dims:]
            i, f, o, g = _sigmoid(z[:, :hidden]), _sigmoid(z[:, hidden : 2 * hidden]), _sigmoid(z[:, 2 * hidden : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t]
            if keep:
                saved.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out, saved

    def backward(self, x, saved, d_out):
        steps, batch, dims = x.shape
        hidden = len(self.b) // 4
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = saved[t]
            dh = dh + d_out[t]
            dn, dkeep = m * dh, (1 - m) * dh
            do, dc2 = dn * tc, m * dc + dn * o * (1 - tc**2)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g**2)], 1)
            dw[:dims] += x[t].T @ dz
            dw[dims:] += h.T @ dz
            db += dz.sum(0)
            dh, dc = dkeep + dz @ self.w[dims:].T, dc2 * f + (1 - m) * dc
        return dw, db


class Labeller:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, DIMS, HIDDEN), Lstm(rng, DIMS, HIDDEN)
        self.v = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def weights(self):
        return [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.c]

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages), 1), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of the blocks of each page; pages of similar length are run together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            at += 1
            while at < len(order) and len(group) < 64 and len(pages[order[at]]) * (len(group) + 1) <= 8192:
                group.append(order[at])
                at += 1
            x, mask = self._padded([pages[i] for i in group])
            a, _ = self.ahead.forward(x, mask)
            b, _ = self.back.forward(x[::-1], mask[::-1])
            z = a @ self.v[:HIDDEN] + b[::-1] @ self.v[HIDDEN:] + self.c
            for k, i in enumerate(group):
                out[i] = z[: len(pages[i]), k]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m, s, n = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()], 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                pick = order[at : at + 16]
                x, mask = self._padded([pages[i] for i in pick])
                y = np.zeros(mask.shape[:2], np.float32)
                for k, i in enumerate(pick):
                    y[: len(labels[i]), k] = labels[i]
                a, sa = self.ahead.forward(x, mask, True)
                b, sb = self.back.forward(x[::-1], mask[::-1], True)
                z = a @ self.v[:HIDDEN] + b[::-1] @ self.v[HIDDEN:] + self.c
                d = (_sigmoid(z) - y) * mask[:, :, 0] / mask.sum()
                gv = np.concatenate([np.einsum("tb,tbh->h", d, a), np.einsum("tb,tbh->h", d, b[::-1])])
                ga = self.ahead.backward(x, sa, d[:, :, None] * self.v[:HIDDEN])
                gb = self.back.backward(x[::-1], sb, (d[:, :, None] * self.v[HIDDEN:])[::-1])
                n += 1
                for k, (w, g) in enumerate(zip(self.weights(), [*ga, *gb, gv, d.sum(keepdims=True).reshape(1)], strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    w -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)


MARK = "\ue000"


def training_page(rng: np.random.Generator) -> str:
    """A page in which each block of main text begins with ``MARK``."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    sound = ["th", "on", "er", "an", "re", "in", "ou", "la", "de", "que", "sch", "ich", "en", "ció", "os", "tion", "é", "ent", "ar"]
    word = lambda: "".join(pick(sound) for _ in range(int(rng.integers(1, 5))))

    def words(lo, hi):
        return " ".join(word() for _ in range(int(rng.integers(lo, hi))))

    def sentences(lo, hi):
        return " ".join(words(2, 18).capitalize() + pick([".", ".", ".", "!", "?"]) for _ in range(int(rng.integers(lo, hi))))

    def rough(text):  # junk text is main text too
        return " ".join(w + pick(["###", "***", "&amp;&amp;", "%%%", " |", "!!"]) for w in text.split()) if rough_page else text

    rough_page = chance(0.15)
    menu = lambda tag: f"<{tag}><ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(int(rng.integers(2, 9)))) + f"</ul></{tag}>"
    box = lambda names, body, tag=None: f'<{tag or pick(["div", "section", "aside"])} {pick(["class", "class", "id"])}="{pick(names)}">{body}</{tag or "div"}>'
    para = lambda text: f"<p>{text}</p>"
    link = lambda: f'<a href="/{word()}">{words(1, 5)}</a>'

    def comments():
        tag, item = pick([("div", "div"), ("div", "div"), ("section", "div"), ("section", "p"), ("ol", "li"), ("div", "p")])
        names = pick(["comment", "comment-body", "reply", ""])
        body = lambda: pick([para, str])(sentences(1, 3)) if item != "p" else sentences(1, 3)
        each = lambda: f"<{item}" + (f' class="{names}">' if names else ">") + pick([f"<b>{word()}</b>: ", f"<b>{word()}</b> ", ""]) + body() + f"</{item}>"
        heading = pick([f"<h3>{words(1, 3)}</h3>", f"<h3>{words(1, 3)}</h3>", f"<h2>{words(1, 3)}</h2>", ""])
        return box(["comments", "comment-list", "reader comments", "responses", "discussion"], heading + "".join(each() for _ in range(int(rng.integers(1, 5)))), tag)

    def junk():
        body = pick([sentences(1, 3), para(sentences(1, 2)), link() + " " + link(), words(1, 6)])
        return pick(
            [
                lambda: menu("nav"),
                lambda: box(["menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs"], " ".join(link() for _ in range(4)), "div"),
                lambda: box(["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo"], body, "div"),
                lambda: box(["ad", "ad", "ads"], sentences(1, 3), "div"),
                lambda: box(["sidebar", "widget", "related", "side"], f"<h3>{words(1, 4)}</h3>" + pick([para(sentences(1, 3)), menu("div")]), pick(["div", "aside"])),
                lambda: f"<aside>{pick([para(sentences(1, 3)), body])}</aside>",
                lambda: box(["notice", "cookie", "cookie-banner", "consent", "alert", "newsletter", "popup", "warning"], pick([para(sentences(1, 2)), sentences(1, 2)]) + "<button>OK</button>", "div"),
                lambda: f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><button>{word()}</button>{pick(["", para(sentences(1, 2))])}</form>',
                lambda: box(["share", "social", "tags", "toolbar"], " ".join(link() for _ in range(3)), "div"),
            ]
        )()

    def main_body():
        out = []
        for _ in range(int(rng.integers(1, 14))):
            text = MARK + rough(sentences(1, 9))
            out.append(
                pick(
                    [
                        lambda t=text: f"<p>{t}</p>",
                        lambda t=text: f"<p>{t}</p>",
                        lambda t=text: f"<p>{t}",
                        lambda t=text: f"<p><b>{t}<br>",
                        lambda t=text: f"<p>{t} {link()} {words(1, 5)}.</p>",
                        lambda t=text: f"<blockquote><p>{t}</p></blockquote>",
                        lambda: f"<{(h := pick(['h2', 'h3']))}>{MARK}{words(1, 8)}</{h}>",
                        lambda: "<ul>" + "".join(f"<li>{MARK}{words(2, 12)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>",
                        lambda t=text: f"<div>{t}</div>",
                        lambda: f"<p>{MARK}{rough(words(1, 5))}</p>",
                    ]
                )()
            )
            if chance(0.04):
                out.append(junk())
        return "".join(out)

    heading = f"<h1>{MARK}{rough(words(1, 12))}</h1>" if chance(0.85) else ""
    body = heading + main_body()
    inner_comments = comments() if chance(0.1) else ""
    main = pick(
        [
            lambda: f"<article>{body}{inner_comments}</article>",
            lambda: f"<article>{body}{inner_comments}</article>",
            lambda: f"<main>{body}</main>{inner_comments}",
            lambda: f'<main><article class="{pick(["post", "story", "entry"])}">{body}</article>{inner_comments}</main>',
            lambda: f'<div {pick(["class", "id"])}="{pick(["content", "main", "main-content", "post", "entry", "article", "article-body", "story", "text", "post-content", "entry-content"])}">{body}</div>{inner_comments}',
            lambda: f'<section class="{pick(["post", "article", "content"])}">{body}</section>{inner_comments}',
        ]
    )()
    head = f'<head><meta charset="utf-8"><title>{words(1, 12)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    top = pick(["", f'<header><a href="/">{words(1, 3)}</a>{menu("nav")}</header>', menu("nav"), f'<div class="header">{words(1, 4)}</div>', f"<header><p>{words(1, 6)}</p></header>"])
    foot = pick(["", "<footer>&copy; {} &middot; {}</footer>", "<footer><p>{}</p><p>{}</p></footer>", '<div class="footer">{} {}</div>', "<footer>{}{}</footer>"]).format(words(1, 4), sentences(1, 2))
    around = "".join(junk() for _ in range(int(rng.integers(0, 4)))), "".join(junk() for _ in range(int(rng.integers(0, 3))))
    return f"<!DOCTYPE html><html>{head}<body>{top}{around[0]}{main}{comments() if chance(0.2) else ''}{around[1]}{foot}" + pick(["</body></html>", ""])


def training_rows(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for _ in range(n):
        blocks = blocks_of(training_page(rng))
        labels.append(np.array([MARK in t for _, t, _ in blocks], np.float32))
        pages.append(vectors([(p, t.replace(MARK, "").strip() or ".", a) for p, t, a in blocks]))
    return pages, labels


@lru_cache(maxsize=2)
def trained(train_pages: int = 1200, epochs: int = 12, seed: int = 3) -> Labeller:
    model = Labeller()
    model.fit(*training_rows(train_pages, seed), epochs)
    return model


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """The id, the url, the main text (blocks joined by a line feed) and n_chars of each row.

    No shuffle. Null and empty html have no blocks, and the text is empty; null ids and urls
    are carried; repeated rows repeat; an empty table gives an empty result. Other columns
    are not read. Texts keep their whole length.
    """
    model = model or trained()
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [blocks_of(h) for h in batch.column(2).to_pylist()]
                scores = model.scores([vectors(b) for b in found])
                texts = ["\n".join(t for (_, t, _), z in zip(b, s, strict=True) if z > 0) for b, s in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"_id {id_type}, _url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
