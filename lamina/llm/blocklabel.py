"""Main text of web pages by a recurrent block labeller.

Every page is a sequence of leaf blocks. A block's vector holds learned vectors of its hashed tag path
(elements and the words of their class, id and role), of its innermost elements and of its hashed words,
and a few plain measures (length, linked share, punctuation, place). A bidirectional LSTM in numpy reads
the sequence both ways, so that every block is classified with the whole document as context. Blocks
labelled as article are joined in page order.

The model is trained here, on pages that `sample_page` composes from a seed: articles among menus,
headers, footers, sidebars, notices, adverts, forms and comments, in many layouts, with and without
telling names. Training sees none of the input.

Pages are labelled together while they fill at most `CELLS` places; a page of more blocks is read in stretches of
as many, whose states are handed on both ways, so memory stays bounded and the result is that of one piece.

Defined cases: a null or empty page has an empty text; a page of any length is read whole, in linear time; repeated
rows get equal results, as pages do not look at each other; a block at even odds belongs to the article; a page
without article blocks has an empty text; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm._common import batch, map_batches
from lamina.llm.htmlblocks import Block, blocks

#: Buckets and sizes of the learned vectors: path, innermost elements, words.
BUCKETS = (2048, 1024, 512)
SIZES = (24, 16, 8)
MEASURES = 11
HIDDEN = 24
PAGES = 1000
EPOCHS = 7
TOGETHER = 16
SEED = 20
#: Pages that are labelled together at most, and blocks that they have room for.
GROUP = 64
CELLS = 1 << 15
INNERMOST = 3

#: Names by the role of what they mark.
NAMES = {
    "content": "content article post entry story main body text article-body post-content entry-content story-body page-content mw-content-text hentry prose markdown-body single primary column",
    "nav": "nav navbar menu main-menu topnav breadcrumb breadcrumbs navigation tabs pagination pager skip-link site-nav submenu toc",
    "header": "header masthead site-header top-bar branding logo site-title tagline topbar hero-header page-header",
    "footer": "footer site-footer bottom copyright colophon legal credits foot footer-links imprint",
    "sidebar": "sidebar aside widget widget-area rail right-col secondary related recommended trending popular most-read tags tag-cloud archive read-more teaser",
    "notice": "notice cookie cookie-banner consent gdpr alert modal popup overlay paywall warning announcement message toast disclaimer privacy-notice notification banner",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbygoogle adslot ad-container outbrain taboola affiliate advertorial commercial",
    "form": "form search search-form newsletter signup subscribe login contact-form searchbox register",
    "comments": "comments comment comment-list commentlist comment-body replies reply discussion disqus-thread responses reader-comments user-comments respond feedback",
    "meta": "share social share-buttons byline meta post-meta author date post-tags timestamp likes",
    "neutral": "box wrap wrapper container row col inner block section panel layout group item grid page",
}
_NAMES = {k: v.split() for k, v in NAMES.items()}
_SYLLABLES = "the an re in on er ti en at ed th al or st ion de la le que el os un der ung sch ge ver ou eau é ü ñ ción ble ing a o i u ka mo ri sa to ne ло ва ни ко 的 是 了 不 人".split()


class _Pages:
    """Composes training pages; every piece is marked with whether it belongs to the article."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        style = r.random()
        n = int(np.exp(r.uniform(np.log(least), np.log(most))))
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
        if style < 0.08:
            out = [x.upper() + r.choice(["", "!!"]) for x in out]
        elif style < 0.16:
            out = [x + r.choice(["***", "###", "$$$", "%%%", "&amp;&amp;"]) for x in out]
        elif style < 0.22:
            out = [x + " |" for x in out]
        else:
            for i in range(n):
                if r.random() < 0.12:
                    out[i] += r.choice([".", ",", ".", "?", "&#8217;", "&nbsp;"])
            out[0] = out[0].capitalize()
            out[-1] += r.choice([".", ".", ""])
        return " ".join(out)

    def name(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        names = [r.choice(_NAMES[kind] if r.random() < 0.9 else _NAMES["neutral"])]
        if r.random() < 0.3:
            names.append(r.choice(_NAMES["neutral"]))
        if r.random() < 0.15:
            names[0] += f"-{r.randint(1, 99)}"
        return f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"'

    def wrap(self, inner: str, kind: str, tags: str) -> str:
        tag = self.r.choice(tags.split())
        out = f"<{tag}{self.name(kind)}>{inner}</{tag}>"
        if self.r.random() < 0.2:
            out = f"<div{self.name('neutral')}>{out}</div>"
        return out

    def mark(self, text: str) -> str:
        """Article text carries a marker, which the labels are read from."""
        return "\x02" + text

    def paragraph(self, article: bool, least: int = 1, most: int = 120) -> str:
        r = self.r
        text = self.words(least, most)
        if article:
            text = self.mark(text)
        tag = r.choice(["p"] * 12 + ["div", "blockquote", "h2", "h3", "li", "li", "pre", "figcaption", "table"])
        if r.random() < 0.15:
            pieces = text.split(" ")
            at = r.randrange(len(pieces))
            word = pieces[at]
            pieces[at] = r.choice([f"<b>{word}</b>", f'<a href="/x">{word}</a>', f"<em>{word}</em>", f"<span>{word}</span>"])
            text = " ".join(pieces)
        if tag == "li":
            more = "".join(f"<li>{self.mark(self.words(1, 20)) if article else self.words(1, 20)}</li>" for _ in range(r.randint(0, 4)))
            return f"<{(kind := r.choice(['ul', 'ol']))}><li>{text}</li>{more}</{kind}>"
        if tag == "table":
            cell = lambda: self.mark(self.words(1, 6)) if article else self.words(1, 6)
            rows = "".join(f"<tr><{t}>{cell()}</{t}><{t}>{cell()}</{t}></tr>" for t in r.choices(["td", "td", "th"], k=r.randint(1, 4)))
            return f"<table>{rows}</table><p>{text}</p>"
        if r.random() < 0.06:
            return f"<p><b>{text}<br>"
        return f"<{tag}>{text}</{tag}>"

    def links(self, kind: str) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(1, 5)}</a>' for i in range(r.randint(1, 9))]
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items) if r.random() < 0.5 else "".join(f"<div>{x}</div>" for x in items)

    def other(self, kind: str) -> str:
        """A piece that is no part of the article."""
        r = self.r
        if kind == "nav":
            return self.wrap(self.links(kind), kind, "nav nav nav div ul section")
        if kind == "header":
            title = f"<h1>{self.words(1, 6)}</h1>"
            inner = r.choice([title, title, title + f"<p>{self.words(2, 9)}</p>", f"<div>{self.words(1, 6)}</div>", f"<p>{self.words(2, 12)}</p>", f'<a href="/">{self.words(1, 3)}</a>'])
            inner += self.other("nav") if r.random() < 0.4 else ""
            return f"<header>{inner}</header>" if r.random() < 0.4 else self.wrap(inner, kind, "header header div")
        if kind == "footer":
            inner = r.choice([f"&copy; {self.words(1, 12)}", f"<p>{self.words(3, 30)}</p>", f"<p>&copy; 2024 {self.words(2, 9)}</p>" + self.links(kind), self.links(kind), f"{self.words(2, 25)} &middot; {self.words(1, 9)}"])
            return self.wrap(inner, kind, "footer footer footer div")
        if kind == "sidebar":
            inner = f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>" * (r.random() < 0.6) + r.choice([self.links(kind), "".join(f"<p>{self.words(2, 60)}</p>" for _ in range(r.randint(1, 4)))])
            return self.wrap(inner, kind, "aside aside div section")
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q>" * r.randint(1, 4) + f"<button>{self.words(1, 3)}</button>" + r.choice(["", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>", f"<textarea>{self.words(1, 9)}</textarea>"])
            return self.wrap(f"<p>{self.words(2, 20)}</p>" * (r.random() < 0.5) + inner, kind, "form form form")
        if kind == "comments":
            many = r.randint(1, 6)
            item = lambda: self.wrap((f"<span{self.name('meta')}>{self.words(1, 3)}</span>" if r.random() < 0.5 else "") + r.choice([f"<p>{self.words(2, 70)}</p>", self.words(2, 70), f"<div>{self.words(2, 50)}</div>"]), kind, "div li article section")
            head = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6)
            return f"<{(tag := r.choice(['section', 'div', 'div', 'ol', 'ul']))} {r.choice(['class', 'id'])}=\"{r.choice(_NAMES['comments'])}\">{head}{''.join(item() for _ in range(many))}</{tag}>"
        if kind == "meta":
            return self.wrap(r.choice([self.words(1, 6), self.links(kind), f"<time>{r.randint(1, 28)}.{r.randint(1, 12)}.2024</time>"]), kind, "div p span ul")
        inner = r.choice([self.words(2, 50), f"<p>{self.words(2, 50)}</p>", f"<p>{self.words(2, 30)}</p><a href='/x'>{self.words(1, 3)}</a>", f"<p>{self.words(2, 30)}</p><button>{self.words(1, 2)}</button>"])
        name = f' {r.choice(["class", "class", "id", "role"])}="{r.choice(_NAMES[kind])}"'
        return f"<{(tag := r.choice(['div', 'div', 'section', 'aside', 'p' if '<p' not in inner else 'div']))}{name}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        inner, bare = [], r.random() < 0.08
        if r.random() < 0.8:
            title = f"<h1>{self.mark(self.words(2, 14))}</h1>"
            inner.append(f"<header>{title}</header>" if r.random() < 0.08 and not bare else title)
        if r.random() < 0.2:
            inner.append(self.other("meta"))
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8, 12, 20, 30])):
            inner.append(self.paragraph(True))
            if r.random() < 0.06:
                inner.append(self.other(r.choice(["ad", "ad", "sidebar", "notice", "form", "meta"])))
        if r.random() < 0.1:
            inner.append(self.other(r.choice(["comments", "meta", "nav"])))
        text = "".join(inner)
        if bare:
            return text
        if r.random() < 0.6:
            return f"<article{self.name('content')}>{text}</article>"
        return f"<{(tag := r.choice(['div', 'main', 'section', 'div', 'td']))} {r.choice(['class', 'id'])}=\"{r.choice(_NAMES['content'])}\">{text}</{tag}>" if r.random() < 0.85 else f"<div>{text}</div>"

    def page(self) -> str:
        r = self.r
        before = [k for k in ("header", "nav", "notice", "ad", "form", "sidebar") if r.random() < 0.42]
        after = [k for k in ("comments", "sidebar", "ad", "form", "notice", "nav", "footer", "footer") if r.random() < 0.42]
        r.shuffle(before)
        article = self.article() if r.random() < 0.96 else ""
        if r.random() < 0.3:
            article = f"<main>{article}{self.other('comments') if r.random() < 0.2 else ''}</main>"
        body = "".join(map(self.other, before)) + article + "".join(map(self.other, after))
        if r.random() < 0.3:
            body = f"<div{self.name('neutral')}>{body}</div>"
        head = f"<head><meta charset='utf-8'><title>{self.words(1, 9)}</title><style>p{{}}</style></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html lang='en'>{head}<body>{body}</body></html>"


def sample_page(seed: int) -> str:
    """A page for training; article blocks start with the character U+0002."""
    return _Pages(seed).page()


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return value


_hashes = _Hashes()


def _bag(tokens: list[str], buckets: int) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), dtype=np.int64, count=len(tokens)) % buckets


def _measures(block: Block, i: int, n: int) -> list[float]:
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    stops = text.count(".") + text.count(",") + text.count("?") + text.count("!")
    return [
        np.log1p(size) / 5, np.log1p(words) / 4, block.linked / size, stops / words, size / words / 10, float(text[-1] in ".!?"), i / n, 1 - (i + 1) / n,
        min(n, 200) / 200, len(block.path) / 20, 1.0,
    ]


class Features:
    """Sequences as padded arrays: bags of buckets as (row, column, bucket) lists and measures."""

    def __init__(self, pages: list[list[Block]], begin: int = 0, whole: int = 0) -> None:
        """`begin` and `whole` place the blocks of a single page that is read in stretches."""
        self.lengths = np.array([len(x) for x in pages])
        self.steps, self.pages = int(self.lengths.max()), len(pages)
        self.measures = np.zeros((self.steps, self.pages, MEASURES), dtype=np.float32)
        bags: tuple[list, list, list] = ([], [], [])
        cells: list[int] = []
        paths: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for p, page in enumerate(pages):
            for i, block in enumerate(page):
                if block.path not in paths:
                    paths[block.path] = _bag(sorted({x for e in block.path for x in e}), BUCKETS[0]), _bag([f"{d}{x}" for d, e in enumerate(block.path[: -INNERMOST - 1 : -1]) for x in e], BUCKETS[1])
                first, second = paths[block.path]
                bags[0].append(first)
                bags[1].append(second)
                bags[2].append(_bag(block.text.lower().split(), BUCKETS[2]))
                cells.append(i * self.pages + p)
                self.measures[i, p] = _measures(block, begin + i, whole or len(page))
        self.bags = []
        where = np.array(cells)
        for bag in bags:
            sizes = np.array([len(x) for x in bag])
            self.bags.append((np.concatenate(bag), np.repeat(where, sizes), np.repeat(1 / np.maximum(sizes, 1), sizes).astype(np.float32)))
        self.mask = np.arange(self.steps)[:, None] < self.lengths[None, :]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The bidirectional LSTM with its vectors; all arrays are in `weights`."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        size = sum(SIZES) + MEASURES
        self.weights: dict[str, np.ndarray] = {f"vectors{k}": r.normal(0, 0.3, (n, d)) for k, (n, d) in enumerate(zip(BUCKETS, SIZES, strict=True))}
        for way in "fb":
            self.weights[f"in_{way}"] = r.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.weights[f"back_{way}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.weights[f"bias_{way}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.weights["out"] = r.normal(0, HIDDEN**-0.5, (2 * HIDDEN + size, 1))
        self.weights["out_bias"] = np.zeros(1)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def inputs(self, x: Features) -> np.ndarray:
        parts = []
        for k, (bucket, cell, share) in enumerate(x.bags):
            flat = np.zeros((x.steps * x.pages, SIZES[k]), dtype=np.float32)
            rows = self.weights[f"vectors{k}"][bucket] * share[:, None]
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
            if len(starts):
                flat[cell[starts]] = np.add.reduceat(rows, starts, axis=0)
            parts.append(flat.reshape(x.steps, x.pages, -1))
        return np.concatenate([*parts, x.measures], axis=2)

    def read(self, inputs: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None, state: list[np.ndarray] | None = None) -> np.ndarray:
        """Hidden states of one direction; a padded step leaves the state as it is. `state` is gone on from and renewed."""
        steps, pages, _ = inputs.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        back, out = self.weights[f"back_{way}"], np.zeros((steps, pages, HIDDEN), np.float32)
        ready = inputs @ self.weights[f"in_{way}"] + self.weights[f"bias_{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = ready[t] + h @ back
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tanh_c = np.tanh(new_c)
            new_h = np.where(m, o * tanh_c, h)
            if keep is not None:
                keep.append((t, h, c, f, i, o, g, tanh_c, m))
            h, c = new_h, new_c
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def _odds(self, forth: np.ndarray, back: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        return _sigmoid(np.concatenate([forth, back, inputs], axis=2) @ self.weights["out"] + self.weights["out_bias"])[:, :, 0]

    def probabilities(self, x: Features) -> np.ndarray:
        inputs = self.inputs(x)
        return self._odds(self.read(inputs, x.mask, "f"), self.read(inputs, x.mask, "b"), inputs)

    def of_long(self, page: list[Block], stretch: int) -> np.ndarray:
        """The probabilities of one page's blocks, read in stretches."""
        starts = range(0, len(page), stretch)
        forth, out = [], np.zeros(len(page), np.float32)
        for way, order in (("f", starts), ("b", reversed(starts))):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for at in order:
                x = Features([page[at : at + stretch]], at, len(page))
                inputs = self.inputs(x)
                hidden = self.read(inputs, x.mask, way, state=state)
                if way == "f":
                    forth.append(hidden)
                else:
                    out[at : at + stretch] = self._odds(forth[at // stretch], hidden, inputs)[:, 0]
        return out

    def gradients(self, x: Features, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, grad = self.weights, {}
        inputs = self.inputs(x)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([*(self.read(inputs, x.mask, way, kept[way]) for way in "fb"), inputs], axis=2)
        error = ((_sigmoid(both @ w["out"] + w["out_bias"])[:, :, 0] - labels) * x.mask / x.mask.sum()).astype(np.float32)
        grad["out"] = np.einsum("tpd,tp->d", both, error)[:, None]
        grad["out_bias"] = np.array([error.sum()])
        d_both = error[:, :, None] * w["out"][:, 0]
        d_inputs = d_both[:, :, 2 * HIDDEN :].copy()
        for k, way in enumerate("fb"):
            d_out = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_z = np.zeros((x.steps, x.pages, 4 * HIDDEN), np.float32)
            d_back = np.zeros_like(w[f"back_{way}"])
            d_h, d_c = np.zeros((x.pages, HIDDEN), np.float32), np.zeros((x.pages, HIDDEN), np.float32)
            for t, h, c, f, i, o, g, tanh_c, m in reversed(kept[way]):
                d_h = d_h + d_out[t]
                real_h, real_c = np.where(m, d_h, 0), np.where(m, d_c, 0)
                real_c = real_c + real_h * o * (1 - tanh_c**2)
                d_z[t] = np.concatenate([real_c * c * f * (1 - f), real_c * g * i * (1 - i), real_h * tanh_c * o * (1 - o), real_c * i * (1 - g**2)], axis=1)
                d_back += h.T @ d_z[t]
                d_h = np.where(m, d_z[t] @ w[f"back_{way}"].T, d_h)
                d_c = np.where(m, real_c * f, d_c)
            flat = d_z.reshape(-1, 4 * HIDDEN)
            grad[f"in_{way}"] = inputs.reshape(-1, inputs.shape[2]).T @ flat
            grad[f"back_{way}"] = d_back
            grad[f"bias_{way}"] = flat.sum(axis=0)
            d_inputs += d_z @ w[f"in_{way}"].T
        at = 0
        for k, (bucket, cell, share) in enumerate(x.bags):
            part = d_inputs[:, :, at : at + SIZES[k]].reshape(-1, SIZES[k])
            at += SIZES[k]
            out = np.zeros_like(w[f"vectors{k}"])
            np.add.at(out, bucket, part[cell] * share[:, None])
            grad[f"vectors{k}"] = out
        return grad


def training_sequence(seed: int) -> tuple[list[Block], list[int]]:
    """The blocks of a sample page and their labels."""
    found = blocks(sample_page(seed))
    labels = [int("\x02" in x.text) for x in found]
    clean = [Block(x.path, x.text.replace("\x02", ""), x.linked) for x in found]
    kept = [i for i, x in enumerate(clean) if x.text]
    return [clean[i] for i in kept], [labels[i] for i in kept]


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller trained by Adam on sample pages; the same for the same arguments."""
    model = Labeller(seed)
    data = [x for x in map(training_sequence, range(seed * 100_000, seed * 100_000 + pages)) if x[0]]
    data.sort(key=lambda x: len(x[0]))
    groups = [data[i : i + TOGETHER] for i in range(0, len(data), TOGETHER)]
    ready = []
    for group in groups:
        x = Features([b for b, _ in group])
        labels = np.zeros((x.steps, x.pages), np.float32)
        for p, (_, own) in enumerate(group):
            labels[: len(own), p] = own
        ready.append((x, labels))
    first, second, step = {k: np.zeros_like(v) for k, v in model.weights.items()}, {k: np.zeros_like(v) for k, v in model.weights.items()}, 0
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        for at in order.permutation(len(ready)):
            step += 1
            for k, g in model.gradients(*ready[at]).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For every page, whether each block belongs to the article."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        size = 1
        while size < GROUP and at + size < len(order) and (size + 1) * len(pages[order[at + size]]) <= CELLS:
            size += 1
        group = order[at : at + size]
        if len(pages[group[0]]) > CELLS:
            out[group[0]] = model.of_long(pages[group[0]], CELLS) >= 0.5
        else:
            found = model.probabilities(Features([pages[i] for i in group])) >= 0.5
            for p, i in enumerate(group):
                out[i] = found[: len(pages[i]), p]
        at += size
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page."""
    model = model or trained()

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, many, kept = [], [], []
        pages = rows.column("html").to_pylist()
        for at in range(0, len(pages), 4 * GROUP):
            group = [blocks(x or "") for x in pages[at : at + 4 * GROUP]]
            for own, keep in zip(group, label(model, group), strict=True):
                texts.append("\n".join(x.text for x, k in zip(own, keep, strict=True) if k))
                many.append(len(own))
                kept.append(int(keep.sum()))
        return batch(
            page_id=rows.column("page_id"), url=rows.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()),
            n_blocks=pa.array(many, pa.int64()), n_kept=pa.array(kept, pa.int64()),
        )

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
