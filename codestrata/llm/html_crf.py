"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

A block's features are the tags and attribute words around it and properties of its text; neighbouring blocks are tied
by transition weights. It is trained by maximum likelihood on labelled pages: those that html_pages lays out, or any
others with the article's text between the characters 1 and 2.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codestrata.llm import common, html_pages
from codestrata.llm.html_blocks import Block, blocks

#: Training pages, passes and ridge.
PAGES, PASSES, RIDGE = 900, 150, 1e-4
WEIGHTY = set("article main nav header footer aside form button label select option p li ul ol table td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption section div head title textarea dl dt dd fieldset legend dialog address details summary body a".split())


def block_features(block: Block) -> list[str]:
    text, out = block.text, [f"in {w}" for w in block.around if w[0] == "." or w in WEIGHTY]
    n = len(text)
    density = block.in_links / max(n, 1)
    out += ["bias", f"tag {block.tag}", f"size {min(n.bit_length(), 12)}", f"links {int(density * 4)}", f"end {text[-1] if text[-1] in '.!?:' else '-'}"]
    if "©" in text or "copyright" in text[:200].lower():
        out.append("copyright")
    if text.count(" ") >= 20:
        out.append("many words")
    return out


@dataclass(frozen=True)
class Model:
    """weights: (features, 2) for other and article; transition[a, b] from a to b; begin for a page's first block."""

    index: dict
    weights: np.ndarray
    transition: np.ndarray
    begin: np.ndarray

    def unary(self, page: list[Block]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[k for k in map(get, block_features(b)) if k is not None]].sum(axis=0) for b in page]).reshape(-1, 2)

    def decode(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Labels of each page's blocks, 1 for the article; all pages at once, longer ones first."""
        sizes = np.array([len(p) for p in pages], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = self.unary([b for i in order for b in pages[i]])
        size = sizes[order]
        first = np.cumsum(size) - size
        most = int(size.max(initial=0))
        active = [int(np.searchsorted(-size, -t, "left")) for t in range(most)]
        back = np.zeros((len(flat), 2), np.int8)
        value = np.zeros((len(pages), 2))
        for t in range(most):
            k = active[t]
            at = first[:k] + t
            if t == 0:
                value[:k] = flat[at] + self.begin
                continue
            options = value[:k, :, None] + self.transition
            back[at] = options.argmax(axis=1)
            value[:k] = options.max(axis=1) + flat[at]
        labels = np.zeros(len(flat), np.int8)
        state = value.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            last = size[:k] == t + 1
            state[:k] = np.where(last, value[:k].argmax(axis=1), state[:k])
            labels[at] = state[:k]
            state[:k] = back[at, state[:k]]
        out: list = [None] * len(pages)
        for i, f, n in zip(order.tolist(), first.tolist(), size.tolist(), strict=True):
            out[i] = labels[f : f + n]
        return out


def marked(source: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a labelled page without its marks, and their labels."""
    page = blocks(source)
    labels = np.array([int("\x01" in b.text or "\x02" in b.text) for b in page], np.int64)
    clean = []
    for b in page:
        text = " ".join(b.text.replace("\x01", "").replace("\x02", "").split())
        clean.append(Block(text or "-", b.around, b.tag, b.depth, b.in_links))
    return clean, labels


def train(sources: list[str], passes: int = PASSES) -> Model:
    """Maximum likelihood by Adam; gradients by forward-backward over all pages at once."""
    pages = [p for p in map(marked, sources) if p[0]]
    names = sorted({f for p, _ in pages for b in p for f in block_features(b)})
    index = {f: k for k, f in enumerate(names)}
    n, most = len(pages), max((len(p) for p, _ in pages), default=0)
    rows, columns, truth, mask = [], [], np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (page, labels) in enumerate(pages):
        truth[i, : len(page)], mask[i, : len(page)] = labels, True
        for t, block in enumerate(page):
            own = [index[f] for f in block_features(block)]
            rows += [i * most + t] * len(own)
            columns += own
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    shapes = [(len(names), 2), (2, 2), (2,)]
    theta = [np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    lengths = mask.sum(axis=1)
    for step in range(1, passes + 1):
        weights, transition, begin = theta
        unary = np.stack([np.bincount(rows, weights[columns, y], n * most) for y in (0, 1)], axis=1).reshape(n, most, 2)
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = unary[:, 0] + begin
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(alpha[:, t - 1, 0, None] + transition[0], alpha[:, t - 1, 1, None] + transition[1]) + unary[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = unary[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(transition[:, 0] + ahead[:, None, 0], transition[:, 1] + ahead[:, None, 1]), 0)
        total = np.logaddexp(alpha[np.arange(n), lengths - 1, 0], alpha[np.arange(n), lengths - 1, 1])
        node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        gap = node - np.eye(2)[truth] * mask[:, :, None]
        gradient = [np.stack([np.bincount(columns, gap.reshape(-1, 2)[rows, y], len(names)) for y in (0, 1)], axis=1), np.zeros((2, 2)), gap[:, 0].sum(axis=0)]
        pair = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(alpha[:, :-1, a] + transition[a, b] + unary[:, 1:, b] + beta[:, 1:, b] - total[:, None])
                gradient[1][a, b] = (p * pair).sum() - ((truth[:, :-1] == a) & (truth[:, 1:] == b) & pair).sum()
        for k in range(3):
            g = gradient[k] / n + RIDGE * theta[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] - 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(index, *theta)


@functools.cache
def default_model() -> Model:
    return train(html_pages.labelled(PAGES, seed=11))


@common.tidy
def _extracted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "html", 2_000_000):
            pages = [blocks(h) for h in common.texts(part.column("html"))]
            labels = model.value.decode(pages)
            texts = ["\n\n".join(b.text for b, y in zip(p, own.tolist(), strict=True) if y) for p, own in zip(pages, labels, strict=True)]
            yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the article's blocks, parted by an empty line; white space inside a block is one space.

    Null and empty pages, and pages without an article, have an empty text. Repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())  # as large as the training pages' features
    rows = common.pick(df, id=id_col, url=url_col, html=html_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_extracted, model=shared), f"id {kind}, url string, text string, n_chars long")
