"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block of the DOM is a position of the chain, labelled 1 (main text) or
0. Features are its ancestor tags, the words in their class and id attributes,
and properties of its text. Weights are fitted on labelled pages by maximising
the penalised conditional log-likelihood (forward-backward gradients); pages are
decoded by Viterbi.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_blocks import Block, leaf_blocks

_HINTS = frozenset("about accept account ad advertisement all comment comments consent contact cookie cookies copyright email home login menu newsletter next policy previous privacy read related reply reserved rights search share sign sponsored subscribe tags terms".split())
_SECTIONS = ("article", "aside", "footer", "form", "header", "main", "nav")


def _bucket(n: int) -> int:
    return min(n.bit_length(), 9)


def features(block: Block) -> list[str]:
    tags, text = block.tags, block.text
    words = text.split()
    own = tags[-1] if tags else "none"
    inline = next((t for t in reversed(tags) if t not in ("a", "b", "strong", "em", "i", "span", "code", "u", "small")), "none")
    section = next((t for t in reversed(tags) if t in _SECTIONS), "none")
    density = 4 * block.link_chars // max(len(text), 1)
    out = ["bias", f"own={own}", f"block={inline}", f"section={section}", f"size={_bucket(len(words))}", f"link={density}", f"size,link={_bucket(len(words))},{density}", f"section,block={section},{inline}"]
    out += {f"in={t}" for t in tags if t not in ("html", "body")}
    out += {f"name={n}" for n in block.names}
    if block.names:
        out.append(f"last={block.names[-1]}")
    out += {f"hint={w}" for w in (w.strip(".,:;!?()").lower() for w in words[:12]) if w in _HINTS}
    out.append(f"stop={text[-1] in '.!?…'}")
    if "©" in text:
        out.append("copyright")
    return out


def _normalise(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Two labels; ``weights`` is (feature, label), ``moves`` is (label, next label)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.moves = np.zeros((2, 2))

    def fit(self, pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, penalty: float = 2e-4) -> Crf:
        pages = [p for p in pages if p]
        n, longest = len(pages), max(map(len, pages))
        rows, columns = [], []
        gold, inside = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for k, page in enumerate(pages):
            for t, block in enumerate(page):
                gold[k, t], inside[k, t] = block.label or 0, True
                for f in features(block):
                    rows.append(k * longest + t)
                    columns.append(self.index.setdefault(f, len(self.index)))
        rows, columns = np.array(rows), np.array(columns)
        w, moves = np.zeros((len(self.index), 2)), np.zeros((2, 2))
        moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
        truth = np.zeros((n, longest, 2))
        np.put_along_axis(truth, gold[..., None], 1.0, axis=2)
        truth[~inside] = 0
        pair = inside[:, 1:] & inside[:, :-1]
        true_moves = np.zeros((2, 2))
        np.add.at(true_moves, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
        for step in range(1, rounds + 1):
            score = np.zeros((n * longest, 2))
            np.add.at(score, rows, w[columns])
            score = score.reshape(n, longest, 2)
            fore, back = np.zeros_like(score), np.zeros_like(score)
            fore[:, 0] = score[:, 0]
            for t in range(1, longest):
                fore[:, t] = np.where(inside[:, t, None], _normalise(fore[:, t - 1, :, None] + moves, 1) + score[:, t], fore[:, t - 1])
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(inside[:, t + 1, None], _normalise(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0.0)
            z = _normalise(fore[:, -1], 1)
            p = np.exp(fore + back - z[:, None, None]) * inside[..., None]
            joint = np.exp(fore[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - z[:, None, None, None]) * pair[..., None, None]
            gradient = np.zeros_like(w)
            np.add.at(gradient, columns, (truth - p).reshape(-1, 2)[rows])
            grads = gradient / n - penalty * w, (true_moves - joint.sum(axis=(0, 1))) / n - penalty * moves
            for k, (x, g) in enumerate(zip((w, moves), grads)):  # Adam
                moment[2 * k] = 0.9 * moment[2 * k] + 0.1 * g
                moment[2 * k + 1] = 0.99 * moment[2 * k + 1] + 0.01 * g * g
                x += rate * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = w, moves
        return self

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels."""
        if not page:
            return []
        index, w = self.index, self.weights
        scores = [w[[index[f] for f in features(b) if f in index]].sum(axis=0).tolist() for b in page]
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0]
        came = []
        for x, y in scores[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
            came.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10) + x, (a + m01 if from1 else b + m11) + y
        labels = [0 if a >= b else 1]
        for step in reversed(came):
            labels.append(step[labels[-1]])
        return labels[::-1]


def labelled_pages(n: int = 450, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts with invented words; ``data-label`` marks main text (1) and the rest (0)."""
    rng = random.Random(seed)
    syllables = "an ar be co da de el en er et fa ga he in is ka la le ma mi na no on or pa qu ra re sa se st ta te th ti to tr un us ve wa".split()

    def words(lo: int, hi: int, mark: str = "") -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + mark for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 3, hi: int = 60) -> str:
        out = words(lo, hi, rng.choice(["", "", "", "", "&amp;&amp;", "!!", "###", " |"]))
        return (out.upper() if rng.random() < 0.1 else out.capitalize()) + rng.choice([".", ".", ".", "", "?"])

    def links(k: int) -> str:
        return "".join(f"<li><a href='/{i}'>{words(1, 2)}</a></li>" for i in range(k))

    def menu() -> str:
        ul = f"<ul>{links(rng.randint(2, 8))}</ul>"
        return rng.choice([f'<nav data-label="0">{ul}</nav>', f'<div class="menu" data-label="0">{ul}</div>', f'<header data-label="0"><div class="logo">{words(1, 3)}</div><nav>{ul}</nav></header>', f'<div id="navigation" data-label="0">{ul}</div>', f'<ul class="breadcrumb" data-label="0">{links(3)}</ul>'])

    def aside() -> str:
        text = f"<p>{sentence(3, 40)}</p>" * rng.randint(1, 2)
        kind = rng.choice(["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sidebar", "widget", "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "subscribe", "related", "share", "social", "tags"])
        plain, h = sentence(2, 30), rng.choice(["h2", "h3", "h4"])
        if rng.random() < 0.1:
            kind += '" hidden="'
        return rng.choice([f'<div class="{kind}" data-label="0">{text}</div>', f'<div class="{kind}" data-label="0">{plain}</div>', f'<div id="{kind}" data-label="0">{plain}</div>', f'<aside data-label="0">{text}</aside>', f'<section class="{kind}" data-label="0"><{h}>{words(1, 4)}</{h}>{text}</section>', f'<aside class="{kind}" data-label="0"><{h}>{words(1, 3)}</{h}><ul>{links(4)}</ul></aside>'])

    def form() -> str:
        return f'<form class="{rng.choice(["search", "login", "subscribe", "contact"])}" data-label="0"><label>{words(1, 4)}</label><input name=q><p>{sentence(2, 15)}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        each = "".join(f'<{t} class="comment"><b>{words(1, 2)}</b> <p>{sentence(3, 50)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 5)))
        name = rng.choice(["comments", "comment-list", "discussion", "respond", "replies"])
        plain, h = f"<p>{sentence(1, 25)}</p>" * rng.randint(1, 3), rng.choice(["h2", "h3", "h4"])
        return rng.choice([f'<div class="{name}" data-label="0">{plain}</div>', f'<div id="{name}" data-label="0"><{h}>{words(1, 3)}</{h}>{each}</div>', f'<section {rng.choice(["class", "id"])}="{name}" data-label="0"><{h}>{words(1, 3)}</{h}>{each}</section>', f'<ol class="{name}" data-label="0">{each}</ol>'])

    def footer() -> str:
        text = f"&copy; {words(1, 3)} &middot; {sentence(1, 12)}"
        return rng.choice([f'<footer data-label="0">{text}</footer>', f'<footer data-label="0"><p>{text}</p><ul>{links(3)}</ul></footer>', f'<div class="footer" data-label="0">{text}</div>', f'<div id="footer" data-label="0"><p>{text}</p></div>'])

    def main() -> str:
        body = rng.choice(["", f"<h1>{words(1, 12)}</h1>", f"<h1>{sentence(2, 12)}</h1>", f"<header><h1>{words(2, 10)}</h1></header>"])
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            body += rng.choices(
                [f"<p>{sentence()}</p>", f"<p>{sentence(1, 6)}", f"<p><b>{sentence()}<br><p>{sentence(1, 40)}</p>", f"<h2>{words(1, 6)}</h2>", f"<ul><li>{sentence(1, 12)}</li><li>{sentence(1, 20)}</li></ul>", f"<blockquote><p>{sentence()}</p></blockquote>", f"<pre>{sentence()}</pre>", f"<p>{sentence()} <a href=x>{words(1, 3)}</a> {sentence()}</p>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<div>{sentence()}</div>", f"<p {rng.choice(['hidden', 'style=display:none'])}>{sentence()}</p>", f"<p>{words(1, 6)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {sentence()} <button>{words(1, 2)}</button></p>", aside(), form()],
                [12, 5, 5, 3, 3, 1, 1, 3, 1, 2, 0.7, 0.7, 2.5, 0.5],
            )[0]
        open_, close = rng.choice([("<article{}>", "</article>")] * 4 + [("<main{}>", "</main>"), ("<main><article{}>", "</article></main>")] + [(f'<div {a}="{name}"{{}}>', "</div>") for a, name in (("class", "content"), ("id", "content"), ("class", "post"), ("class", "entry-content"), ("class", "article-body"), ("id", "main"), ("class", "post-content"), ("class", "text"))] + [("<section{}>", "</section>"), ("<div{}>", "</div>")])
        return open_.format(' data-label="1"') + body + close

    pages = []
    for _ in range(n):
        before = [f() for f in rng.choices([menu, aside, form], [5, 3, 1], k=rng.randint(0, 4))]
        after = [f() for f in rng.choices([aside, comments, form, menu], [3, 3, 1, 1], k=rng.randint(0, 3))]
        page = "<html><head><title>x</title></head><body>" + "".join([*before, main(), *after, footer() if rng.random() < 0.9 else ""])
        pages.append(page + rng.choice(["</body></html>", ""]))
    return pages


@lru_cache(maxsize=2)
def train_crf(n_pages: int = 450, seed: int = 11) -> Crf:
    """The model of ``labelled_pages``, fitted once a process."""
    return Crf().fit([leaf_blocks(p) for p in labelled_pages(n_pages, seed)])


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, label in zip(blocks, crf.decode(blocks)) if label)


def extract_pages(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html, and pages without main text, give an empty text. Repeated
    rows give repeated rows, an empty table none; other columns are not read.
    Whole pages are read, however long. Every row stands alone: nothing is shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or train_crf())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part = whole.slice(lo, 500)
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
