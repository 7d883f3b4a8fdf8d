"""Main text of web pages: a bidirectional LSTM labels every block from the whole page's blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborline.llm.html_blocks import PATH_SLOTS, Paths, blocks

WORD_SLOTS = 2_048
PATH_WIDTH, WORD_WIDTH, HIDDEN_WIDTH = 24, 12, 32
FIGURES = 6
#: Pages that the labeller is fitted on, and how much of each is read for that.
TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 256, 65_536, 64
EPOCHS = 10
#: Blocks that go through the network at once; a longer page goes alone.
BATCH_BLOCKS = 8_192

# -- fixed values: how pages name their parts, by what stands there ---------------------

MAIN_NAMES = "content main article post entry story body text page blog news single hentry prose"
ROLES = {
    "menu": ("nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs pagination toc skip", "home about contact menu start"),
    "header": ("header div", "header masthead banner top brand logo", "welcome home"),
    "footer": ("footer div", "footer bottom copyright colophon legal credits sitemap", "© copyright all rights reserved impressum privacy"),
    "sidebar": ("aside div section", "sidebar side widget related aside recommended popular trending more tags share social", "related more popular read also"),
    "advert": ("div aside section", "ad ads advert advertisement sponsor sponsored promo promotion banner adsense", "advertisement sponsored anzeige publicité"),
    "notice": ("div section aside", "cookie cookies consent notice gdpr banner alert popup modal overlay privacy message", "cookies accept consent wir verwenden"),
    "form": ("form div fieldset", "form search login newsletter subscribe signup contact register", "subscribe email search password submit"),
    "comments": ("section div ol", "comments comment commentlist replies reply respond discussion thread disqus responses", "reply says comment wrote"),
}
LANDMARKS = re.compile(r"<(/?)(article|main|nav|footer|header|aside|section)\b", re.I)
#: Marks of a training block: main text or not.
YES, NO = "", ""


# -- features -------------------------------------------------------------------------

class Pages:
    """Blocks of several pages as arrays: path slots and word slots with their block, figures, lengths."""

    def __init__(self, pages: list[list[tuple[str, int, float]]], paths: Paths) -> None:
        flat = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        tokens = [(*paths.tokens[node], paths.leaf[node]) for _, node, _ in flat]
        self.token_counts = np.array([len(t) for t in tokens], np.int64)
        self.tokens = np.fromiter((x for t in tokens for x in t), np.int64, int(self.token_counts.sum()))
        words = [text.lower().encode("utf-8", "surrogatepass").split() for text, _, _ in flat]
        sizes = np.array([len(w) for w in words], np.int64)
        # Each word once, or a word said a hundred times would drown all else.
        words = [dict.fromkeys(w) for w in words]
        self.word_counts = np.array([len(w) for w in words], np.int64)
        self.words = np.fromiter((crc32(w) for ws in words for w in ws), np.int64, int(self.word_counts.sum())) % WORD_SLOTS
        place = np.concatenate([np.arange(n) for n in self.lengths] or [np.empty(0)])
        whole = np.repeat(self.lengths, self.lengths)
        stops = np.array([text[-1] in ".!?:;。" for text, _, _ in flat], float)
        self.figures = np.stack(
            [
                np.log1p(sizes) / 4,
                np.array([share for _, _, share in flat]),
                stops,
                place / np.maximum(whole, 1),
                np.log1p(whole) / 4,
                (sizes > 12).astype(float),
            ],
            axis=1,
        ).astype(np.float32) if flat else np.empty((0, FIGURES), np.float32)


def _gathered(table: np.ndarray, slots: np.ndarray, counts: np.ndarray, power: float) -> np.ndarray:
    """Sums of table rows per block over a power of their number."""
    out = np.zeros((len(counts), table.shape[1]), table.dtype)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(table[slots], starts, axis=0) / (counts[full] ** power)[:, None].astype(table.dtype)
    return out


def _scattered(shape: tuple[int, int], slots: np.ndarray, counts: np.ndarray, power: float, part: np.ndarray) -> np.ndarray:
    """Gradient of ``_gathered`` in the table."""
    out = np.zeros(shape, np.float32)
    if len(slots):
        rows = np.repeat(part / (np.maximum(counts, 1) ** power)[:, None], counts, axis=0)
        order = np.argsort(slots, kind="stable")
        ordered = slots[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        out[ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


# -- network --------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Embeddings of path and word slots, one LSTM a direction, one logit a block; all in numpy."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        width, h = PATH_WIDTH + WORD_WIDTH + FIGURES, HIDDEN_WIDTH
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "path": draw(PATH_SLOTS, PATH_WIDTH, scale=0.3),
            "word": draw(WORD_SLOTS, WORD_WIDTH, scale=0.1),
            "wx": draw(2, width, 4 * h, scale=width**-0.5),
            "wh": draw(2, h, 4 * h, scale=h**-0.5),
            "b": np.zeros((2, 1, 4 * h), np.float32),
            "wo": draw(2 * h, scale=h**-0.5),
            "bo": np.zeros(1, np.float32),
        }
        self.p["b"][:, :, h : 2 * h] = 1  # remember by default

    @staticmethod
    def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(step, page) of each block read forwards, the step read backwards, and the steps in all."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return step, np.repeat(lengths, lengths) - 1 - step, page

    def forward(self, pages: Pages, heard: np.ndarray | float = 1.0) -> tuple[np.ndarray, dict]:
        """Logits of all blocks, and what going back needs; ``heard`` scales the words of each block."""
        p, h = self.p, HIDDEN_WIDTH
        x = np.concatenate(
            [_gathered(p["path"], pages.tokens, pages.token_counts, 0.5), _gathered(p["word"], pages.words, pages.word_counts, 1.0) * heard, pages.figures],
            axis=1,
        )
        ahead, behind, page = self._grid(pages.lengths)
        steps, n = int(pages.lengths.max(initial=0)), len(pages.lengths)
        fed = np.zeros((steps, 2, n, 4 * h), np.float32)
        for way, step in enumerate((ahead, behind)):
            fed[step, way, page] = x @ p["wx"][way] + p["b"][way]
        gates = np.empty((steps, 2, n, 4 * h), np.float32)
        cells = np.zeros((steps + 1, 2, n, h), np.float32)
        states = np.zeros((steps + 1, 2, n, h), np.float32)
        # Pages are read from their first block on, both ways, so padding only comes after the end.
        for t in range(steps):
            z = fed[t] + states[t] @ p["wh"]
            z[..., : 2 * h] = _sigmoid(z[..., : 2 * h])
            z[..., 2 * h : 3 * h] = np.tanh(z[..., 2 * h : 3 * h])
            z[..., 3 * h :] = _sigmoid(z[..., 3 * h :])
            gates[t] = z
            cells[t + 1] = z[..., h : 2 * h] * cells[t] + z[..., :h] * z[..., 2 * h : 3 * h]
            states[t + 1] = z[..., 3 * h :] * np.tanh(cells[t + 1])
        seen = np.concatenate([states[ahead + 1, 0, page], states[behind + 1, 1, page]], axis=1)
        return seen @ p["wo"] + p["bo"], {"x": x, "gates": gates, "cells": cells, "states": states, "seen": seen, "heard": heard, "grid": (ahead, behind, page)}

    def backward(self, pages: Pages, kept: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from the slope of the loss in each logit."""
        p, h = self.p, HIDDEN_WIDTH
        ahead, behind, page = kept["grid"]
        gates, cells, states = kept["gates"], kept["cells"], kept["states"]
        grad = {"wo": kept["seen"].T @ slope, "bo": np.array([slope.sum()], np.float32), "wh": np.zeros_like(p["wh"])}
        into = slope[:, None] * p["wo"]
        d_out = np.zeros_like(states[1:])
        d_out[ahead, 0, page], d_out[behind, 1, page] = into[:, :h], into[:, h:]
        d_z = np.empty_like(gates)
        d_state = np.zeros_like(states[0])
        d_cell = np.zeros_like(cells[0])
        back = p["wh"].transpose(0, 2, 1)
        for t in reversed(range(len(gates))):
            i, f, g, o = (gates[t][..., k * h : (k + 1) * h] for k in range(4))
            d_state = d_state + d_out[t]
            squashed = np.tanh(cells[t + 1])
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            d_z[t] = np.concatenate(
                [d_cell * g * i * (1 - i), d_cell * cells[t] * f * (1 - f), d_cell * i * (1 - g**2), d_state * squashed * o * (1 - o)], axis=-1
            )
            grad["wh"] += states[t].transpose(0, 2, 1) @ d_z[t]
            d_state = d_z[t] @ back
            d_cell = d_cell * f
        each = [d_z[ahead, 0, page], d_z[behind, 1, page]]
        grad["b"] = np.stack([e.sum(axis=0, keepdims=True) for e in each])
        grad["wx"] = np.stack([kept["x"].T @ e for e in each])
        d_x = sum(e @ p["wx"][way].T for way, e in enumerate(each))
        words = d_x[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] * kept["heard"]
        grad["path"] = _scattered(p["path"].shape, pages.tokens, pages.token_counts, 0.5, d_x[:, :PATH_WIDTH])
        grad["word"] = _scattered(p["word"].shape, pages.words, pages.word_counts, 1.0, words)
        return grad

    def scores(self, pages: list[list[tuple[str, int, float]]], paths: Paths) -> list[np.ndarray]:
        """Probability of main text of every block of every page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            # Pages of like length go together, so padding stays small.
            longest = len(pages[order[-1]])
            now, order = order[-max(1, BATCH_BLOCKS // longest) :], order[: -max(1, BATCH_BLOCKS // longest)]
            made = Pages([pages[i] for i in now], paths)
            cuts = np.cumsum(made.lengths)[:-1]
            for i, part in zip(now, np.split(_sigmoid(self.forward(made)[0]), cuts), strict=True):
                out[i] = part
        return out


# -- training pages -------------------------------------------------------------------

def own_labels(html: str, paths: Paths) -> list[tuple[str, int, float, bool]] | None:
    """Blocks of a page that names its main part by one article (or main) element; None for others."""
    for tag in ("article", "main"):
        opened = re.findall(rf"<{tag}\b", html, re.I)
        if len(opened) == 1:
            inside = re.compile(rf"<{tag}\b.*?(?:</{tag}\s*>|$)", re.I | re.S)
            # The same page with every text of that element marked.
            marked = inside.sub(lambda m: re.sub(r">([^<]*[^<\s][^<]*)", rf">{YES}\1", m[0]), html)
            found = [(t.replace(YES, ""), n, s, YES in t) for t, n, s in blocks(marked, paths)]
            return [f for f in found if f[0]][:TRAIN_BLOCKS]
    return None


def _layout(rnd: random.Random, texts: list[str]) -> str:
    """A made-up page of given texts: main text in one of many shapes, other parts around and within it."""

    def words(least: int, most: int) -> list[str]:
        some = (rnd.choice(texts).split() or ["a"])[: rnd.randint(least, most)]
        return some if rnd.random() < 0.97 else some[:1] * rnd.randint(least, 4 * most)

    def named(names: str, chance: float = 0.9) -> str:
        if rnd.random() > chance:
            return ""
        name = "-".join(rnd.sample(names.split(), rnd.choice([1, 1, 1, 2])))
        return f' {rnd.choice(["class", "class", "id"])}="{name}"'

    def leaf(mark: str, tag: str, text: str) -> str:
        return f"<{tag}>{mark}{text}</{tag}>"

    def part(role: str) -> str:
        tags, names, typical = ROLES[role]
        tag = rnd.choice(tags.split())
        plain = tag in ("nav", "header", "footer", "aside", "form") and rnd.random() < 0.4
        own = [rnd.choice(typical.split()) for _ in range(rnd.randint(0, 3))]
        some = lambda a, b: " ".join(own + words(a, b))
        shape = "links" if role in ("menu", "sidebar") and rnd.random() < 0.8 else rnd.choice(["text", "text", "paragraphs", "links"])
        if role == "form":
            inner = f"<label>{NO}{some(1, 3)}</label><input type=text><button>{NO}{some(1, 2)}</button>" + (leaf(NO, "p", some(1, 12)) if rnd.random() < 0.4 else "")
        elif role == "comments":
            one = lambda: f'<{rnd.choice(["div", "li"])}{named("comment reply", 0.7)}>' + leaf(NO, rnd.choice(["b", "h4", "div"]), some(1, 3)) + leaf(NO, "p", some(2, 60)) + "</div>"
            inner = leaf(NO, "h3", some(1, 3)) + "".join(one() for _ in range(rnd.randint(1, 5)))
        elif shape == "links":
            inner = "<ul>" + "".join(f'<li><a href="/x">{NO}{" ".join(words(1, 5))}</a></li>' for _ in range(rnd.randint(2, 8))) + "</ul>"
        elif shape == "paragraphs":
            inner = "".join(leaf(NO, rnd.choice(["p", "p", "div", "h3"]), some(1, 40)) for _ in range(rnd.randint(1, 3)))
        else:
            inner = NO + some(1, 30)
        return f"<{tag}{'' if plain else named(names, 1.0)}>{inner}</{tag}>"

    def body() -> str:
        out = [leaf(YES, "h1", " ".join(words(1, 14)))] if rnd.random() < 0.85 else []
        if out and rnd.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = rnd.random()
            if kind < 0.78:
                out.append(leaf(YES, "p", ("<b>" if rnd.random() < 0.2 else "") + " ".join(words(1, 120))))
            elif kind < 0.86:
                out.append(leaf(YES, rnd.choice(["h2", "h3", "blockquote", "pre", "div"]), " ".join(words(1, 20))))
            elif kind < 0.93:
                out.append("<ul>" + "".join(leaf(YES, "li", " ".join(words(1, 25))) for _ in range(rnd.randint(1, 5))) + "</ul>")
            else:
                out.append(part(rnd.choice(["advert", "sidebar", "form", "notice"])))
        if rnd.random() < 0.15:
            out.append(part("comments"))
        return "".join(out)

    tag = rnd.choice(["article", "article", "main", "div", "div", "section", "td", ""])
    main = body()
    if tag:
        main = f"<{tag}{named(MAIN_NAMES, 0.5 if tag in ('article', 'main') else 0.85)}>{main}</{tag}>"
    if rnd.random() < 0.3:
        main = f"<{rnd.choice(['main', 'div'])}{named(MAIN_NAMES + ' container wrapper', 0.7)}>{main}</div>"
    before = [part(r) for r in ("notice", "header", "menu", "advert", "form", "sidebar") if rnd.random() < 0.35]
    after = [part(r) for r in ("comments", "sidebar", "advert", "menu", "form", "notice", "footer") if rnd.random() < 0.35]
    rnd.shuffle(before)
    return f"<html><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def training_pages(html: list[str], paths: Paths, seed: int = 0) -> list[list[tuple[str, int, float, bool]]]:
    """Labelled block sequences: pages that label themselves, once as they are and once with plain
    ``div`` for telling elements, and made-up layouts of the pages' texts."""
    rnd = random.Random(seed)
    out, texts = [], []
    for page in html:
        texts += [t for t, _, _ in blocks(page, paths)[:TRAIN_BLOCKS]]
        own = own_labels(page, paths)
        if own:
            out.append(own)
            plain = blocks(LANDMARKS.sub(r"<\1div", page), paths)[:TRAIN_BLOCKS]
            if [t for t, _, _ in plain] == [t for t, *_ in own]:
                out.append([(*b, label) for b, (*_, label) in zip(plain, own, strict=True)])
    for _ in range(2 * max(TRAIN_PAGES, len(html))):
        found = blocks(_layout(rnd, texts or ["text"]), paths)
        out.append([(t[1:] or "-", n, s, t[0] == YES) for t, n, s in ((t.replace(NO, "", t.count(NO) - 1) if NO in t else t, n, s) for t, n, s in found)][:TRAIN_BLOCKS])
    return [p for p in out if p]


def train(html: list[str], epochs: int = EPOCHS, seed: int = 0) -> Labeller:
    """Adam on the cross entropy of all blocks, pages of like length together, rate falling to zero."""
    paths = Paths()
    pages = training_pages(html, paths, seed)
    rng = np.random.default_rng(seed)
    net = Labeller(seed)
    one = {k: np.zeros_like(v) for k, v in net.p.items()}
    two = {k: np.zeros_like(v) for k, v in net.p.items()}
    pages.sort(key=len)
    batches = [pages[i : i + 32] for i in range(0, len(pages), 32)]
    made = [(Pages([[b[:3] for b in p] for p in group], paths), np.array([b[3] for p in group for b in p], np.float32)) for group in batches]
    step, last = 0, epochs * len(made)
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            group, truth = made[i]
            # Half of the blocks go without their words, so that none is judged by them alone.
            logits, kept = net.forward(group, rng.integers(0, 2, (len(truth), 1)).astype(np.float32) * 2)
            grad = net.backward(group, kept, ((_sigmoid(logits) - truth) / len(truth)).astype(np.float32))
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            rate = 0.01 * (1 - step / (last + 1))
            for k, g in grad.items():
                g = g / max(1.0, size)
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g**2
                net.p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(pages: DataFrame, html: str = "html") -> Labeller | None:
    """A labeller from at most ``TRAIN_PAGES`` different pages, those of the smallest hashes; None without pages."""
    hashed = pages.where(F.length(html) > 0).select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]
    if not least:
        return None
    start = F.substring("html", 1, TRAIN_CHARS)
    drawn = hashed.where(F.col("h") <= least[-1]).select("h", start.alias("html")).groupBy("h").agg(F.min("html").alias("html"))
    return train([r["html"] for r in drawn.orderBy("h").collect()])


# -- operator -------------------------------------------------------------------------

def main_text(pages: DataFrame, labeller: Labeller | None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: key, url, text, n_chars.

    Blocks that the labeller holds for main text, in page order, joined by one space.
    Null and empty pages, and pages without such a block, have the empty text. Null keys
    and repeated rows keep their rows; an empty table gives none; further columns are not
    looked at. A page is read whole by one task.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    schema = f"key {dict(rows.dtypes)['key']}, url string, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(paths.tokens) > Paths.MOST:
                    paths.clear()
                found = [blocks(v or "", paths) for v in part.column(2).to_pylist()]
                scores = labeller.scores(found, paths) if labeller else [()] * len(found)
                texts = [" ".join(b[0] for b, s in zip(p, of, strict=True) if s > 0.5) for p, of in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("bigint").alias("n_chars"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``main_text`` by a labeller that is fitted on the pages themselves."""
    return main_text(pages, fit(pages, html), key, url, html)
