"""Main text of HTML pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags. Each block is a vector of
summed embeddings of its tag path (tags, class and id words) and of its hashed words, and a few ratios. A
bidirectional LSTM in numpy reads the whole sequence and labels every block, so a block is judged in the
context of its page. The model is trained on the driver on pages generated here from many layouts.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul button noscript object svg math textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN_TAGS = frozenset(("svg", "math"))
#: What these hold is not markup and ends at their own end tag only; of the last two it is text.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in "script style iframe noembed noframes xmp title textarea".split()}
RAW_TEXT = frozenset(("title", "textarea"))
CONTROLS = frozenset(("button", "select", "option", "optgroup"))
#: A control that was not closed ends where one of these begins.
FLOW_TAGS = frozenset("address article aside blockquote dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements nested deeper belong to the element at this depth, as browsers have it; their text stays.
DEEPEST = 512
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
WORD = re.compile(r"[^\W\d_]+")
PATHS, WORDS, RATIOS, HIDDEN_UNITS = 2048, 8192, 7, 20
EMBED = 16


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Leaf blocks in page order: tag path, text with single spaces, share of it inside links."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, in_link, at = 0, False, 0
    path: tuple[str, ...] | None = ()  # none: not made yet for the present stack

    def close() -> None:
        nonlocal linked, path
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                if path is None:
                    path = tuple(x for _, names in stack for x in names)
                out.append((path, joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def pop(tag: str, stop: frozenset[str] = frozenset()) -> None:
        nonlocal path
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                path = None
                break
            if stack[i][0] in stop:
                break

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            s = m.group()
            if not (s.startswith(("<!", "<?")) and len(s) > 1):
                text.append(s)
                if in_link:
                    linked += len(s)
            continue
        tag, ending = name.lower(), bool(m.group(1) or m.group(4))
        raw = ""
        if tag in RAW_END and not ending:
            end = RAW_END[tag].search(page, at)
            begin, at = at, end.start() if end else len(page)
            if tag not in RAW_TEXT:
                continue
            raw = page[begin:at]
        if tag == "a":
            in_link = not ending
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        close()
        if ending:
            pop(tag)
            continue
        attrs = m.group(3) or m.group(6) or ""
        if tag in FLOW_TAGS:
            while stack and stack[-1][0] in CONTROLS:
                pop(stack[-1][0])
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag[0] == "h" and tag[1:].isdigit():
            pop(tag, frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "aside", "nav", "body")))
            if tag not in ("p", "option"):
                pop("p", frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "aside", "nav", "body")))
        if tag not in VOID_TAGS and len(stack) < DEEPEST and not (tag in FOREIGN_TAGS and attrs.endswith("/")):
            names = [tag]
            for q in NAMES.findall(attrs) if "=" in attrs else ():
                names += ["." + w for w in re.split(r"[^a-z0-9]+", "".join(q).lower()) if w]
            if HIDDEN.search(attrs):
                names.append(".hidden")
            stack.append((tag, tuple(names)))
            path = None
        if raw:
            text.append(raw)
            close()
    close()
    return out


@lru_cache(1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@lru_cache(1 << 14)
def _path_slots(path: tuple[str, ...]) -> tuple[int, ...]:
    """Slots of a path's names, of its neighbouring tags and of its last tag with and without names."""
    tags = [x for x in path if x[0] != "."]
    named = bool(path) and path[-1][0] == "."
    keys = {*path, *(f"{a}>{b}" for a, b in zip(tags, tags[1:])), f"leaf {tags[-1] if tags else ''} {named}"}
    return tuple(sorted({_slot(x, PATHS) for x in keys}))


def vectors(page_blocks: list[tuple[tuple[str, ...], str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the blocks of a page: path slots and their block, word slots and their block, ratios."""
    ps, pi, ws, wi = [], [], [], []
    ratios = np.zeros((len(page_blocks), RATIOS), np.float32)
    for i, (path, text, link) in enumerate(page_blocks):
        here = _path_slots(path)
        ps.extend(here)
        pi += [i] * len(here)
        words = {_slot(w.lower(), WORDS) for w in WORD.findall(text)}
        ws += words
        wi += [i] * len(words)
        n = len(text)
        ratios[i] = (np.log1p(n) / 8, link, sum(text.count(c) for c in ".,;:") / n * 10, i / len(page_blocks), min(1, len(page_blocks) / 50), text[-1] in ".!?", n > 150)
    return np.array(ps, np.int64), np.array(pi, np.int64), np.array(ws, np.int64), np.array(wi, np.int64), ratios


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM in each direction and a logistic output for every block."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = 2 * EMBED + RATIOS, HIDDEN_UNITS
        self.p = {"path": r.normal(0, 0.3, (PATHS, EMBED)), "word": r.normal(0, 0.1, (WORDS, EMBED)), "out": r.normal(0, 0.2, (2 * h + d,)), "b": np.zeros(1)}
        for s in "fb":
            self.p[f"w{s}"] = r.normal(0, 0.2, (d + h, 4 * h))
            self.p[f"c{s}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, v: tuple) -> np.ndarray:
        ps, pi, ws, wi, ratios = v
        x = np.zeros((len(ratios), 2 * EMBED + RATIOS), np.float32)
        np.add.at(x[:, :EMBED], pi, self.p["path"][ps])
        np.add.at(x[:, EMBED : 2 * EMBED], wi, self.p["word"][ws])
        x[:, EMBED : 2 * EMBED] /= np.sqrt(np.bincount(wi, minlength=len(ratios)).clip(1))[:, None]
        x[:, 2 * EMBED :] = ratios
        return x

    def _run(self, x: np.ndarray, mask: np.ndarray, s: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (T, B, d), already in reading order of direction s."""
        h = np.zeros((x.shape[1], HIDDEN_UNITS), np.float32)
        c, out, tape = np.zeros_like(h), np.zeros((len(x), x.shape[1], HIDDEN_UNITS), np.float32), []
        w, bias, n = self.p[f"w{s}"], self.p[f"c{s}"], HIDDEN_UNITS
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            a = z @ w + bias
            i, f, o, g = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), _sigmoid(a[:, 2 * n : 3 * n]), np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            before = c
            c = np.where(m, f * c + i * g, c)
            u = np.tanh(c)
            h = np.where(m, o * u, h)
            out[t] = h
            if keep:
                tape.append((z, i, f, o, g, before, u, m))
        return out, tape

    def forward(self, xs: list[np.ndarray], keep: bool = False):
        length = max(map(len, xs))
        x = np.zeros((length, len(xs), xs[0].shape[1]), np.float32)
        mask = np.zeros((length, len(xs)), bool)
        for k, v in enumerate(xs):
            x[: len(v), k], mask[: len(v), k] = v, True
        hf, tf = self._run(x, mask, "f", keep)
        hb, tb = self._run(x[::-1], mask[::-1], "b", keep)
        z = np.concatenate([hf, hb[::-1], x], axis=2)
        return z @ self.p["out"] + self.p["b"], (x, mask, z, tf, tb)

    def _back(self, tape: list, dh_out: np.ndarray, s: str, grad: dict) -> np.ndarray:
        n, w = HIDDEN_UNITS, self.p[f"w{s}"]
        dx = np.zeros((len(tape), dh_out.shape[1], w.shape[0] - n), np.float32)
        dh, dc = np.zeros(dh_out.shape[1:], np.float32), np.zeros(dh_out.shape[1:], np.float32)
        for t in range(len(tape) - 1, -1, -1):
            z, i, f, o, g, before, u, m = tape[t]
            dh = dh + dh_out[t]
            on = np.where(m, dh, 0)
            d = dc * m + on * o * (1 - u * u)
            da = np.concatenate([d * g * i * (1 - i), d * before * f * (1 - f), on * u * o * (1 - o), d * i * (1 - g * g)], axis=1)
            grad[f"w{s}"] += z.T @ da
            grad[f"c{s}"] += da.sum(axis=0)
            dz = da @ w.T
            dx[t] = dz[:, :-n]
            dc = np.where(m, d * f, dc)
            dh = np.where(m, dz[:, -n:], dh)
        return dx

    def train(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 0.01) -> None:
        r = np.random.default_rng(1)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, full = 0, rate
        for epoch in range(epochs):
            rate = full * (1 - 0.9 * epoch / epochs)
            order = r.permutation(len(pages))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                logit, (x, mask, z, tf, tb) = self.forward([self.embed(pages[k]) for k in own], keep=True)
                y = np.zeros_like(logit)
                for j, k in enumerate(own):
                    y[: len(labels[k]), j] = labels[k]
                d = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["out"] += np.einsum("tb,tbk->k", d, z)
                grad["b"] += d.sum()
                dz = d[:, :, None] * self.p["out"]
                n = HIDDEN_UNITS
                dx = dz[:, :, 2 * n :] + self._back(tf, dz[:, :, :n], "f", grad) + self._back(tb, dz[::-1, :, n : 2 * n], "b", grad)[::-1]
                for j, k in enumerate(own):
                    ps, pi, ws, wi, ratios = pages[k]
                    np.add.at(grad["path"], ps, dx[pi, j, :EMBED])
                    np.add.at(grad["word"], ws, dx[wi, j, EMBED : 2 * EMBED] / np.sqrt(np.bincount(wi, minlength=len(ratios)).clip(1))[wi][:, None])
                step += 1
                for k, g in grad.items():
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.01 * (g * g - m2[k])
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][4])), key=lambda k: len(pages[k][4]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(pages[order[at + n]][4]) <= 20_000 and n < 256:
                n += 1
            own = order[at : at + n]
            logit, _ = self.forward([self.embed(pages[k]) for k in own])
            for j, k in enumerate(own):
                out[k] = logit[: len(pages[k][4]), j] > 0
            at += n
        return out


# Words by which page templates name their parts, and words common in them.
MAIN_NAMES = "article content post entry story main body text news-article post-content entry-content article-body story-text page-content maincontent".split()
PART_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu pagination tabs toc".split(),
    "header": "header masthead top site-header banner-top page-header logo branding".split(),
    "footer": "footer site-footer bottom page-footer copyright colophon legal".split(),
    "aside": "sidebar aside widget related recommended side rail right-column trending popular newsletter".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adbox ad-slot".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal overlay paywall notification disclaimer".split(),
    "comments": "comments comment reply responses discussion comment-list disqus reader-comments respond".split(),
    "form": "search login subscribe signup newsletter-form contact-form search-form".split(),
    "share": "share social share-buttons social-links follow tags meta byline".split(),
}
PART_WORDS = "home about contact login search subscribe cookie cookies accept privacy policy terms copyright reserved rights share tweet reply comment comments posted advertisement sponsored menu next previous read more related newsletter sign email follow".split()
PART_TAGS = {"nav": "nav ul div section", "header": "header div", "footer": "footer div section", "aside": "aside div section", "ad": "div aside section", "notice": "div section dialog aside", "comments": "section div ol ul article", "form": "form div", "share": "div ul p"}


def made_page(r: np.random.Generator) -> tuple[str, list[tuple[str, bool]]]:
    """A page of a random layout with invented words, and (block text, is main text) in page order."""
    syllables = "an er on the in re ti ou le de que ción sch ung ent al ar is es ra mo ka lu pe vo".split()
    want: list[tuple[str, bool]] = []

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.integers(1, 4)))

    def sentence(low: int, high: int, junk: bool = False) -> str:
        n = r.integers(low, high)
        ws = [str(r.choice(PART_WORDS)) if r.random() < (0.4 if junk else 0.04) else word() for _ in range(n)]
        style = r.random()
        if style < 0.08:
            return " ".join(w.upper() + "!!" for w in ws)
        if style < 0.16:
            return " ".join(w + str(r.choice(["###", "$$$", "%%%", "***"])) for w in ws)
        if style < 0.2:
            return " | ".join(ws)
        return " ".join(ws).capitalize() + ("." if r.random() < 0.7 or not junk else "")

    def say(text: str, main: bool) -> str:
        want.append((" ".join(text.split()), main))
        return text

    def named(kind: str, tag: str) -> str:
        if (tag == kind or tag in ("nav", "header", "footer", "aside", "form")) and r.random() < 0.6:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "id", "class"])}="{r.choice(PART_NAMES[kind])}">'

    def part(kind: str) -> str:
        tag = str(r.choice(PART_TAGS[kind].split()))
        start, end = named(kind, tag), f"</{tag}>"
        n = int(r.integers(1, 7))
        if tag in ("ul", "ol") or kind == "nav" or kind in ("aside", "comments") and r.random() < 0.4:
            inner = "".join("<li>" + (f'<a href="/{word()}">{say(sentence(1, 4, True), False)}</a>' if kind != "comments" else say(sentence(3, 25), False)) + "</li>" for _ in range(n))
            return start + (inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>") + end
        if tag == "p" or r.random() < 0.4:
            return start + say(sentence(1, 20, kind != "ad"), False) + end
        wrap = str(r.choice(["p", "div", "h3", "p", "p"]))
        return start + "".join(f"<{wrap}>{say(sentence(1, 40 if kind == 'comments' else 18, r.random() < 0.5), False)}</{wrap}>" for _ in range(min(n, 4))) + end

    def control() -> str:
        kind, text = r.random(), sentence(1, 6, True)
        if kind < 0.35:
            return f"<button{r.choice([' type=submit', ' class=btn', ''])}>{say(text, False)}</button>"
        if kind < 0.55:
            return "<select>" + "".join(f"<option>{say(sentence(1, 4, True), False)}{r.choice(['', '</option>'])}" for _ in range(r.integers(1, 4))) + "</select>"
        if kind < 0.65:
            return f"<textarea>{say(text, False)}</textarea>"
        if kind < 0.75:
            return f"<svg class=icon><title>{say(text, False)}</title><path d='M0'/></svg>"
        if kind < 0.9:
            return f"<noscript>{say(sentence(3, 14, True), False)}</noscript>"
        return str(r.choice(["<svg class=x />", "<script>if(a<b){x='<p>'}</script>", "<style>b:before{content:'<x'}</style>", "<iframe src=x>no</iframe>"]))

    def several(kinds: list[str]) -> str:
        return "".join(part(k) + (control() if r.random() < 0.15 else "") for k in kinds if r.random() < 0.55)

    out = ['<!DOCTYPE html><html lang="x"><head><title>', say(sentence(2, 8), False), "</title><style>p{}</style></head><body>"]
    out.append(several(["notice", "header", "nav", "ad", "form"]))
    tag = str(r.choice(["article", "article", "main", "div", "section"]))
    wrapped = r.random() < 0.4
    out.append(f'<div class="{r.choice(["container", "wrapper", "layout", "row", "page"])}">' if wrapped else "")
    if wrapped and r.random() < 0.4:
        out.append(part("aside"))
    out.append(f"<{tag}>" if tag in ("article", "main") and r.random() < 0.7 else f'<{tag} {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">')
    if r.random() < 0.85:
        out.append(f"<h1>{say(sentence(1, 12), True)}</h1>")
    for _ in range(int(r.integers(1, 14 if r.random() < 0.9 else 70))):
        kind = r.random()
        if kind < 0.08:
            out.append(f"<h2>{say(sentence(1, 8), True)}</h2>")
        elif kind < 0.16:
            out.append("<ul>" + "".join(f"<li>{say(sentence(2, 15), True)}</li>" for _ in range(r.integers(1, 5))) + "</ul>")
        elif kind < 0.2:
            out.append(f"<blockquote>{say(sentence(4, 30), True)}</blockquote>")
        elif kind < 0.26:
            out.append(part(str(r.choice(["ad", "share", "aside", "notice", "form"]))) if r.random() < 0.7 else control())
        elif kind < 0.34:
            out.append(f"<p><b>{say(sentence(1, 20), True)}<br>")
        else:
            out.append(f"<p>{say(' '.join(sentence(1, 25) for _ in range(r.integers(1, 4))) if r.random() < 0.8 else sentence(1, 6, r.random() < 0.5), True)}" + ("</p>" if r.random() < 0.9 else ""))
    if r.random() < 0.4:  # an article may end with a line that reads like a part
        out.append(f"<p>{'<b>' if r.random() < 0.5 else ''}{say(sentence(2, 7, True), True)}{r.choice(['</p>', '<br>', ''])}")
    out.append(f"</{tag}>")
    out.append(several(["share", "comments", "aside", "ad"]))
    out.append("</div>" if wrapped else "")
    out.append(several(["footer", "nav", "notice"]))
    out.append("</body></html>" if r.random() < 0.8 else "")
    return "".join(out), want


@lru_cache(1)
def trained(pages: int = 800, seed: int = 3) -> Labeller:
    """The labeller, trained on generated pages; the same for the same arguments."""
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, want = made_page(r)
        got = blocks(page)
        if [t for _, t, _ in got] == [t for t, _ in want] and got:
            ps, pi, ws, wi, ratios = vectors(got)
            seen = r.random(len(got)) < 0.6  # the words of the others are hidden, so that layout counts
            xs.append((ps, pi, ws[seen[wi]] if len(wi) else ws, wi[seen[wi]] if len(wi) else wi, ratios))
            ys.append(np.array([m for _, m in want], np.float32))
    model = Labeller()
    model.train(xs, ys)
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[list[str]]:
    """Main blocks of each page, in page order."""
    found = [blocks(p) if p else [] for p in pages]
    marks = model.label([vectors(b) for b in found])
    return [[t for (_, t, _), m in zip(b, k, strict=True) if m] for b, k in zip(found, marks, strict=True)]


def extract(spark: SparkSession, pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """All columns of pages(html, ...) and text, n_chars, n_blocks.

    Null and empty html give an empty text, 0 and 0. Each page is read whole. Character references are decoded,
    white space inside a block becomes one space, blocks are joined by one line break in page order. Input
    columns named like a result are replaced. Repeated rows give equal results; an empty table gives no rows.
    """
    bound_batches(spark, 500)
    own = pages.drop("text", "n_chars", "n_blocks")
    weights = spark.sparkContext.broadcast((model or trained()).p)  # about 0.3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Labeller()
        m.p = weights.value
        for b in batches:
            got = main_texts(m, b.column(0).field("html").to_pylist())
            text = ["\n".join(x) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(x) for x in got], pa.int64())], ["row", "text", "n_chars", "n_blocks"])

    packed = own.select(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == "html" else F.col(f"`{c}`") for c in own.columns]).alias("row"))
    schema = packed.select("row").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long")
    return packed.mapInArrow(run, schema).select("row.*", "text", "n_chars", "n_blocks")
