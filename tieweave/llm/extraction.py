"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text between block-level tags, each with the tags
and class names that enclose it. A bidirectional LSTM in numpy reads the whole sequence, a block
as the sum of fixed random vectors of its path, its hashed words and a few measures, and labels
every block as main text or not with the rest of the page in view.

It is trained here, on at most ``TRAIN_PAGES`` pages that say themselves what their main text is
(``article`` or ``main``), as they are and rewrapped: their containers get other usual names, and
menus, notices, forms, adverts, sidebars and comments with texts of other pages are put around
and between. Training is repeatable. Without a page to learn from, blocks under no name of page
furniture are main text.

Null and empty pages have no text. Pages are labelled whole, however long. Repeated rows are
labelled each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tieweave.llm import text as tx

#: Largest number of pages that are learned from (in the mean; picked by hash), and their largest size.
TRAIN_PAGES = 400
TRAIN_PAGE_CHARS = 100_000
PATH_SIZE, WORD_SIZE, MEASURES = 48, 24, 6
HIDDEN = 16
EPOCHS = 20
#: Blocks (with padding) that are labelled at once, unless one page has more.
BATCH_BLOCKS = 20_000

# Elements that end a block of text.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not shown as text.
HIDDEN_TAGS = ("script", "style", "template", "svg", "iframe", "textarea", "select", "canvas", "audio", "video")
# Those that only their closing tag ends; '/>' does not close them.
RAW_TAGS = ("script", "style", "textarea")
# Elements that end when one of the same kind starts.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
MAIN_TAGS = {"article", "main"}

# Usual names of containers of main text and of page furniture; "tag.class".
MAIN_NAMES = "article main div.content div.post div.entry-content div.article-body section.story div.main-text div.post-content td.content".split()
FURNITURE_NAMES = (
    "nav nav.menu div.menu div.navbar ul.navigation div.breadcrumb header header.site-header div.header div.masthead footer footer.site-footer div.footer div.copyright aside aside.sidebar div.sidebar "
    "div.widget div.related div.ad div.ads div.advert div.advertisement div.sponsor div.promo div.banner div.notice div.alert div.cookie-notice div.consent div.popup form form.search form.login div.subscribe "
    "div.newsletter div.share div.social div.comments section.comments div.comment div.comment-list ol.comments div.reply div.login div.tags div.pagination"
).split()
_FURNITURE_WORDS = {w for n in FURNITURE_NAMES for w in re.split(r"[.\-]", n)} - {"div", "ul", "ol", "section", "list", "site"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in HIDDEN_TAGS}


def _raw_end(page: str, at: int, tag: str) -> int:
    close = _HIDDEN_END[tag].search(page, at)
    return len(page) if close is None else max(at, page.find(">", close.end()) + 1 or len(page))


def _hidden_end(page: str, at: int, tag: str, around: set[str]) -> int:
    """Where a hidden element that starts before ``at`` ends: behind its closing tag, if that comes before the close
    of an enclosing block (one of ``around``); else before that close or the first block that starts after it."""
    inner: list[str] = []
    first, start = None, at
    closes = _HIDDEN_END[tag].search(page, at) is not None
    while (m := _TOKEN.search(page, at)) is not None:
        at = m.end()
        if m.group(2) is None:
            continue
        t = m.group(2).lower()
        if m.group(1):
            if t in inner:
                while inner.pop() != t:
                    pass
            elif t == tag:
                return at
            elif t in BLOCK_TAGS and t in around:
                return m.start() if first is None else first
        elif t in RAW_TAGS:
            at = _raw_end(page, at, t)
        elif t not in VOID_TAGS and not m.group(3).rstrip().endswith("/"):
            if first is None and t in BLOCK_TAGS and not (tag == "select" and t in ("option", "optgroup", "hr")):
                first = m.start()
                if not closes:
                    break
            inner.append(t)
    return start if first is None else first


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    in_main: bool


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order; broken markup ends blocks like sound markup does."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = tuple(x for _, names in stack for x in names)
                out.append(Block(path, text, min(linked, len(text)), any(t in MAIN_TAGS for t, _ in stack)))
            parts.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if any(t == "a" for t, _ in stack):
                linked += m.start() - at
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if any(t == tag for t, _ in stack):
                if tag in BLOCK_TAGS:
                    end()
                while stack.pop()[0] != tag:
                    pass
            elif tag in BLOCK_TAGS:
                end()
            continue
        if tag in HIDDEN_TAGS:
            if tag in RAW_TAGS:
                at = _raw_end(page, at, tag)
            elif not m.group(3).rstrip().endswith("/"):
                at = _hidden_end(page, at, tag, {t for t, _ in stack})
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end()
            if tag in SELF_ENDING and any(t == tag for t, _ in stack):
                top = max(i for i, (t, _) in enumerate(stack) if t == tag)
                # Only inside the same list or table.
                if not any(t in ("ul", "ol", "table", "dl", "div", "section", "article") for t, _ in stack[top + 1 :]):
                    del stack[top:]
        if tag in VOID_TAGS or m.group(3).rstrip().endswith("/"):
            continue
        found = ["".join(g) for g in _NAMES.findall(m.group(3))] if m.group(3) else []
        words = [w for f in found for w in re.split(r"[\s_\-]+", f.lower()) if w]
        stack.append((tag, (tag, *(f".{w}" for w in words))))
    end()
    return out


_CODES: dict[tuple[str, int], np.ndarray] = {}


def _code(token: str, size: int) -> np.ndarray:
    """Fixed random signs of a token."""
    key = (token, size)
    if key not in _CODES:
        if len(_CODES) > 100_000:
            _CODES.clear()
        _CODES[key] = np.random.default_rng(crc32(token.encode())).choice(np.array([-1.0, 1.0], np.float32), size) / np.float32(np.sqrt(size) / 2)
    return _CODES[key]


def _word_vectors(texts: list[str]) -> np.ndarray:
    """Mean of the random signs of each text's words."""
    words, bounds = tx.words(tx.as_strings(pa.array(texts, pa.string())), tx.ALPHANUMERIC_FOLDED)
    codes, distinct = tx.coded(words)
    hashes = tx.word_hashes(distinct)
    signs = ((hashes[:, None] >> np.arange(WORD_SIZE, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
    out = np.zeros((len(texts), WORD_SIZE), np.float32)
    held = np.flatnonzero(np.diff(bounds))
    if len(held):
        total = np.zeros(len(codes) + 1)
        for c in range(WORD_SIZE):
            total[1:] = np.cumsum(signs[codes, c])
            out[held, c] = (total[bounds[held + 1]] - total[bounds[held]]) / np.diff(bounds)[held]
    return out


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """One matrix a page, one row a block."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, PATH_SIZE + WORD_SIZE + MEASURES), np.float32) for _ in pages]
    paths: dict[tuple[str, ...], np.ndarray] = {}
    for b in flat:
        if b.path not in paths:
            # The same name again, deeper down, says little more; the innermost two count by place too.
            tokens = [*dict.fromkeys(b.path), *(f"^{k}{t}" for k, t in enumerate(b.path[-2:]))]
            paths[b.path] = np.sum([_code(t, PATH_SIZE) for t in tokens], axis=0) if tokens else np.zeros(PATH_SIZE, np.float32)
    path = np.stack([paths[b.path] for b in flat])
    measures = np.array([
        (np.log1p(len(b.text)) / 5, b.linked / max(1, len(b.text)), sum(b.text.count(c) for c in ".,;:!?") / max(1, len(b.text)) * 10, float(b.text[-1] in ".!?…\"”"), len(b.path) / 8, 1.0)
        for b in flat
    ], np.float32)
    rows = np.concatenate([path, _word_vectors([b.text for b in flat]), measures], axis=1)
    ends = np.cumsum([len(p) for p in pages])
    return np.split(rows, ends[:-1])


class BiLstm:
    """Two LSTMs over a sequence, one from each end, and a logistic output on both states."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, (2 * hidden + 1,)).astype(np.float32)}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.p[f"b{side}"] = bias

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = max(len(p) for p in pages)
        x = np.zeros((length, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((length, len(pages), 1), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1.0
        return x, mask

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        h_size = self.hidden
        w, b = self.p[f"w{side}"], self.p[f"b{side}"]
        drive = x @ w[: x.shape[2]] + b
        h = np.zeros((x.shape[1], h_size), np.float32)
        c = np.zeros_like(h)
        states, tape = np.zeros((*x.shape[:2], h_size), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = drive[t] + h @ w[x.shape[2] :]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_size], -30, 30)))
            i, f, o = gate[:, :h_size], gate[:, h_size : 2 * h_size], gate[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            new = f * c + i * g
            squash = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, squash))
            # Beyond a page's end the state stays as it was.
            m = mask[t]
            c = m * new + (1 - m) * c
            h = m * (o * squash) + (1 - m) * h
            states[t] = h
        return states, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, tf = self._pass(x, mask, "f", keep)
        hb, tb = self._pass(x, mask, "b", keep)
        both = np.concatenate([hf, hb, np.ones((*hf.shape[:2], 1), np.float32)], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["out"], -30, 30))), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, (both, tf, tb) = self.forward(x, mask, keep=True)
        error = (prob - y) * mask[:, :, 0] / max(1.0, float(mask.sum()))
        grads = {"out": np.einsum("tbk,tb->k", both, error)}
        size = self.hidden
        for side, tape, at in (("f", tf, 0), ("b", tb, size)):
            w = self.p[f"w{side}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{side}"])
            dh = np.zeros((x.shape[1], size), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, squash in reversed(tape):
                m = mask[t]
                dh = dh + error[t][:, None] * self.p["out"][at : at + size]
                dnew = m * (dc + dh * o * (1 - squash**2))
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * squash * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                gw += np.concatenate([x[t], h], axis=1).T @ dz
                gb += dz.sum(0)
                dh, dc = (1 - m) * dh + dz @ w[x.shape[2] :].T, dnew * f + (1 - m) * dc
            grads[f"w{side}"], grads[f"b{side}"] = gw, gb
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            # Pages of like length together waste little padding.
            order = np.argsort([len(p) + rng.random() * 8 for p in pages], kind="stable")
            runs = [order[i : i + batch] for i in range(0, len(order), batch)]
            for r in rng.permutation(len(runs)):
                x, mask = self.padded([pages[i] for i in runs[r]])
                y = np.zeros(mask.shape[:2], np.float32)
                for k, i in enumerate(runs[r]):
                    y[: len(labels[i]), k] = labels[i]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[take]]) <= BATCH_BLOCKS:
                take += 1
            run, order = order[:take], order[take:]
            prob, _ = self.forward(*self.padded([pages[i] for i in run]))
            for k, i in enumerate(run):
                out[i] = prob[: len(pages[i]), k]
        return out


def rewrapped(page: list[Block], others: list[str], rng: np.random.Generator) -> list[Block]:
    """A page's main text in another container, with furniture holding texts of other pages around and inside it."""
    def names(n: str) -> tuple[str, ...]:
        tag, _, cls = n.partition(".")
        return (tag, *(f".{w}" for w in cls.split("-") if w))

    def furniture(deep: bool) -> list[Block]:
        name = names(FURNITURE_NAMES[rng.integers(len(FURNITURE_NAMES))])
        inner = [(), ("p",), ("ul", "li"), ("div",), ("ul", "li", "a"), ("p", "b")][rng.integers(6)]
        path = ("html", "body", *(main if deep else ()), *name, *inner)
        texts = []
        for _ in range(rng.integers(1, 5)):
            words = others[rng.integers(len(others))].split()
            short = rng.random() < 0.5
            texts.append(" ".join(words[: rng.integers(1, 6)] if short else words))
        return [Block(path, t, len(t) if "a" in inner else 0, False) for t in texts if t]

    main = names(MAIN_NAMES[rng.integers(len(MAIN_NAMES))])
    wrap = [(), ("div",), ("div", ".wrapper"), ("div", ".container"), ("section",)][rng.integers(5)]
    body = [
        Block(("html", "body", *wrap, *main, *(b.path[next(i for i, t in enumerate(b.path) if t in MAIN_TAGS) + 1 :])), b.text, b.linked, True) for b in page if b.in_main
    ]
    out = [x for _ in range(rng.integers(0, 4)) for x in furniture(False)]
    for b in body:
        # Main text has very short blocks too.
        out.append(Block(b.path, " ".join(b.text.split()[: rng.integers(1, 4)]), b.linked, True) if rng.random() < 0.15 else b)
        if rng.random() < 0.04:
            out += furniture(True)
    return out + [x for _ in range(rng.integers(0, 4)) for x in furniture(False)]


def train(pages: list[str], seed: int = 5) -> BiLstm | None:
    """Labeller from pages that mark their main text; None if there are none."""
    rng = np.random.default_rng(seed)
    known = [p for p in (blocks(h) for h in pages) if any(b.in_main for b in p) and not all(b.in_main for b in p)]
    if not known:
        return None
    others = [b.text for p in known for b in p]
    every = known + [rewrapped(p, others, rng) for _ in range(2) for p in known]
    model = BiLstm(PATH_SIZE + WORD_SIZE + MEASURES)
    model.fit(features(every), [np.array([b.in_main for b in p], np.float32) for p in every])
    return model


def training_pages(pages: DataFrame, most: int = TRAIN_PAGES) -> list[str]:
    """At most about ``most`` pages, by hash, of a bounded size each."""
    parts = 1 << 20
    usable = pages.filter((F.length("html") <= TRAIN_PAGE_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    share = min(1.0, most / max(1, usable.count()))
    rows = usable.filter(F.pmod(F.xxhash64("html"), F.lit(parts)) < int(share * parts)).select("html").distinct().collect()
    return sorted(r["html"] for r in rows)


def main_blocks(page: list[Block], prob: np.ndarray | None) -> list[str]:
    if prob is None:
        return [b.text for b in page if not any(t.strip(".") in _FURNITURE_WORDS or t in ("head", "title") for t in b.path)]
    return [b.text for b, p in zip(page, prob.tolist(), strict=True) if p >= 0.5]


def extracted(pages: DataFrame, model: BiLstm | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for batch, html in tx.slices(batches, "html", 2 << 20):
            cut = [blocks(h) for h in html.to_pylist()]
            probs = labeller.label(features(cut)) if labeller is not None else [None] * len(cut)
            texts = ["\n".join(main_blocks(p, q)) for p, q in zip(cut, probs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    return extracted(pages, train(training_pages(pages, most)))
