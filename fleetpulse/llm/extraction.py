"""Main text of HTML pages by a recurrent labeller of their leaf blocks.

Each leaf block becomes the elements around it (hashed tags and words of class, id and role; the nearest apart from those further
out), its hashed words, and a few dense numbers. A bidirectional LSTM reads the blocks of a page in both directions and
classifies every one; kept blocks are joined in order.

Pages carry no labels, so the labeller is trained on pages made by rule: texts of a bounded sample of the table
(`TRAINING_PAGES` pages with the least hash of id and url) are laid out at random as articles with menus, headers, adverts, notices,
forms, comments, sidebars and footers in many tags and names. The sample's size does not grow with the table.

Null and empty pages, and pages without main text, have the text ''. Rows keep their ids, repeated or null. Other columns are
ignored. A page is held in memory whole; pages are labelled in runs of about `RUN_BLOCKS` blocks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import recurrent as R
from fleetpulse.llm.blocks import Block, blocks_of

TRAINING_PAGES = 200
TRAINING_PAGE_BYTES = 1 << 16
MADE_PAGES = 2400
PER_BATCH = 16
HIDDEN = 20
TABLES = {"path": (1 << 10, 12), "word": (1 << 11, 6)}
DENSE = 8
RUN_BLOCKS = 4096

# Names and words that pages use for their parts.
MAIN = "article content post entry story main body text page-content post-body entry-content article-body story-body main-content"
MENU = "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar links skip pagination pager tabs"
HEADER = "header masthead banner site-header top logo brand branding tagline"
FOOTER = "footer site-footer bottom copyright legal colophon foot credits imprint"
SIDEBAR = "sidebar aside widget related recommended trending popular side rail more-stories tags categories teaser"
ADVERT = "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense outbrain"
NOTICE = "cookie cookie-banner consent notice alert gdpr privacy-notice popup modal overlay announcement warning paywall"
FORM = "form newsletter subscribe signup login search search-form contact subscription share social sharing"
COMMENTS = "comments comment comment-list discussion responses replies reply disqus thread user-comment"
SAID = {
    "menu": ["Home", "About", "Contact", "News", "Blog", "Sports", "Archive", "Next", "Previous", "Skip to content", "Sitemap"],
    "header": ["Welcome to our site", "The daily paper", "Log in", "Sign up", "Menu"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "© Example Inc.", "Powered by", "Imprint"],
    "sidebar": ["Related articles", "Most read", "You may also like", "Tags", "Categories", "Recent posts", "Trending now"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Limited offer", "Anzeige", "Publicité", "Publicidad"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "Please enable JavaScript"],
    "form": ["Subscribe to our newsletter", "Email address", "Send", "Search", "Your name", "Share this article", "Submit"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Reply", "Kommentare", "Commentaires", "Comentarios", "Anonymous says:"],
}
FILLER = [
    "The council met on Tuesday to settle the budget for the coming year, and members agreed on most of it.",
    "Water levels fell again last month. Farmers along the river say that the harvest will be smaller than usual.",
    "She opened the letter, read it twice, and put it back without a word.",
]


def _names(text: str) -> list[str]:
    return text.split()


class PageMaker:
    """Random pages with a label for every leaf block, built from given texts."""

    def __init__(self, texts: list[str], seed: int = 7):
        self.texts, self.rng = texts or FILLER, random.Random(seed)

    def sentence(self, short: bool = False) -> str:
        words = self.rng.choice(self.texts).split()
        if short:
            at = self.rng.randrange(max(1, len(words)))
            words = words[at : at + self.rng.randint(1, 6)]
        elif self.rng.random() < 0.3:
            words = words[: self.rng.randint(1, 30)]
        return " ".join(words) or "Text"

    def named(self, names: str, junk: float = 0.1) -> tuple[str, ...]:
        """Words of class and id, now and then some that say nothing."""
        r = self.rng
        odd = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))
        if r.random() < junk:
            return (odd,)
        own = tuple(p for name in r.sample(_names(names), r.choice([1, 1, 2])) for p in name.split("-"))
        return (*own, odd) if r.random() < 0.2 else own

    def box(self, names: str, tags: list[str]) -> list[tuple[str, ...]]:
        """Elements around a part: a telling tag, or a plain one with a telling name."""
        r = self.rng
        tag = r.choice(tags)
        if r.random() < 0.5 and tag not in ("div", "section", "ul", "td", "table"):
            return [(tag, *(self.named(names, 0.3) if r.random() < 0.3 else ()))]
        return [("div" if r.random() < 0.7 else tag, *self.named(names, 0.0))]

    def part(self, kind: str, names: str, tags: list[str], lists: float, prose: float, linked: float) -> list[tuple]:
        r, out = self.rng, []
        path = self.box(names, tags)
        as_list = r.random() < lists
        for i in range(r.randint(1, 7 if lists else 3)):
            said = r.random()
            text = self.sentence() if said < prose else r.choice(SAID[kind]) if said < prose + 0.3 else self.sentence(short=True)
            inner = [("ul",), ("li",)] if as_list else r.choice([[], [("p",)], [("div",)], [("span",)]][: 3 if i else 1])
            if i == 0 and r.random() < 0.2:
                inner, text = [(r.choice(["h2", "h3", "h4"]),)], r.choice(SAID[kind])
            out.append((path + inner, text, len(text) if r.random() < linked else 0, 0))
        return out

    def comments(self) -> list[tuple]:
        r, path, out = self.rng, self.box(COMMENTS, ["section", "div", "aside"]), []
        if r.random() < 0.6:
            out.append((path + [(r.choice(["h2", "h3"]),)], r.choice(SAID["comments"]), 0, 0))
        named = path if any(w in path[0][1:] for w in ("comments", "comment", "discussion", "responses", "replies", "disqus", "thread")) else None
        each = [("article", *self.named(COMMENTS, 0.0)), ("li", "comment"), ("div", *self.named(COMMENTS, 0.0))]
        for _ in range(r.randint(1, 5)):
            item = [r.choice(each if named is None else [*each, ("div",), ("article",), ("li",)])]
            out.append((path + item + r.choice([[], [("p",)]]), self.sentence(), 0, 0))
        return out

    def main(self) -> list[tuple]:
        r = self.rng
        kind = r.random()
        if kind < 0.4:
            path = [("article", *(self.named(MAIN) if r.random() < 0.4 else ()))]
        elif kind < 0.5:
            path = [("main", *(self.named(MAIN) if r.random() < 0.4 else ()))]
        elif kind < 0.6:
            path = [("main",), ("article",)]
        elif kind < 0.9:
            path = [(r.choice(["div", "div", "section", "td"]), *self.named(MAIN, 0.0))]
        else:
            path = [("div", *self.named(MAIN, 1.0))]
        out = []
        head = r.choice([[("h1",)], [("h1",)], [("header",), ("h1",)], [("h2",)]])
        if r.random() < 0.85:
            out.append((path + head, self.sentence(short=r.random() < 0.5), 0, 1))
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20])):
            form = r.random()
            if form < 0.75:
                text = self.sentence(short=r.random() < 0.15)
                out.append((path + ([("p",)] if r.random() < 0.95 else []), text, len(text) // 5 if r.random() < 0.1 else 0, 1))
            elif form < 0.82:
                out.append((path + [(r.choice(["h2", "h3", "h4"]),)], self.sentence(short=True), 0, 1))
            elif form < 0.89:
                around = [[("ul",), ("li",)], [("ol",), ("li",)], [("table",), ("tr",), ("td",)], [("dl",), ("dd",)]]
                item = r.choice(around)
                out += [(path + item, self.sentence(short=r.random() < 0.6), 0, 1) for _ in range(r.randint(1, 5))]
            elif form < 0.94:
                item = r.choice([[("blockquote",)], [("blockquote",), ("p",)], [("pre",)], [("figure",), ("figcaption",)]])
                out.append((path + item, self.sentence(), 0, 1))
            else:
                out += [(path + p, *rest) for p, *rest in self.inset()]
        if r.random() < 0.15:
            out += [(path + p, *rest) for p, *rest in (self.comments() if r.random() < 0.5 else self.inset())]
        if r.random() < 0.1:
            out += [(path + [("footer",)], self.sentence(short=r.random() < 0.5), 0, 0)]
        return out

    def inset(self) -> list[tuple]:
        """Something else within the article."""
        r = self.rng
        return r.choice(
            [
                lambda: self.part("advert", ADVERT, ["aside", "div"], 0.0, 0.6, 0.3),
                lambda: self.part("sidebar", SIDEBAR, ["aside", "aside", "div"], 0.6, 0.2, 0.8),
                lambda: self.part("form", FORM, ["form", "form", "div"], 0.1, 0.2, 0.1),
                lambda: self.part("notice", NOTICE, ["aside", "dialog", "div"], 0.0, 0.5, 0.2),
                lambda: self.part("menu", MENU, ["nav", "nav", "ul"], 0.8, 0.0, 1.0),
            ]
        )()

    def page(self) -> list[tuple]:
        """(path, text, linked, label) of each block."""
        r, out = self.rng, []
        maybe = lambda chance, build: out.extend(build()) if r.random() < chance else None
        maybe(0.25, lambda: self.part("notice", NOTICE, ["dialog", "aside", "div", "noscript"], 0.0, 0.5, 0.2))
        maybe(0.5, lambda: self.part("header", HEADER, ["header", "header", "div"], 0.1, 0.2, 0.4))
        maybe(0.75, lambda: self.part("menu", MENU, ["nav", "nav", "ul", "header"], 0.85, 0.0, 1.0))
        maybe(0.45, lambda: self.part("advert", ADVERT, ["aside", "div", "div"], 0.0, 0.7, 0.2))
        maybe(0.15, lambda: self.part("form", FORM, ["form", "form", "div"], 0.1, 0.2, 0.1))
        maybe(0.15, lambda: self.part("sidebar", SIDEBAR, ["aside", "aside", "div"], 0.6, 0.3, 0.7))
        maybe(0.96, self.main)
        maybe(0.25, lambda: self.part("advert", ADVERT, ["aside", "div", "div"], 0.0, 0.7, 0.2))
        maybe(0.35, self.comments)
        maybe(0.35, lambda: self.part("sidebar", SIDEBAR, ["aside", "aside", "div"], 0.6, 0.3, 0.7))
        maybe(0.2, lambda: self.part("form", FORM, ["form", "form", "div"], 0.1, 0.2, 0.1))
        maybe(0.7, lambda: self.part("footer", FOOTER, ["footer", "footer", "div"], 0.3, 0.6, 0.3))
        maybe(0.15, lambda: self.part("notice", NOTICE, ["dialog", "aside", "div"], 0.0, 0.5, 0.2))
        outer = r.choice([[], [], [("div", *self.named("wrapper container page site layout row column grid"))], [("div",), ("div",)]])
        return [([("html",), ("body",)] + outer + path, *rest) for path, *rest in out]


@lru_cache(1 << 16)
def path_ids(path: tuple[tuple[str, ...], ...]) -> list[int]:
    """Buckets of the elements around a block; the innermost two count as near."""
    last, out = TABLES["path"][0] - 1, []
    for depth, element in enumerate(reversed(path)):
        if element[0] not in ("html", "body"):
            near = "near" if depth < 2 else "far"
            out.append(crc32(f"{near} {element[0]}".encode()) & last)
            out += [crc32(f"in {name}".encode()) & last for name in element]
            out += [crc32(f"{near} .{name}".encode()) & last for name in element[1:]]
    return out


def dense_of(text: str, linked: int, words: int) -> list[float]:
    size, data = len(text), text.encode("utf-8", "replace")
    marks = len(data) - len(data.translate(None, b".,;:!?"))
    share = linked / size
    ends = text[-1] in ".!?:…。"
    return [log1p(size) / 5, log1p(words) / 4, share, share > 0.5, min(1.0, marks / words), ends, "©" in text, words < 4]


def batch_of(pages: list[list[Block]]) -> R.Batch:
    flat = [b for page in pages for b in page]
    paths = [path_ids(tuple(b.path)) for b in flat]
    # Blocks have single spaces between words.
    n_words = [b.text.count(" ") + 1 for b in flat]
    words = " ".join(b.text.lower() for b in flat).encode("utf-8", "replace").split(b" ")
    ids = {}
    for name, sizes, values in (("path", map(len, paths), chain.from_iterable(paths)), ("word", n_words, map(crc32, words))):
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64, len(flat)))])
        ids[name] = np.fromiter(values, np.int64, int(bounds[-1])) & (TABLES[name][0] - 1), bounds
    dense = np.array([dense_of(b.text, b.linked, n) for b, n in zip(flat, n_words)], np.float64).reshape(-1, DENSE)
    return R.Batch(np.array([len(p) for p in pages]), ids, dense)


def fit(texts: list[str], seed: int = 7, pages: int = MADE_PAGES) -> R.Params:
    """Trains a labeller on pages made from texts; equal texts give equal weights."""
    maker = PageMaker(texts, seed)

    def batches() -> Iterator[tuple[R.Batch, np.ndarray]]:
        for _ in range(pages // PER_BATCH):
            made = [p for _ in range(PER_BATCH) if (p := maker.page())]
            made.sort(key=len)
            rows = [[Block(path, text, linked) for path, text, linked, _ in page] for page in made]
            yield batch_of(rows), np.array([float(b[3]) for page in made for b in page])

    params = R.train(R.initial(np.random.default_rng(seed), TABLES, DENSE, HIDDEN), batches(), pages // PER_BATCH)
    return {k: v.astype(np.float32) for k, v in params.items()}


def labels_of(params: R.Params, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are main text."""
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    at = 0
    while at < len(order):
        # Pages of like length side by side; the padded run is bounded, or one page.
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= RUN_BLOCKS:
            end += 1
        chosen = [pages[i] for i in order[at:end]]
        logits, _ = R.forward(params, batch_of(chosen))
        for i, part in zip(order[at:end], np.split(logits, np.cumsum([len(p) for p in chosen])[:-1])):
            out[i] = part > 0
        at = end
    return out


def training_texts(pages: DataFrame) -> list[str]:
    """Texts of blocks of the bounded training sample, in a fixed order."""
    known = pages.where(F.octet_length("html") <= TRAINING_PAGE_BYTES).select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url").alias("key"))
    # A range of the hash with a few times as many rows comes first, so that tasks do not send that many each.
    share = min(1.0, 8 * TRAINING_PAGES / max(1, pages.count()))
    near = known.where(F.shiftrightunsigned("key", 33) <= int(share * (1 << 31)))
    sample = near.orderBy("key", "html").limit(TRAINING_PAGES).collect()
    return [b.text for row in sample for b in blocks_of(row.html)]


def extract(pages: DataFrame, params: R.Params | None = None) -> DataFrame:
    """page_id, url, text (main blocks, one a line) and n_chars of every page."""
    weights = params or fit(training_texts(pages))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in runs_of(batch.column("html")):
                part = batch.slice(first, end - first)
                found = [blocks_of(html) for html in part.column("html").to_pylist()]
                kept = labels_of(weights, found)
                texts = ["\n".join(b.text for b, keep in zip(page, mine) if keep) for page, mine in zip(found, kept)]
                own = [part.column("page_id"), part.column("url")]
                columns = [*own, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "html")))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def runs_of(html: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes of HTML, one row at least."""
    first = total = 0
    sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in html]
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes)
