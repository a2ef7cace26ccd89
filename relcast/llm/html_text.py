"""Operator 7: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order: the text directly inside one block-level element, with the tags,
classes, ids and roles of its ancestors.  The chain labels each block as article text or not, from ancestor and text
features and from the label before it; Viterbi finds the best labelling.  Text of scripts, styles, titles and other
elements that are never shown is no block; those of them that can nest end at their own close, and without one hide nothing.

The field is trained on labelled pages: pages laid out by ``labelled_pages`` in common ways (with and without
article elements, with menus, notices, adverts, forms, side columns, comments inside and outside the article),
whose blocks' labels are known, filled with words of a bounded hash sample (about ``SAMPLE``) of the given pages.
Training is on the driver, in proportion to those pages only; every page is then parsed and labelled in tasks.

Defined cases: a null, empty or markup-only html has text '' and n_chars 0; broken markup is read as far as it goes
(unclosed elements end with the page, stray end tags are ignored); null ids and urls are passed through; repeated rows
give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

SAMPLE = 200
TRAIN_PAGES = 400

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe".split())  # text up to the close, whatever it holds
FOREIGN = frozenset("svg math".split())
HIDDEN = frozenset("script style title textarea template noscript iframe svg math object audio video canvas xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th
 thead tr ul button label caption""".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",),
         "tbody": ("table",), "tfoot": ("table",)}
KEEPS_P = frozenset("button label option optgroup select caption legend td th tr tbody thead tfoot body head html".split())

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|x-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]{2,}")


class Paths:
    """Ancestor paths as small integers; each path knows its parent, tag and name tokens."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.parent, self.tag, self.names = [-1], [""], [()]

    def child(self, parent: int, tag: str, names: tuple[str, ...]) -> int:
        key = (parent, tag, names)
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.names.append(names)
        return at


def _raw_end(page: str, at: int, tag: str) -> int:
    """The end of the raw element ``tag`` whose start tag ends at ``at``."""
    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return close.end() if close else len(page)


def hidden_ends(page: str, at: int) -> dict[int, int]:
    """Ends of the start tag -> end of the element, for the hidden elements from ``at`` on that are closed, in one pass."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in HIDDEN - RAW}
    while m := TAG.search(page, at):
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if m[1]:
            if opened.get(tag):
                ends[opened[tag].pop()] = at
        elif m[3] and m[3].endswith("/") and (tag in FOREIGN or tag in RAW and any(opened[t] for t in FOREIGN)):
            continue
        elif tag in RAW:
            at = _raw_end(page, at, tag)
        elif tag in opened:
            opened[tag].append(at)
    return ends


def leaf_blocks(page: str | None, paths: Paths) -> list[tuple[int, str, int, str]]:
    """(path, text, characters inside links, x-label) of each leaf block, in page order."""
    page = page or ""
    out: list[tuple[int, str, int, str]] = []
    stack: list[tuple[str, int, str]] = [("", 0, "")]
    buf: list[str] = []
    links = linked = 0
    where, mark = 0, ""
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal buf, linked
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((where, text, min(linked, len(text)), mark))
            buf, linked = [], 0

    def pop_to(n: int) -> None:
        nonlocal links
        for x in stack[n:]:
            links -= x[0] == "a"
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            chunk = page[at:stop]
            if "&" in chunk:
                chunk = entities.unescape(chunk)
            if chunk.isspace():
                if buf:
                    buf.append(" ")
            else:
                if not buf:
                    where, mark = stack[-1][1], next((x[2] for x in reversed(stack) if x[2]), "")
                buf.append(chunk)
                if links:
                    linked += len(chunk)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] == tag:
                    pop_to(n)
                    break
                if tag not in BLOCK and stack[n][0] in BLOCK:
                    break
            continue
        if tag == "br":
            buf.append(" ") if buf else None
            continue
        if tag in HIDDEN:
            if tag in RAW:
                at = _raw_end(page, at, tag)
            elif tag not in FOREIGN or not m[3].endswith("/"):
                if ends is None:
                    ends = hidden_ends(page, m.start())
                at = ends.get(at, at)
            continue
        if tag in BLOCK:
            flush()
            if tag not in KEEPS_P:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == "p":
                        pop_to(n)
                        break
                    if stack[n][0] in BLOCK:
                        break
            if tag in CLOSES:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] in SCOPE[tag]:
                        break
                    if stack[n][0] in CLOSES[tag]:
                        pop_to(n)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        names, label = (), ""
        if m[3]:
            found: list[str] = []
            for a in ATTR.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "x-label":
                    label = value
                else:
                    found += NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            names = tuple(sorted(set(found)))
        links += tag == "a"
        stack.append((tag, paths.child(stack[-1][1], tag, names), label))
    flush()
    return out


def _bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def path_features(paths: Paths, at: int) -> list[str]:
    out, tags, first = set(), [], True
    while at > 0:
        tag = paths.tag[at]
        if tag in BLOCK or tag == "a":
            if first:
                out.add(f"own:{tag}")
                first = False
            out.add(f"in:{tag}")
            tags.append(tag)
            for n in paths.names[at]:
                out.add(f"name:{n}")
        at = paths.parent[at]
    if "article" in tags:
        out |= {f"article>{t}" for t in tags[:tags.index("article")]}
    return sorted(out)


def text_features(text: str, linked: int, place: int, last: int) -> tuple[str, ...]:
    n, link = _bucket(len(text), (10, 25, 60, 120, 300)), _bucket(linked / len(text), (0.05, 0.5, 0.95))
    return (f"len:{n}", f"link:{link}", f"both:{n}:{link}", f"end:{text[-1] in '.!?…\"”'}", f"copy:{'©' in text}",
            f"commas:{_bucket(text.count(','), (1, 3))}", f"first:{place == 0}", f"last:{place == last}")


class Chain:
    """Weights of block features per label, of label pairs, and of the first label."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.vocabulary, self.weights, self.moves, self.start = vocabulary, weights, moves, start
        self.paths, self.of_path, self.of_text = Paths(), {}, {}

    def emissions(self, blocks: list[tuple]) -> list[tuple[float, float]]:
        if len(self.of_path) > 50_000:  # memory only: they are computed again
            self.paths, self.of_path = Paths(), {}
        out = []
        for i, (path, text, linked, _) in enumerate(blocks):
            if (p := self.of_path.get(path)) is None:
                p = self.of_path[path] = self._sum(path_features(self.paths, path))
            names = text_features(text, linked, i, len(blocks) - 1)
            if (t := self.of_text.get(names)) is None:
                t = self.of_text[names] = self._sum(names)
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def _sum(self, names) -> tuple[float, float]:
        at = [self.vocabulary[n] for n in names if n in self.vocabulary]
        w = self.weights[at].sum(0) if at else np.zeros(2)
        return float(w[0]), float(w[1])

    def viterbi(self, scores: list[tuple[float, float]]) -> list[int]:
        """The best labelling; ties go to 0, not article."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back = []
        for x, y in scores[1:]:
            p, q = int(b + m10 > a + m00), int(b + m11 > a + m01)
            back.append((p, q))
            a, b = (b + m10 if p else a + m00) + x, (b + m11 if q else a + m01) + y
        label = [int(b > a)]
        for p, q in reversed(back):
            label.append(q if label[-1] else p)
        return label[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page, self.paths)
        keep = self.viterbi(self.emissions(blocks))
        out = " ".join(b[1] for b, k in zip(blocks, keep) if k)
        if len(self.paths.parent) > 200_000:
            self.paths, self.of_path = Paths(), {}
        return out


# Layouts of the labelled pages. {m} menu, {h} heading, {t} article text, {s} short sentence, {l} links, {c} comments, {f} form fields.
OPENERS = ["<nav><ul>{m}</ul></nav>", "<header><h1>{s0}</h1><nav>{m}</nav></header>", "<div id='menu' class='menu'><ul>{m}</ul></div>",
           "<div class='navbar'>{l}</div><div class='breadcrumb'>{l}</div>", "<header class='site-header'><div class='logo'>{s0}</div><ul role='navigation'>{m}</ul></header>"]
NOTICES = ["", "<div class='ad'>{s0}</div>", "<div class='cookie-notice'><p x-label='0'>{s0}</p><button>{s0}</button></div>", "<div class='advert banner'><p x-label='0'>{s0}</p></div>",
           "<div class='sponsored promo'>{s0}</div>", "<div role='alert' class='notice'>{s0}</div>", "<aside class='ads'><p x-label='0'>{s0}</p></aside>", "<dialog class='consent'>{s0}</dialog>"]
BODIES = ["<article>{h}{t}</article>", "<main>{h}{t}</main>", "<main><article>{h}{t}</article></main>", "<div class='content'>{h}{t}</div>",
          "<div id='main'><div class='post'>{h}{t}</div></div>", "<article>{h}{t}{ad}{t}</article>", "<article>{h}{t}<section class='comments'>{c}</section></article>",
          "<div class='entry-content'>{h}{t}</div>", "<section class='article-body'>{h}{t}</section>", "<article><header x-label='1'>{h}</header>{t}<footer>{l}</footer></article>",
          "<div>{h}{t}</div>", "<article>{h}{t}<aside class='related'>{l}</aside>{t}</article>"]
AFTERS = ["", "<aside><ul>{m}</ul></aside>", "<div class='sidebar'><p x-label='0'>{s0}</p>{l}</div>", "<section id='comments'>{c}</section>", "<div class='comment-list'>{c}</div>",
          "<form class='newsletter'>{f}</form>", "<form action='/search'>{f}</form>", "<div class='related-posts'>{l}</div>", "<div class='share social'>{l}</div>"]
CLOSERS = ["<footer>&copy; {s0}</footer>", "<footer><p x-label='0'>&copy; {s0}</p><ul>{m}</ul></footer>", "<div id='footer'>{s0}</div>", "<div class='footer copyright'>&copy; {s0}{l}</div>", ""]


def labelled_pages(words: list[str], pages: int = TRAIN_PAGES, seed: int = 11) -> list[str]:
    """Pages whose article blocks carry x-label="1"."""
    rng = random.Random(seed)
    word = lambda: rng.choice(words)
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ","])

    def menu() -> str:
        return "".join(f"<li><a href='/x'>{entities.escape(word())}</a></li>" for _ in range(rng.randint(2, 7)))

    def links() -> str:
        return rng.choice([" | ", "<br>", " "]).join(f"<a href='/y'>{entities.escape(say(rng.randint(1, 6)))}</a>" for _ in range(rng.randint(1, 5)))

    def prose() -> str:
        out = []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            text = entities.escape(" ".join(say(rng.choice([1, 2, 5, 12, 20])) for _ in range(rng.choice([1, 1, 2, 4, 8]))))
            if rng.random() < 0.1:
                text += f" <a href='/z'>{entities.escape(word())}</a> {entities.escape(word())}."
            kind = rng.random()
            out.append(f"<ul><li x-label='1'>{text}</li></ul>" if kind < 0.06 else f"<blockquote x-label='1'>{text}</blockquote>" if kind < 0.1 else
                       f"<h2 x-label='1'>{text[:40]}</h2>" if kind < 0.18 else f"<pre x-label='1'>{text}</pre>" if kind < 0.2 else
                       f"<p x-label='1'><b>{text}<br>" if kind < 0.3 else f"<table><tr><td x-label='1'>{text}</td></tr></table>" if kind < 0.33 else
                       f"<figure><figcaption x-label='1'>{text}</figcaption></figure>" if kind < 0.35 else f"<p x-label='1'>{text}</p>")
        return "".join(out)

    def fill(layout: str) -> str:
        part = {"m": menu, "l": links, "t": prose, "s0": lambda: entities.escape(say(rng.randint(2, 14))),
                "h": lambda: rng.choice(["", "<h1 x-label='1'>%s</h1>" % entities.escape(say(rng.randint(2, 9)))]),
                "ad": lambda: f"<div class='ad'>{entities.escape(say(rng.randint(3, 12)))}</div>",
                "c": lambda: "".join(f"<div class='comment'><p x-label='0'>{entities.escape(say(rng.choice([3, 9, 20, 40])))}</p></div>" for _ in range(rng.randint(1, 4))),
                "f": lambda: f"<label>{entities.escape(word())}</label><select><option>{entities.escape(word())}</option></select><button>{entities.escape(word())}</button>"}
        return re.sub(r"\{(\w+)\}", lambda m: part[m[1]](), layout)

    out = []
    for _ in range(pages):
        notices = [rng.choice(NOTICES) for _ in range(2)]
        after = [rng.choice(AFTERS) for _ in range(rng.randint(0, 2))]
        out.append("<html><body>" + "".join(fill(x) for x in [rng.choice(OPENERS), notices[0], rng.choice(BODIES), notices[1], *after, rng.choice(CLOSERS)]) + "</body></html>")
    return out


def fit(pages: list[str], rounds: int = 150, penalty: float = 0.02, rate: float = 0.1) -> Chain:
    """The chain of maximal penalised likelihood (Adam on exact forward-backward gradients)."""
    paths, vocabulary, sequences = Paths(), {}, []
    for page in pages:
        blocks = leaf_blocks(page, paths)
        if blocks:
            names = [path_features(paths, b[0]) + list(text_features(b[1], b[2], i, len(blocks) - 1)) for i, b in enumerate(blocks)]
            sequences.append(([[vocabulary.setdefault(f, len(vocabulary)) for f in n] for n in names], [int(b[3] == "1") for b in blocks]))
    n, t = len(sequences), max(len(y) for _, y in sequences)
    size = np.array([len(y) for _, y in sequences])
    live = np.arange(t)[None, :] < size[:, None]
    gold = np.zeros((n, t), int)
    cell, feat = [], []
    for s, (x, y) in enumerate(sequences):
        gold[s, :len(y)] = y
        for i, f in enumerate(x):
            feat += f
            cell += [s * t + i] * len(f)
    cell, feat = np.array(cell), np.array(feat)
    truth = np.eye(2)[gold] * live[..., None]
    v = len(vocabulary)
    theta = np.zeros(2 * v + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, moves, start = theta[:2 * v].reshape(v, 2), theta[2 * v:2 * v + 4].reshape(2, 2), theta[2 * v + 4:]
        e = np.stack([np.bincount(cell, w[feat, k], n * t) for k in (0, 1)], 1).reshape(n, t, 2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = e[:, 0] + start
        for i in range(1, t):
            fwd[:, i] = np.where(live[:, i, None], e[:, i] + np.logaddexp.reduce(fwd[:, i - 1, :, None] + moves, axis=1), fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            nxt = np.logaddexp.reduce(moves[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(live[:, i + 1, None], nxt, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        d = (p - truth).reshape(-1, 2)
        gw = np.stack([np.bincount(feat, d[cell, k], v) for k in (0, 1)], 1)
        pair = np.exp(fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        gm = pair.sum((0, 1)) - (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum((0, 1))
        grad = np.concatenate([gw.ravel(), gm.ravel(), d.reshape(n, t, 2)[:, 0].sum(0)]) / n + penalty / n * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        theta = theta - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return Chain(vocabulary, theta[:2 * v].reshape(v, 2), theta[2 * v:2 * v + 4].reshape(2, 2), theta[2 * v + 4:])


DEFAULT_WORDS = "the of and to in is that for it with as was on are by this be from or an".split()


def sample_words(pages: DataFrame, html_col: str, sample: int) -> list[str]:
    """Words of the visible blocks of a hash sample of about ``sample`` different pages."""
    h = F.col(f"`{html_col}`").cast("string")
    n = pages.select(F.xxhash64(h).alias("x")).distinct().count()
    part = min(1 << 20, -(-sample * (1 << 20) // max(1, n)))
    rows = pages.select(h.alias("h")).where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < part).distinct().toPandas()
    paths = Paths()
    words = sorted({w for h in rows["h"].dropna() for b in leaf_blocks(h, paths) for w in b[1].split()})
    return words or DEFAULT_WORDS


def extract_text(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.weights, chain.moves, chain.start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = Chain(*shared.value)
        for b in batches:
            text = [chain.main_text(h) for h in b["h"]]
            yield pd.DataFrame({"page_id": b["i"].astype("Int64").array, "url": b["u"], "text": text, "n_chars": [len(x) for x in text]})

    picked = pages.selectExpr(f"cast(`{id_col}` as bigint) as i", f"cast(`{url_col}` as string) as u", f"cast(`{html_col}` as string) as h")
    return picked.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(labelled_pages(sample_words(pages, "html", SAMPLE))))
