"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, with the stack of open elements. A block's
features are its ancestors' tags and attribute words, its own text (length, links, punctuation) and its place. Two labels,
main text or not; weights of features and of neighbouring labels are fitted to labelled pages by the likelihood of whole
label sequences (forward and backward sums), and pages are decoded by Viterbi.

The labelled pages (PAGES of them, a bound) are made here from a rule: page parts of known kind, with and without telling
tags and attributes, in the order that pages have them. No page of the input is used for the fit.

Defined results: null and empty html and pages without main text give ""; text before any tag is a block of its own;
end tags without a start are ignored, elements left open end with what holds them; character references are decoded as
HTML does (also without a semicolon where HTML allows it); repeated rows are read each for itself.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import common

#: Labelled pages that the fit uses.
PAGES = 800
ROUNDS = 250

# Fixed values of HTML: elements that never have content, raw-text elements that aren't shown, block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template textarea select svg iframe head title audio video datalist".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these kinds, unless an element of the second set is open within it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

TAGS = "nav header footer aside form article main section ul ol li table td th h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption button label dl dt dd details dialog address menu fieldset search".split()
# Words of class, id and role attributes, by what they tell.
ATTRIBUTE_WORDS = {
    "advert": "ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "footer": "footer foot bottom copyright colophon legal contentinfo".split(),
    "header": "header masthead topbar top head branding logo".split(),
    "side": "sidebar side aside related widget rail recommended popular trending complementary".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy warning message".split(),
    "comments": "comment comments reply replies discussion disqus responses respond".split(),
    "share": "share sharing social follow meta byline tags".split(),
    "form": "form search login signup subscribe newsletter register contact".split(),
    "main": "article post entry content story body main text prose".split(),
}
_WORD_KIND = {w: kind for kind, words in ATTRIBUTE_WORDS.items() for w in words}
# How headings of reader comments, and notes of rights, begin or end.
COMMENT_CUES = ("comment", "comments", "leave a", "replies", "responses", "discussion", "join the", "kommentare", "commentaires", "comentarios")
RIGHTS_CUES = ("©", "copyright", "(c) ")
RIGHTS_ENDS = ("all rights reserved", "all rights reserved.", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados")
_TEXT = ["words<=3", "words<=8", "words<=20", "words<=50", "words>50", "links none", "links few", "links some", "links most", "stop", "comma", "capital", "copyright", "digits", "sign", "comments cue"]
_PLACE = ["first tenth", "last tenth", "before heading", "after heading", "after comments cue", "site heading"]
FEATURES = {name: i for i, name in enumerate(["bias", *(f"in {t}" for t in TAGS), *(f"is {t}" for t in [*TAGS, "other"]), *(f"told {k}" for k in ATTRIBUTE_WORDS), "article header", "alone", *_TEXT, *_PLACE])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "stack", "told", "links")

    def __init__(self, text: str, stack: tuple[str, ...], told: frozenset[str], links: int) -> None:
        self.text, self.stack, self.told, self.links = text, stack, told, links


def blocks(page: str) -> list[Block]:
    """The leaf blocks that a page shows, in page order."""
    out: list[Block] = []
    stack: list[str] = []
    told: list[frozenset[str]] = [frozenset()]
    text: list[str] = []
    links = unseen = anchors = 0

    def flush() -> None:
        nonlocal links
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            if whole:
                out.append(Block(whole, tuple(stack), told[-1], min(links, len(whole))))
            text.clear()
        links = 0

    def close(i: int) -> None:
        nonlocal unseen, anchors
        for t in stack[i:]:
            unseen -= t in UNSEEN
            anchors -= t == "a"
        del stack[i:], told[i + 1 :]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        to = m.start() if m else n
        if to > at and not unseen:
            text.append(page[at:to])
            links += (to - at) * (anchors > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                if tag in BLOCK:
                    flush()
                close(len(stack) - 1 - stack[::-1].index(tag))
            elif tag in ("p", "br"):
                flush() if tag == "p" else text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if "p" in stack and tag != "button":
                close(len(stack) - 1 - stack[::-1].index("p"))
            if tag in ENDS:
                ended, barrier = ENDS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in barrier:
                        break
                    if stack[i] in ended:
                        close(i)
                        break
        elif tag == "br" and not unseen:
            text.append(" ")
        if unseen and "head" in stack and tag not in HEAD:  # a head without its end tag ends here
            close(stack.index("head"))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        kinds = told[-1]
        if m[3]:
            for name, value in _ATTRIBUTE.findall(m[3]):
                kinds = kinds | {k for w in _NAME.findall(value.lower()) if (k := _WORD_KIND.get(w))} if name.lower() in ("class", "id", "role") else kinds
        stack.append(tag)
        told.append(kinds)
        unseen += tag in UNSEEN
        anchors += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out


def features(found: list[Block]) -> list[list[int]]:
    """The features that each block of a page has."""
    f, out = FEATURES, []
    heading = next((i for i, b in enumerate(found) if "h1" in b.stack and ("header" not in b.stack or "article" in b.stack or "main" in b.stack)), -1)
    cued = False
    for i, b in enumerate(found):
        own = [f["bias"], *(f[f"in {t}"] for t in set(b.stack) if t in _TAG_SET)]
        inner = next((t for t in reversed(b.stack) if t in BLOCK), "other")
        own.append(f[f"is {inner if inner in _TAG_SET else 'other'}"])
        own += [f[f"told {k}"] for k in b.told]
        if "header" in b.stack and "article" in b.stack[: b.stack.index("header")]:
            own.append(f["article header"])
        if not b.told and inner in ("other", "div", "body"):
            own.append(f["alone"])
        words, linked, t = b.text.count(" ") + 1, b.links / len(b.text), b.text
        own.append(f["words<=3" if words <= 3 else "words<=8" if words <= 8 else "words<=20" if words <= 20 else "words<=50" if words <= 50 else "words>50"])
        own.append(f["links none" if not linked else "links few" if linked < 0.3 else "links some" if linked < 0.7 else "links most"])
        low = t[:60].lower()
        rights = low.startswith(RIGHTS_CUES) or t[-40:].lower().endswith(RIGHTS_ENDS)
        cue = words <= 5 and low.lstrip("0123456789 (").startswith(COMMENT_CUES) and "article" not in b.stack
        own += [f[name] for name, holds in (("stop", t[-1] in ".!?…:\"”»"), ("comma", "," in t), ("capital", t[0].isupper()), ("copyright", rights), ("comments cue", cue), ("digits", t[0].isdigit()), ("sign", "|" in t or "»" in t or "@" in t)) if holds]
        own += [f[name] for name, holds in (("first tenth", i * 10 < len(found)), ("last tenth", (i + 1) * 10 > len(found) * 9), ("before heading", i < heading), ("after heading", 0 <= heading < i), ("after comments cue", cued), ("site heading", "h1" in b.stack and "header" in b.stack and "article" not in b.stack)) if holds]
        cued = cued or cue
        out.append(own)
    return out


_TAG_SET = frozenset(TAGS)


def labelled_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks (1: main text)."""
    r = random.Random(seed)
    syllables = "an be ca do el fi go ha in ka lo me no or pa ra so te un we".split()

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def sentence(low: int = 4, high: int = 18) -> str:
        w = [word() for _ in range(r.randint(low, high))]
        if len(w) > 6 and r.random() < 0.7:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + r.choice("....?!")

    def prose() -> str:
        """Mostly sentences; some text without capitals or stops, of figures, or of few words."""
        style = r.random()
        if style < 0.6:
            return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))
        if style < 0.8:
            return " ".join(word() for _ in range(r.choice((1, 1, 2, 2, 3, 4, 12, 60))))
        if style < 0.95:
            return r.choice((" | ", " » ", " - ", "@")).join(word() for _ in range(r.choice((2, 5, 20))))
        return " ".join(str(r.randint(0, 9999)) for _ in range(r.choice((1, 3, 9))))

    def links(n: int) -> list[str]:
        return [f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a>' for _ in range(n)]

    def part(tag: str, kind: str, inner: list[str], told: float = 0.75) -> tuple[str, int]:
        plain = r.random() < 0.5
        attribute = f' {r.choice(("class", "id"))}="{r.choice(ATTRIBUTE_WORDS[kind])}{r.choice(("", "-box", " wide", "_1"))}"' if kind and (plain or r.random() < told) else ""
        return f"<{'div' if plain else tag}{attribute}>{''.join(inner)}</{'div' if plain else tag}>", len(inner)

    def junk(where: str) -> tuple[str, int]:
        pick = r.choice({"top": ["menu", "header", "notice", "advert", "form"], "in": ["advert", "share", "form", "side"], "end": ["side", "comments", "footer", "advert", "notice", "menu", "form", "share"]}[where])
        if pick == "menu":
            return _menu("nav", "menu")
        if pick == "header":
            name = " ".join(word() for _ in range(r.randint(1, 3))).title()
            top = r.choice([f"<div>{name}</div>", f"<h1>{name}</h1>", f'<a href="/">{name}</a>', f"<p>{name}</p>"])
            return part("header", "header", [top, *([f"<p>{sentence(2, 5)}</p>"] if not top.startswith("<a") else [])])
        if pick == "notice":
            return part("aside", "notice", [f"<p>{sentence()}</p>", f"<button>{word()}</button>"], 1)
        if pick == "advert":
            return part("aside", "advert", [f"<p>{sentence(3, 12)}</p>"] if r.random() < 0.5 else [sentence(3, 12)], 1)
        if pick == "form":
            return part("form", "form", [f"<label>{word()}</label>", f"<button>{word()}</button>"], 1)
        if pick == "side":
            return part("aside", "side", [f"<h3>{word()}</h3>", *(f"<p>{x}</p>" for x in links(3)), f"<p>{sentence()}</p>"], 1)
        if pick == "comments" and r.random() < 0.4:  # without telling tags or attributes but for its heading
            cue = r.choice(["Comments", "{} comments", "Leave a reply", "Discussion", "Comments ({})"]).format(r.randint(1, 99))
            rows = [r.choice(["<div>{}</div>", "<div><p>{}</p></div>", "<p>{}</p>"]).format(f"{word()}: {prose()}" if r.random() < 0.5 else prose()) for _ in range(r.randint(1, 5))]
            return f"<div><{(t := r.choice(('h2', 'h3', 'p')))}>{cue}</{t}>{''.join(rows)}</div>", 1 + len(rows)
        if pick == "comments":
            return part("section", "comments", [f"<h3>{word()}</h3>", *(f"<p>{prose()}</p>" for _ in range(r.randint(1, 5)))], 1)
        if pick == "share":
            return part("div", "share", [f"<span>{' '.join(links(3))}</span>"], 1)
        if r.random() < 0.35:
            note = r.choice(["Copyright {} {}. All rights reserved.", "&copy; {} {}", "(c) {} {}, all rights reserved", "{} {}. All rights reserved."]).format(r.randint(1990, 2026), word().title())
            return r.choice(["<div>{}</div>", "<div><p>{}</p></div>", "<p>{}</p>"]).format(note), 1
        return part("footer", "footer", [f"&copy; {word()}.example &middot; {sentence(3, 9)}"] if r.random() < 0.6 else [f"<p>&copy; {word()}</p>", f"<p>{' '.join(links(4))}</p>"])

    def _menu(tag: str, kind: str) -> tuple[str, int]:
        items = links(r.randint(2, 7))
        return part(tag, kind, ["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"])[0], len(items)

    def article() -> list[tuple[str, int]]:
        out = [(f"<h1>{sentence(3, 9)[:-1]}</h1>", 1)]
        for _ in range(r.randint(1, 9)):
            kind = r.choice(["p"] * 9 + ["h2", "ul", "quote", "bare", "table", "pre"])
            if r.random() < 0.04:  # a licence line of the text itself
                out.append((f"<p>{r.choice(('All rights reserved.', f'Copyright {word()}.', f'© {word()}. All rights reserved.'))}</p>", 1))
            if kind == "ul":
                n = r.randint(2, 4)
                out.append(("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(n)) + "</ul>", n))
            elif kind == "table":
                out.append((f"<table><tr><td>{word()}</td><td>{sentence(2, 5)}</td></tr></table>", 2))
            elif kind == "p":
                out.append((r.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div><p>{}</p></div>"]).format(prose() + (f" {links(1)[0]} {word()}." if r.random() < 0.15 else "")), 1))
            else:
                out.append(({"h2": "<h2>{}</h2>", "quote": "<blockquote>{}</blockquote>", "bare": "<div>{}</div>", "pre": "<pre>{}</pre>"}[kind].format(sentence(2, 7) if kind == "h2" else prose()), 1))
        return out

    pages = []
    for _ in range(count):
        body, labels = "", []
        for where in ["top"] * r.randint(0, 3):
            x, n = junk(where)
            body, labels = body + x, labels + [0] * n
        opening, closing = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<div>", "</div>"), ("", "")])
        body += opening
        for x, n in article():
            body, labels = body + x, labels + [1] * n
            if r.random() < 0.06:
                x, n = junk("in")
                body, labels = body + x, labels + [0] * n
        body += closing
        for where in ["end"] * r.randint(1, 4):
            x, n = junk(where)
            body, labels = body + x, labels + [0] * n
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
        if len(blocks(page)) == len(labels):  # else parts flow into one another and have no one label
            pages.append((page, labels))
    return pages


class Chain:
    """Weights of features for main text (against not) and of pairs of labels."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition

    @classmethod
    def fit(cls, pages: list[tuple[str, list[int]]], rounds: int = ROUNDS, rate: float = 0.15, decay: float = 1e-4) -> Chain:
        """Gradient ascent (with moments) on the mean log-likelihood of the label sequences."""
        rows = [features(blocks(p)) for p, _ in pages]
        n, longest = len(rows), max(map(len, rows))
        x, y, live = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (row, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
            for j, own in enumerate(row):
                x[i, j, own] = 1
            y[i, : len(labels)], live[i, : len(row)] = labels, True
        size = len(FEATURES)
        w, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
        total = live.sum()
        pairs = live[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        target = np.concatenate([np.einsum("ijk,ij->k", x, (y * live).astype(float)), seen.ravel()])
        for step in range(1, rounds + 1):
            score = np.stack([np.zeros((n, longest)), x @ w[:size]], axis=2)
            t = w[size:].reshape(2, 2)
            ahead, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            ahead[:, 0] = score[:, 0]
            for j in range(1, longest):
                moved = np.logaddexp.reduce(ahead[:, j - 1, :, None] + t, axis=1) + score[:, j]
                ahead[:, j] = np.where(live[:, j, None], moved, ahead[:, j - 1])
            whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
            for j in range(longest - 2, -1, -1):
                moved = np.logaddexp.reduce(t + (score[:, j + 1] + back[:, j + 1])[:, None, :], axis=2)
                back[:, j] = np.where(live[:, j + 1, None], moved, back[:, j + 1])
            p = np.exp(ahead + back - whole[:, None, None])[:, :, 1] * live
            both = np.exp(ahead[:, :-1, :, None] + t + (score + back)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
            gradient = (target - np.concatenate([np.einsum("ijk,ij->k", x, p), both.sum(axis=(0, 1)).ravel()])) / total - decay * w
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(w[:size], w[size:].reshape(2, 2))

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels of one page's blocks."""
        if not rows:
            return []
        (stay, enter), (leave, remain) = self.transition.tolist()
        w, back = self.emission, []
        a = b = 0.0
        for i, own in enumerate(rows):
            e = float(w[own].sum())
            if i:
                from_b, from_a = b + leave > a + stay, a + enter > b + remain
                a, b = (b + leave if from_b else a + stay), (a + enter if from_a else b + remain) + e
                back.append((int(from_b), int(not from_a)))
            else:
                b = e
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return " ".join([b.text for b, label in zip(found, chain.decode(features(found)), strict=True) if label])


def extract(pages: DataFrame, html_column: str = "html", chain: Chain | None = None, into: str = "text") -> DataFrame:
    """pages without the html column, with the main text in the column `into` (one of that name is replaced)."""
    spark = pages.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(chain or Chain.fit(labelled_pages()))
    kept = [f for f in pages.schema.fields if f.name not in (html_column, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "__umbra_html"):
            texts = [main_text(x, shared.value) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], into])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{into}` string"
    return pages.select(*[f"`{f.name}`" for f in kept], F.col(html_column).cast("string").alias("__umbra_html")).mapInArrow(common.lean(run), schema)


def op7_crf_main_text(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
