"""Main text of web pages: a linear-chain conditional random field over the pages' leaf blocks, decoded by Viterbi.

A leaf block is a run of text between block-level tags; its features are the tags, class and id words of its ancestors and
the shape of its text (length, links, punctuation, typical words). The field has two labels, main text and the
rest; its weights are fitted in numpy by gradient ascent of the likelihood (forward-backward over all training pages at once). The
training pages are labelled: article bodies, taken from at most ``limit`` pages with an article element or made up, are set into many
layouts whose menus, notices, adverts, forms, comments and footers are known.

White space within a block becomes one space and character references are decoded; the main blocks are joined in page order by line feeds.
A null or empty page, or one without main blocks, has an empty text. Scripts, styles, comments and unclosed or stray tags are no
text. Null ids pass through, repeated rows are extracted each; an empty table gives an empty result. Pages of any length are read
whole. Only the id, url and html columns are read, so others may have any name.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_text

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea svg math".split())
#: an opening tag of the first kind ends an open element of the second
ENDS_BEFORE = {t: ("p",) for t in BLOCK_TAGS} | {
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",)}
#: implied ends don't reach beyond these
WALLS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}

#: innermost ancestors that a block keeps
DEPTH = 64

_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
#: a tag of any length; only a quote after an equals sign opens a value, and its closing quote ends it
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=>/"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
_WORDS = re.compile(r"[a-z]+")

#: class and id words by what they say; part of a word is enough from four letters on
HINTS = {
    "content": "article content post entry story body main text prose maintext copy",
    "menu": "nav menu navbar breadcrumb breadcrumbs toc tabs pagination pager skip",
    "head": "header masthead topbar logo brand banner hero",
    "foot": "footer foot copyright legal colophon credits",
    "side": "sidebar aside side widget related recommended trending popular more rail",
    "advert": "ad ads advert advertisement sponsor sponsored promo adsense adslot",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall subscribe newsletter signup",
    "comment": "comment comments reply replies respond discussion disqus thread reader readers",
    "share": "share social follow twitter facebook tags meta",
    "form": "form search login input contact poll",
}
_HINT_OF = {w: name for name, words in HINTS.items() for w in words.split()}
_PHRASES = {
    "rights": re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved", re.I),
    "cookie": re.compile(r"\bcookies?\b|privacy policy|terms of (?:use|service)", re.I),
    "action": re.compile(r"^(?:read more|share|subscribe|sign up|log ?in|menu|search|home|reply|advertisement|sponsored|next|previous|skip to)\b", re.I),
}


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, attribute words) from the outside in, the innermost DEPTH
    linked: int                        # characters inside links


def _named(attributes: str) -> str:
    """The values of class, id and role."""
    return " ".join(a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role")).lower()


class _Tags:
    """The comments, declarations and tags of a page, asked for in order.

    A tag whose quotes don't close before the page ends reaches up to the next angle bracket, and so do those after it,
    so no part of a page is searched again and again."""

    def __init__(self, source: str):
        self.source, self.pattern, self.ends = source, _TAG, True

    def after(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """Start and end of the first from ``at`` on, with the match if it is a tag."""
        source = self.source
        while m := _OPENING.search(source, at):
            start, at = m.span()
            if m[0] == "<!--":
                end = source.find("-->", at)
                return start, end + 3 if end >= 0 else len(source), None
            if self.ends and m[0] in ("<!", "<?"):
                end = source.find(">", at)
                if end >= 0:
                    return start, end + 1, None
            elif self.ends:
                tag = self.pattern.match(source, start)
                if not tag:
                    self.pattern = _PLAIN_TAG
                    tag = self.pattern.match(source, start)
                if tag:
                    return start, tag.end(), tag
            self.ends = False  # no bracket is left
        return None


def leaf_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, by a tolerant walk over its tags."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = linked = 0
    source = page or ""
    lower = None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(markup.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, tuple(stack[-DEPTH:]), min(linked, len(text))))
            parts.clear()
        linked = 0

    at, tags = 0, _Tags(source)
    while at < len(source):
        found = tags.after(at)
        piece = source[at:found[0]] if found else source[at:]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not found:
            break
        _, at, m = found
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in RAW_TAGS:
            lower = lower or source.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(source) else source.find(f"</{tag}", at)
            at = len(source) if end < 0 else end
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends, walls = ENDS_BEFORE[tag], WALLS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name in ends:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                elif name in walls or name in BLOCK_TAGS and name not in ("p",):
                    break
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            if tag != "a":
                words = _named(m[3])
            else:
                words, links = "", links + 1
            stack.append((tag, words))
    flush()
    return blocks


def _path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    found = {f"in {tag}" for tag, _ in path if tag in BLOCK_TAGS and tag not in ("html", "body", "div")}
    for _, attribute in path:
        for word in _WORDS.findall(attribute):
            hint = _HINT_OF.get(word) or next((h for w, h in _HINT_OF.items() if len(w) > 3 and w in word), None)
            if hint:
                found.add(f"hint {hint}")
    parent = next((t for t, _ in reversed(path) if t in BLOCK_TAGS), "none")
    inside = any(f in found for f in ("in article", "in main", "hint content"))
    against = any(f in found for f in _AGAINST)
    found.update((f"parent {parent}", f"inside {inside} against {against}", f"inside {inside} against {against} parent {parent}"))
    return sorted(found)


_AGAINST = frozenset("in nav,in header,in footer,in aside,in form,in head,in button,in label,in select".split(",")) | {
    f"hint {name}" for name in HINTS if name != "content"}


def _step(value: float, *edges: float) -> int:
    return sum(value >= e for e in edges)


def _text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    found = ["bias", f"words {_step(words, 3, 8, 20, 50)}", f"links {_step(share, 0.01, 0.3, 0.7)}",
             "stop" if text[-1] in ".!?:;…\"”)" else "no stop", f"commas {_step(text.count(','), 1, 3)}"]
    found += [f"says {name}" for name, phrase in _PHRASES.items() if phrase.search(text[:300])]
    return found


@dataclass
class Field:
    """Weights: ``unary[name]`` for (rest, main), and ``step[from, to]``, with ``first`` for the start of a page."""
    unary: dict[str, tuple[float, float]]
    step: np.ndarray
    first: np.ndarray
    _paths: dict = field(default_factory=dict, repr=False)

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        get, none = self.unary.get, (0.0, 0.0)
        for i, block in enumerate(blocks):
            base = self._paths.get(block.path)
            if base is None:
                if len(self._paths) > 20_000:
                    self._paths.clear()
                known = [get(f, none) for f in _path_features(block.path)]
                base = self._paths[block.path] = (sum(a for a, _ in known), sum(b for _, b in known))
            rest, main = base
            for f in _text_features(block):
                a, b = get(f, none)
                rest, main = rest + a, main + b
            out[i] = rest, main
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels."""
        (a0, a1), (b0, b1) = self.step.tolist()
        best0, best1 = (scores[0] + self.first).tolist()
        back = []
        for s0, s1 in scores[1:].tolist():
            from0, from1 = best1 + b0 > best0 + a0, best1 + b1 > best0 + a1
            back.append((from0, from1))
            best0, best1 = s0 + (best1 + b0 if from0 else best0 + a0), s1 + (best1 + b1 if from1 else best0 + a1)
        labels = [int(best1 > best0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        return "\n".join(b.text for b, y in zip(blocks, self.viterbi(self.scores(blocks))) if y)


def fit_field(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.3, penalty: float = 0.1) -> Field:
    """Maximum likelihood with a Gaussian penalty, by Adam; forward and backward run over all pages at once."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in _path_features(b.path) + _text_features(b)]
             for b in blocks] for blocks, _ in pages]
    n, length = len(pages), max(len(b) for b, _ in pages)
    x = np.zeros((n, length, len(names)), dtype=np.float32)
    y = np.zeros((n, length), dtype=int)
    mask = np.zeros((n, length))
    for p, (blocks, labels) in enumerate(pages):
        for i, row in enumerate(rows[p]):
            x[p, i, row] = 1
        y[p, :len(labels)], mask[p, :len(labels)] = labels, 1
    flat = x.reshape(n * length, -1)
    truth = np.eye(2)[y] * mask[..., None]
    pairs = np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:])
    w, step, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, step, first)]
    for r in range(1, rounds + 1):
        unary = (flat @ w.astype(np.float32)).reshape(n, length, 2).astype(float)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = unary[:, 0] + first
        for t in range(1, length):
            moved = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + unary[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, moved, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = unary[:, t + 1] + behind[:, t + 1]
            moved = np.logaddexp(nxt[:, :1] + step[:, 0], nxt[:, 1:] + step[:, 1])
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, moved, behind[:, t + 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        node = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + step + (unary + behind)[:, 1:, None, :] - total[:, None, None, None])
        edge = (edge * mask[:, 1:, None, None]).sum(axis=(0, 1))
        gradients = (flat.T @ (truth - node).reshape(n * length, 2).astype(np.float32) - penalty * w,
                     pairs - edge - penalty * step, (truth[:, 0] - node[:, 0]).sum(axis=0) - penalty * first)
        for value, gradient, m in zip((w, step, first), gradients, moments):
            m[0] = 0.9 * m[0] + 0.1 * gradient
            m[1] = 0.99 * m[1] + 0.01 * gradient**2
            value += rate * (1 - r / rounds * 0.9) * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, step, first)


#: stands before text that is main text in a training page
MARK = ""
_MARKED_TAG = re.compile(r"(<(?:p|h[1-6]|li|td|blockquote|pre|figcaption)\b[^>]*>)", re.I)


def labelled(page: str) -> tuple[list[Block], list[int]]:
    blocks = leaf_blocks(page)
    labels = [int(MARK in b.text) for b in blocks]
    return [Block(b.text.replace(MARK, "").strip() or "-", b.path, b.linked) for b in blocks], labels


def layout(body: str, rng: np.random.Generator, words: list[str]) -> str:
    """A page in a random layout around ``body``, whose block tags get marks."""
    def say(low: int, high: int) -> str:
        return " ".join(rng.choice(words, rng.integers(low, high + 1))).capitalize()

    def sentence() -> str:
        return " ".join(re.sub(" ", lambda m: m[0] if rng.random() < .85 else ", ", say(1, 18)) + rng.choice([".", ".", ".", "!", "?", ""])
                        for _ in range(rng.integers(1, 5)))

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def links(tag: str, k: int) -> str:
        return "".join(f'<{tag}><a href="/{i}">{say(1, 3)}</a></{tag}>' for i in range(k))

    def maybe(chance: float, text: str) -> str:
        return text if rng.random() < chance else ""

    def named(kind: str) -> str:
        return f'{pick("class", "id")}="{pick(*HINTS[kind].split()[:7])}{pick("", "-1", "-box", " wide", "_inner")}"'

    body = _MARKED_TAG.sub(lambda m: m[1] + MARK, body)
    opened, closed = [("<article>", "</article>"), ("<main>", "</main>"), (f"<div {named('content')}>", "</div>"),
                      (f"<article><section {named('content')}>", "</section></article>"), (f"<section {named('content')}>", "</section>"),
                      (f"<main><article {named('content')}>", "</article></main>")][int(rng.choice(6, p=[.4, .1, .2, .1, .1, .1]))]
    menu = pick(f"<nav><ul>{links('li', 5)}</ul></nav>", f"<div {named('menu')}>{links('span', 4)}</div>", f"<ul {named('menu')}>{links('li', 6)}</ul>")
    head = pick("", f"<header><div {named('head')}>{say(1, 4)}</div>{menu}</header>", f"<div {named('head')}><h2>{say(1, 4)}</h2></div>{menu}", menu)
    advert = pick(f"<div {named('advert')}>{sentence()}</div>", f"<aside {named('advert')}><p>{sentence()}</p></aside>", f"<div class=\"ad\">{sentence()}</div>")
    notice = pick(f"<div {named('notice')}><p>We use cookies. {sentence()}</p><button>OK</button></div>", f"<div {named('notice')}>{sentence()}</div>")
    side = pick(f"<aside><h3>{say(1, 3)}</h3><ul>{links('li', 4)}</ul></aside>", f"<div {named('side')}><h4>{say(1, 3)}</h4><p>{sentence()}</p>{links('p', 3)}</div>",
                f"<aside><p>{sentence()}</p></aside>")
    form = pick(f"<form><label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button></form>", f"<form {named('form')}><p>{sentence()}</p><select><option>{say(1, 2)}"
                f"<option>{say(1, 2)}</select></form>")
    comments = "".join(f"<{t} {named('comment')}><p>{say(1, 2)}</p><p>{sentence()}</p></{t}>" for t in [pick("div", "li", "article")] * int(rng.integers(1, 4)))
    comments = f"<{pick('section', 'div')} {named('comment')}><h3>{say(1, 2)}</h3>{comments}</div>"
    comments = comments.replace("</div>", "</section>") if comments.startswith("<section") and comments.count("<div") == 0 else comments
    share = f"<div {named('share')}>{links('span', 3)}</div>"
    foot = pick(f"<footer>&copy; {say(1, 2)} &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p>{links('span', 3)}</footer>",
                f"<div {named('foot')}>{pick('Copyright 2020', '&copy;')} {say(2, 6)}</div>")
    inside = opened + maybe(.15, share) + body + maybe(.15, share) + maybe(.12, comments) + maybe(.08, advert) + closed
    around = [maybe(.4, advert), inside, maybe(.3, share), maybe(.3, comments), maybe(.25, form)]
    return (f"<html><head><title>{say(2, 6)}</title><style>p{{}}</style></head><body>{maybe(.3, notice)}{head}{maybe(.25, form)}"
            f"{maybe(.3, side)}{''.join(around)}{maybe(.4, side)}{maybe(.2, notice)}{maybe(.9, foot)}</body></html>")


def made_up_body(rng: np.random.Generator, words: list[str]) -> str:
    def sentences(k: int) -> str:
        return " ".join((", " if rng.random() < .3 else " ").join(rng.choice(words, rng.integers(1, 16))).capitalize() + rng.choice([".", ".", ".", ""])
                        for _ in range(k))

    parts = [f"<h1>{' '.join(rng.choice(words, rng.integers(2, 9))).capitalize()}</h1>"]
    for _ in range(int(rng.integers(2, 9))):
        kind = rng.random()
        parts.append(f"<h2>{' '.join(rng.choice(words, rng.integers(1, 6))).capitalize()}</h2>" if kind < .1 else
                     "<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(3)) + "</ul>" if kind < .16 else
                     f"<blockquote>{sentences(2)}</blockquote>" if kind < .2 else
                     f"<table><tr><td>{sentences(1)}</td><td>{sentences(1)}</td></tr></table>" if kind < .23 else
                     f"<p>{sentences(1)} <a href='/x'>{rng.choice(words)}</a> {sentences(1)}</p>" if kind < .35 else
                     f"<p>{sentences(int(rng.integers(1, 6)))}</p>")
    return "".join(parts)


_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article>", re.S | re.I)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = 200, made_up: int = 400, seed: int = 11) -> Field:
    """The field, fitted on pages in random layouts around the articles of at most ``limit`` pages (chosen by a hash of their ids, up to
    20,000 characters each) and ``made_up`` bodies."""
    ids = pages.select(F.col(id_col).alias("i")).dropna().distinct().orderBy(F.xxhash64("i"), "i").limit(limit)
    found = (pages.select(F.col(id_col).alias("i"), F.substring(html_col, 1, 20_000).alias("h")).dropna()
             .join(F.broadcast(ids), "i").orderBy("i", "h").limit(limit).collect())
    return fit_on([m[1] for r in found if (m := _ARTICLE.search(r["h"]))], made_up, seed)


def fit_on(bodies: list[str], made_up: int = 400, seed: int = 11) -> Field:
    rng = np.random.default_rng(seed)
    parts = "the an on re er st ti en al ou ing th es or ha wh ly ion ble ea".split()
    words = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(600)]
    bodies = [*bodies, *(made_up_body(rng, words) for _ in range(made_up))]
    training = [labelled(layout(b, rng, words)) for b in bodies]
    return fit_field([(b[:200], y[:200]) for b, y in training if b])


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (the main text), n_chars (its code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make(htmls):
        held = shared.value
        texts = [held.main_text(h) for h in htmls]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    keyed = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("key"), F.col(html_col).alias("html"))
    return per_text(keyed, "key", "html", "text string, n_chars long", make).select("doc_id.page_id", "doc_id.url", "text", "n_chars")
