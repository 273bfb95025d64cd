"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

import random
import re
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.dom import Block, blocks

TRAINING_PAGES = 500
KNOWN_CONTEXTS = 1 << 14

TAGS = (
    "article main section nav header footer aside form ul ol dl li table td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 p div "
    "button label select dialog details address fieldset body noscript iframe textarea"
).split()
#: Words of classes, ids and roles, by what authors name with them.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar tabs toc pagination pager skip sitemap toolbar",
    "footer": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more teaser teasers complementary rail promoted",
    "advert": "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion commercial partner adbox adslot",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses feedback reader readers reactions",
    "notice": "cookie cookies consent notice notices gdpr privacy popup modal overlay alert alerts newsletter subscribe subscription signup paywall warning message toast dialog announcement",
    "header": "header masthead head top logo brand branding sitehead tagline banner",
    "form": "form search searchbox login signin register input contact field",
    "share": "share sharing social follow tags tag meta byline author date published timestamp category categories",
    "content": "content article post entry story main body text page prose articlebody mainbody markdown",
}
_NAMED = {w: g for g, words in NAMES.items() for w in words.split()}
_GROUPS = list(NAMES)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_DIGIT = re.compile(r"\d")
_N_CONTEXT = 2 * len(TAGS) + len(_GROUPS) + 4
_LENGTHS, _LINKS = (1, 2, 4, 8, 16, 32, 64), (0.0, 0.25, 0.6, 0.9)
_N_TEXT = len(_LENGTHS) + 1 + len(_LINKS) + 1 + 8
N_FEATURES = _N_CONTEXT + _N_TEXT + 1


def _context(block: Block) -> list[int]:
    """Features of the elements around a block: which there are, which is nearest, what they are named, how deep."""
    tags = [t for t in block.path if t in _TAG_AT]
    found = {_TAG_AT[t] for t in tags}
    if tags:
        found.add(len(TAGS) + _TAG_AT[tags[-1]])
    at = 2 * len(TAGS)
    found |= {at + _GROUPS.index(_NAMED[n]) for n in block.names if n in _NAMED}
    at += len(_GROUPS)
    inside = "article" in tags or "main" in tags
    found.add(at + (0 if not inside else 1 if tags[-1] in ("p", "li", "blockquote", "pre", "td") else 2))
    if block.hidden:
        found.add(at + 3)
    return sorted(found)


def _text(block: Block) -> list[int]:
    """Features of a block's text: length, links, and how it ends and begins."""
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    at = _N_CONTEXT
    found = [at + sum(words > n for n in _LENGTHS)]
    at += len(_LENGTHS) + 1
    found.append(at + sum(share > s for s in _LINKS))
    at += len(_LINKS) + 1
    tests = (
        text[-1] in ".!?…。\"'”»)", "," in text, "©" in text or "(c)" in text, text[0].islower(), text.isupper(), bool(_DIGIT.search(text)),
        "|" in text or "·" in text or "»" in text, ". " in text,
    )
    return found + [at + i for i, t in enumerate(tests) if t]


def features(page: list[Block], known: dict | None = None) -> list[list[int]]:
    """Indices of each block's features; those of equal surroundings are kept in ``known``."""
    known = {} if known is None else known
    out = []
    for block in page:
        key = (block.path, block.names, block.hidden)
        if key not in known:
            if len(known) > KNOWN_CONTEXTS:
                known.clear()
            known[key] = _context(block)
        out.append([*known[key], *_text(block), N_FEATURES - 1])
    return out


@dataclass
class Field:
    """Weights of a block's features for main text, and of neighbouring labels; label 1 is main text."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not rows:
            return []
        w = self.weights
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one = self.start.tolist()
        back = []
        for i, row in enumerate(rows):
            score = float(w[row].sum())
            if i:
                from_one_0, from_one_1 = one + m10 > zero + m00, one + m11 > zero + m01
                zero, one = (one + m10 if from_one_0 else zero + m00), (one + m11 if from_one_1 else zero + m01)
                back.append((int(from_one_0), int(from_one_1)))
            one += score
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def trained(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1, penalty: float = 2e-3) -> Field:
    """Weights of the largest penalised likelihood of labelled pages, by gradient steps over exact forward-backward sums."""
    n, longest = len(pages), max(len(rows) for rows, _ in pages)
    rows = [(p, t, f) for p, (page, _) in enumerate(pages) for t, row in enumerate(page) for f in row]
    at = np.array([p * longest + t for p, t, _ in rows])
    feature = np.array([f for *_, f in rows])
    live = np.zeros((n, longest), bool)
    truth = np.zeros((n, longest), int)
    for p, (page, labels) in enumerate(pages):
        live[p, : len(page)] = True
        truth[p, : len(page)] = labels
    pairs = live[:, 1:]
    theta = np.zeros(N_FEATURES + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    total = live.sum()
    for step in range(1, rounds + 1):
        w, moves, start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[N_FEATURES + 4 :]
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(at, w[feature], n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            x = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None], x, ahead[:, t - 1])
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            x = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(live[:, t + 1, None], x, 0)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * live
        gradient = np.zeros_like(theta)
        gradient[:N_FEATURES] = np.bincount(feature, (truth * live - one).ravel()[at], N_FEATURES)
        joint = np.exp(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        for a in (0, 1):
            for b in (0, 1):
                seen = ((truth[:, :-1] == a) & (truth[:, 1:] == b) & pairs).sum()
                gradient[N_FEATURES + 2 * a + b] = seen - (joint[:, :, a, b] * pairs).sum()
        gradient[N_FEATURES + 5] = truth[:, 0].sum() - one[:, 0].sum()
        gradient[N_FEATURES + 4] = -gradient[N_FEATURES + 5]
        gradient = gradient / total - penalty * theta / 10
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:N_FEATURES].copy(), theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), theta[N_FEATURES + 4 :].copy())


class Author:
    """Writes labelled pages: articles of many layouts among the things that surround articles, words invented."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.parts: list[tuple[str, int | None]] = []

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice(("ba", "ent", "lo", "ri", "sch", "ué", "tion", "na", "o", "der", "ist", "qu", "ä", "mo", "th")) for _ in range(r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return escape(" ".join(self.word() for _ in range(self.rng.randint(lo, hi))))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.rng.choice(("." * 6) + "!?,") for _ in range(self.rng.randint(lo, hi)))

    def markup(self, s: str) -> None:
        self.parts.append((s, None))

    def text(self, s: str, label: int) -> None:
        self.parts.append((s, label))

    def wrap(self, tags: tuple[str, ...], names: str, inside, given: float = 0.8) -> None:
        """Inside an element of one of the kinds; a plain division always bears a name."""
        tag = self.rng.choice(tags)
        named = tag == "div" or self.rng.random() < given
        key = self.rng.choice(("class", "id", "class", "role" if tag != "div" else "class"))
        name = self.rng.choice(NAMES[names].split()) if names else ""
        name = self.rng.choice((name, name, f"{name}-{self.rng.choice(('box', 'wrap', 'list', 'x1'))}", f"site-{name}"))
        away = self.hiding() if names in ("notice", "menu", "advert") and self.rng.random() < 0.15 else ""
        self.markup(f'<{tag} {key}="{name}"{away}>' if named and names else f"<{tag}{away}>")
        inside()
        self.markup(f"</{tag}>")

    def hiding(self) -> str:
        """An attribute that hides an element."""
        return self.rng.choice((" hidden", ' aria-hidden="true"', ' style="display:none"', ' style="visibility: hidden"'))

    def links(self, lo: int = 2, hi: int = 9) -> None:
        listed = self.rng.random() < 0.7
        self.markup("<ul>" if listed else "")
        for _ in range(self.rng.randint(lo, hi)):
            self.markup("<li>" if listed else "<div>")
            self.text(f'<a href="/{self.word()}">{self.words(1, 4)}</a>', 0)
            self.markup("</li>" if listed else "</div>")
        self.markup("</ul>" if listed else "")

    def lines(self, label: int, lo: int = 1, hi: int = 3, sentences=(1, 3)) -> None:
        for _ in range(self.rng.randint(lo, hi)):
            tag = self.rng.choice(("p", "p", "div", "span"))
            self.markup(f"<{tag}>")
            self.text(self.sentences(*sentences), label)
            self.markup(f"</{tag}><br>")

    def comments(self) -> None:
        self.markup("<h3>")
        self.text(self.words(1, 3), 0)
        self.markup("</h3>")
        for _ in range(self.rng.randint(1, 5)):
            tag = self.rng.choice(("li", "div", "article", "p"))
            self.markup(f"<{tag}{self.rng.choice(('', ' class=comment', ' class=reply'))}>")
            self.text(self.sentences(1, 4), 0)
            self.markup(f"</{tag}>")

    def form(self) -> None:
        self.markup("<form><label>")
        self.text(self.words(1, 4), 0)
        self.markup('</label><input name="q"><select><option>')
        self.text(self.words(1, 2), 0)
        self.markup("<option>")
        self.text(self.words(1, 2), 0)
        self.markup("</select><button>")
        self.text(self.words(1, 2), 0)
        self.markup("</button></form>")

    def foot(self) -> None:
        if self.rng.random() < 0.5:
            self.links(1, 5)
        self.markup("<p>" if self.rng.random() < 0.3 else "")
        self.text(self.rng.choice(("&copy; ", "&copy; 2020 ", "")) + self.word() + self.rng.choice((".example &middot; ", " | ", ": ")) + self.sentences(1, 2), 0)

    def paragraph(self) -> None:
        r = self.rng
        kind = r.random()
        if kind < 0.72:
            self.markup("<p>")
            if r.random() < 0.25:
                self.markup(r.choice(("<b>", "<b>", "<em>")))
                self.text(self.sentences(1, 2), 1)
                self.markup(r.choice(("</b>", "</em>", "", "")) + "<br>")
            link = f' <a href="/x">{self.words(1, 3)}</a> ' if r.random() < 0.25 else " "
            link += f"<math><mi>{self.word()}</mi><mo>=</mo><mn>2</mn></math> " if r.random() < 0.03 else ""
            self.text(self.sentences(1, 6) + link + self.sentences(0, 3), 1)
            self.markup("</p>" if r.random() < 0.8 else "")
        elif kind < 0.8:
            self.markup("<h2>" if r.random() < 0.6 else "<h3>")
            self.text(self.words(1, 7), 1)
            self.markup("</h2></h3>")
        elif kind < 0.87:
            self.markup("<ul>")
            for _ in range(r.randint(1, 5)):
                self.markup("<li>")
                self.text(self.words(1, 14), 1)
                self.markup("</li>")
            self.markup("</ul>")
        elif kind < 0.92:
            self.markup("<blockquote>" + r.choice(("", "<p>")))
            self.text(self.sentences(1, 3), 1)
            self.markup("</blockquote>")
        elif kind < 0.95:
            self.markup("<pre>")
            self.text(self.words(3, 20), 1)
            self.markup("</pre>")
        elif kind < 0.98:
            self.markup("<table><tr>")
            for _ in range(r.randint(1, 6)):
                self.markup("<td>")
                self.text(self.words(1, 5), 1)
                self.markup("</td>")
            self.markup("</tr></table>")
        else:
            self.markup("<figure><img src=x><figcaption>")
            self.text(self.sentences(1, 1), 1)
            self.markup("</figcaption></figure>")

    def interruption(self) -> None:
        kind = self.rng.randint(0, 4)
        if kind == 0:
            self.wrap(("div", "aside", "section"), "advert", lambda: self.lines(0, 1, 2, (1, 2)))
        elif kind == 1:
            self.wrap(("div", "section", "dialog"), "notice", lambda: self.lines(0, 1, 2))
        elif kind == 2:
            self.wrap(("aside", "div", "section"), "side", lambda: (self.lines(0, 1, 2, (1, 3)), self.links(1, 4)))
        elif kind == 3:
            self.form()
        else:
            self.wrap(("div", "ul"), "menu", self.links)

    def article(self) -> None:
        r = self.rng
        title = r.random() < 0.8
        if title:
            head = r.random() < 0.2
            self.markup("<header>" * head + "<h1>")
            self.text(self.words(1, 12), 1)
            self.markup("</h1>" + "</header>" * head)
        for _ in range(r.randint(1, 12)):
            self.paragraph()
            if r.random() < 0.05:
                self.interruption()

    def page(self) -> list[tuple[str, int | None]]:
        r = self.rng
        chance = lambda p: r.random() < p
        self.parts = []
        self.markup('<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var a="</p>";</script></head>')
        self.markup(f"<body{self.hiding() if chance(0.08) else ''}>")
        if chance(0.1):
            self.markup("<noscript>")
            self.text(self.sentences(1, 2), 0)
            self.markup("</noscript>")
        if chance(0.25):
            self.wrap(("div", "section", "aside"), "notice", lambda: self.lines(0, 1, 2, (1, 3)))
        if chance(0.35):
            self.wrap(("header", "header", "div"), "header", lambda: (self.lines(0, 1, 2, (1, 1)), self.links(1, 4) if chance(0.4) else None), 0.5)
        if chance(0.75):
            self.wrap(("nav", "nav", "div", "ul"), "menu", self.links, 0.4)
        if chance(0.4):
            self.wrap(("div", "section"), "advert", lambda: self.text(self.sentences(1, 3), 0))
        if chance(0.15):
            self.form()
        if chance(0.2):
            self.wrap(("aside", "div"), "side", lambda: (self.lines(0, 1, 2), self.links(1, 5)), 0.6)
        layout = r.random()
        if layout < 0.5:
            self.markup(r.choice(("<article>", "<main><article>", '<article class="post">', '<div class="page"><article>')))
            self.article()
            if chance(0.15):
                self.wrap(("section", "div"), "comment", self.comments)
            self.markup("</article></main>")
        elif layout < 0.65:
            self.markup("<main>")
            self.article()
            self.markup("</main>")
        elif layout < 0.9:
            self.wrap(("div", "section"), "content", self.article)
        else:
            self.article()
        if chance(0.3):
            self.wrap(("section", "div", "ol"), "comment", self.comments)
        if chance(0.2):
            self.wrap(("aside", "div"), "side", lambda: (self.lines(0, 1, 3), self.links(1, 5)), 0.6)
        if chance(0.15):
            self.wrap(("div", "section"), "share", lambda: self.links(1, 4))
        if chance(0.15):
            self.wrap(("div", "section"), "advert", lambda: self.lines(0, 1, 2))
        if chance(0.8):
            self.wrap(("footer", "footer", "div"), "footer", self.foot, 0.4)
        self.markup("</body></html>" if chance(0.85) else "")
        return self.parts


def labelled(parts: list[tuple[str, int | None]]) -> tuple[list[Block], list[int], str]:
    """Blocks of a written page, their labels, and its main text.

    The author marks every label-1 text with a character that no text has, so that
    labels follow the parser's own blocks.
    """
    page = "".join(s if label is None else ("" if label else "") + s for s, label in parts)
    found, labels = [], []
    for b in blocks(page):
        labels.append(int("" in b.text))
        found.append(b._replace(text=" ".join(b.text.replace("", "").replace("", "").split())))
    keep = [(b, y) for b, y in zip(found, labels) if b.text]
    return [b for b, _ in keep], [y for _, y in keep], " ".join(b.text for b, y in keep if y)


def default_field(pages: int = TRAINING_PAGES, seed: int = 17) -> Field:
    """The field of ``pages`` labelled pages, written here by rule; the same for every run."""
    author = Author(seed)
    told = [labelled(author.page())[:2] for _ in range(pages)]
    return trained([(features(page), labels) for page, labels in told if page])


def main_text(html: str, field: Field, known: dict | None = None) -> str:
    page = blocks(html)
    return " ".join(b.text for b, y in zip(page, field.decode(features(page, known))) if y)


def main_texts(pages: DataFrame, field: Field | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of every row: the main text of the whole page, empty where none is found.

    Character references are decoded, white space inside a block is one space, and
    kept blocks are joined by one. Null and empty pages give an empty text, text
    without any markup is one block; unclosed and cut-off elements are closed as
    browsers do. Repeated rows, null ids and null urls come back as they are.
    """
    held = pages.sparkSession.sparkContext.broadcast(field or default_field())
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    def per_part(batches):
        known: dict = {}
        for batch in batches:
            texts = [main_text(h, held.value, known) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"]
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}
    return rows.mapInArrow(per_part, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint").withColumnsRenamed({"id": id_column, "url": url_column})
