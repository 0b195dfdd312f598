"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between the starts and ends of block
elements. A block's features are the tags and the class, id and role words of its ancestors, its
innermost tag, and what its text looks like (length, links, punctuation, place on the page). Two
states, main and other, are scored by these and by the step from one block to the next; Viterbi finds
the best sequence, and the main blocks in page order are the text.

The field is trained on labelled pages: HTML whose main parts carry LABEL, an attribute that is no
feature. train() takes any such pages; labelled_pages() makes MAX_LABELLED of them, menus, notices,
adverts, comments and so on around articles in the layouts below, from the texts of at most
MAX_SAMPLED pages of MAX_SAMPLED_CHARS at most, chosen by a hash of page_id and url. That sample is
all that is bounded: every page is read whole.

White space is what str.split() takes for it; br is white space; script, style, head, template and the
like hold no blocks. Defined results: a null or empty html, or one without main blocks, gives an empty
text; html without any tag is one block, judged as such; what follows an unclosed tag at the end is
markup. Repeated pages and clashing columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices

LABEL = "data-main"
MAX_LABELLED, MAX_SAMPLED, MAX_SAMPLED_CHARS = 600, 200, 20_000

# Fixed values of HTML: elements that begin and end blocks, that have no end, whose content is no markup, whose text isn't shown.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
HIDDEN = set("audio canvas datalist head noscript object option select svg template video".split())
#: What a start tag closes, unless one of the others is open within.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}

#: A tag may hold quotes with > inside; a quote that never ends is none.
MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(rf"(?:^|[\s\"'/])(class|id|role|{LABEL})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNFINISHED = re.compile(r"<[A-Za-z/!?]")


class Block:
    __slots__ = ("text", "features", "main")

    def __init__(self, text: str, features: list[int], main: bool) -> None:
        self.text, self.features, self.main = text, features, main


def looks(text: str, linked: int, tag: str) -> Iterator[str]:
    """Features of a block's text."""
    words = text.count(" ") + 1
    yield f"words {min(words.bit_length(), 7)}"
    yield f"links {min(4, 5 * linked // max(1, len(text)))}"
    yield f"in {tag}"
    yield "sentence" if text[-1] in ".!?…:\"”»" else "no sentence"
    yield f"commas {min(3, text.count(','))}"
    if "©" in text or "(c)" in text[:40].lower():
        yield "copyright"
    if "|" in text or "·" in text or "»" in text:
        yield "bars"


class Page:
    """Reads a page's blocks; intern gives a feature's number, or None for one that isn't known."""

    def __init__(self, intern: Callable[[str], int | None]) -> None:
        self.intern, self.of_tag = intern, {}

    def _names(self, tag: str, attributes: str) -> tuple[list[int], bool]:
        """Features that an element gives the blocks within, and whether it is labelled."""
        if attributes:
            attributes = attributes[:4096]
        known = self.of_tag.get((tag, attributes))
        if known is None:
            names, main = ["tag " + tag], False
            for name, value in ATTRIBUTE.findall(attributes):
                if name.lower() == LABEL:
                    main = True
                else:
                    names += ("word " + w.lower() for w in WORD.findall(value))
            known = sorted({i for i in map(self.intern, names) if i is not None}), main
            if len(self.of_tag) > 10_000:
                self.of_tag.clear()
            self.of_tag[tag, attributes] = known
        return known

    def blocks(self, source: str) -> list[Block]:
        self.out, self.stack, self.open, self.active = [], [], {}, {}
        self.parts, self.linked, self.hidden, self.labelled = [], 0, 0, 0
        at, end = 0, source.rfind(">") + 1
        while at < end:
            found = MARKUP.search(source, at, end)
            self._text(source[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self._close(tag)
                elif tag in RAW:
                    if tag in BLOCK:
                        self._flush()
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    at = stop.start() if stop else len(source)
                else:
                    self._start(tag, found[3] if found[3] is not None else found[4])
        if at <= end:
            rest = source[end:]
            cut = UNFINISHED.search(rest)
            self._text(rest[: cut.start()] if cut else rest)
        self._flush()
        count = len(self.out)
        for place, name in ((0, "first"), (count - 1, "last")):
            number = self.intern(name)
            if count and number is not None:
                self.out[place].features.append(number)
        return self.out

    def _text(self, text: str) -> None:
        if text and not self.hidden:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag = next((t for t, _, _ in reversed(self.stack[-64:]) if t in BLOCK), "body")
                own = [i for i in map(self.intern, looks(text, self.linked, tag)) if i is not None]
                self.out.append(Block(text, list(self.active) + own, self.labelled > 0))
            self.parts, self.linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._flush()
            if self.open.get("p") and tag not in ("button", "label"):
                self._close("p")
            if tag in CLOSES:
                shut, within = CLOSES[tag]
                while self.stack and any(self.open.get(t) for t in shut):
                    nearest = next((t for t, _, _ in reversed(self.stack) if t in shut or t in within), None)
                    if nearest not in shut:
                        break
                    self._close(nearest)
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        names, main = self._names(tag, attributes)
        self.stack.append((tag, names, main))
        self._count(tag, names, main, 1)

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self.open.get(tag):
            return
        if tag not in BLOCK and tag not in HIDDEN:
            # An inline end doesn't reach through a block.
            for opened, _, _ in reversed(self.stack):
                if opened == tag:
                    break
                if opened in BLOCK:
                    return
        while True:
            opened, names, main = self.stack.pop()
            self._count(opened, names, main, -1)
            if opened == tag:
                return

    def _count(self, tag: str, names: list[int], main: bool, by: int) -> None:
        self.open[tag] = self.open.get(tag, 0) + by
        self.hidden += by * (tag in HIDDEN)
        self.labelled += by * main
        for name in names:
            left = self.active.get(name, 0) + by
            if left:
                self.active[name] = left
            else:
                del self.active[name]


class Field:
    """The trained field: features with the weight of state main, steps[from][to], begin[state]."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], begin: list[float]) -> None:
        self.numbers = {name: i for i, name in enumerate(weights)}
        self.weights, self.steps, self.begin = list(weights.values()), steps, begin

    def reader(self) -> Page:
        return Page(self.numbers.get)

    def viterbi(self, blocks: list[Block]) -> list[bool]:
        """The likeliest states; at equal scores the block is main."""
        if not blocks:
            return []
        weights, ((oo, om), (mo, mm)), back = self.weights, self.steps, []
        other, main = self.begin[0], self.begin[1] + sum(weights[i] for i in blocks[0].features)
        for block in blocks[1:]:
            to_other, to_main = main + mo >= other + oo, main + mm >= other + om
            back.append((to_other, to_main))
            own = sum(weights[i] for i in block.features)
            other, main = (main + mo if to_other else other + oo), (main + mm if to_main else other + om) + own
        states = [main >= other]
        for to_other, to_main in reversed(back):
            states.append(to_main if states[-1] else to_other)
        return states[::-1]

    def text(self, blocks: list[Block]) -> str:
        return "\n".join(b.text for b, main in zip(blocks, self.viterbi(blocks)) if main)


def train(pages: Iterable[str], rounds: int = 250, decay: float = 0.05) -> Field:
    """Fits the field to labelled pages: log-likelihood by forward and backward sums, Adam, L2 decay."""
    numbers: dict[str, int] = {}
    reader = Page(lambda name: numbers.setdefault(name, len(numbers)))
    read = [blocks for blocks in (reader.blocks(page) for page in pages) if blocks]
    if not read:
        raise ValueError("no labelled page has a block")
    count, longest = len(read), max(map(len, read))
    sizes = np.array([len(blocks) for blocks in read])
    cell = np.array([p * longest + t for p, blocks in enumerate(read) for t, b in enumerate(blocks) for _ in b.features])
    feature = np.array([i for blocks in read for b in blocks for i in b.features])
    truth = np.zeros((count, longest), dtype=int)
    for p, blocks in enumerate(read):
        truth[p, : len(blocks)] = [b.main for b in blocks]
    alive = np.arange(longest) < sizes[:, None]
    both = alive[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    seen_begin = np.bincount(truth[:, 0], minlength=2)
    w = np.zeros(len(numbers) + 6)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        score = np.zeros((count, longest, 2))
        score[..., 1] = np.bincount(cell, w[feature], count * longest).reshape(count, longest)
        begin, steps = w[-2:], w[-6:-2].reshape(2, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + begin
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + score[:, t]
        for t in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce(steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(alive[:, t + 1, None], on, 0.0)
        total = np.logaddexp.reduce(ahead[np.arange(count), sizes - 1], axis=1)
        state = np.exp(ahead + behind - total[:, None, None]) * alive[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[..., None, None]
        slope = np.empty_like(w)
        slope[:-6] = np.bincount(feature, (truth * alive - state[..., 1]).ravel()[cell], len(numbers))
        slope[-6:-2] = (seen - pair.sum(axis=(0, 1))).ravel()
        slope[-2:] = seen_begin - state[:, 0].sum(axis=0)
        slope -= decay * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w += 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Field(dict(zip(numbers, w.tolist())), w[-6:-2].reshape(2, 2).tolist(), w[-2:].tolist())


# Layouts of the labelled pages: elements as tag, tag.class or tag#id, nested by >.
AROUND = {
    "menu": "nav, nav.main-nav, div.navbar, div#nav, ul.menu, div.breadcrumbs, div.pagination, div.navigation, ul.tags, div.toc",
    "header": "header, div#header, div.masthead, header.site-header, div.topbar, div.branding, div.logo",
    "footer": "footer, div#footer, div.site-footer, footer.page-footer, div.copyright, div.bottom, div.legal",
    "sidebar": "aside, div.sidebar, div#sidebar, div.widget, aside.rail, div.related, div.recommended, section.related-posts, div.popular, div.trending, div.more",
    "notice": "div.notice, div.cookie, div#cookie-banner, div.cookies, div.consent, section.alert, div.gdpr, div.popup, div.modal, div.disclaimer, div.warning, div.message, div.subscribe",
    "advert": "div.ad, div.ads, div.advert, div.advertisement, aside.sponsored, div.banner, div.promo, div#ad-top, section.sponsor, div.promotion",
    "form": "form, form.search, form.newsletter, form#contact, div.signup>form, div.login>form, form.poll",
    "comments": "section.comments, div#comments, div.comment, ol.comment-list>li, ul.replies>li, div.discussion, article.comment, section#responses, div.reader-comments, div.respond, div.user-comments>article",
    "share": "div.share, div.social, ul.social-links, div.sharing",
}
HOLDERS = "article, article, article, main, main>article, div.content, div#content, div.post, div.article-body, section.entry-content, div.story, div#main, div.post-content, article.post, div.text, div, section, div.main-content"
WRAPPERS = "main, main, div#page, div.container, div.wrapper, div#content, div"


def element(path: str, inside: str, mark: str = "") -> str:
    """The nested elements of a path around inside."""
    for step in reversed(path.strip().split(">")):
        tag, sign, name = re.fullmatch(r"(\w+)(?:([.#])(.+))?", step).groups()
        attribute = f' {"class" if sign == "." else "id"}="{name}"' if sign else ""
        inside, mark = f"<{tag}{attribute}{mark}>{inside}</{tag}>", ""
    return inside


def labelled_page(rng: random.Random, texts: list[str]) -> str:
    """One page in a random layout; its main parts carry LABEL."""
    mark = f' {LABEL}="1"'
    pick = lambda listed: rng.choice(listed.split(", "))

    def words(least: int, most: int) -> str:
        found = rng.choice(texts).split()
        start, size = rng.randrange(len(found)), rng.randint(least, most)
        return html.escape(" ".join(found[start : start + size]))

    def prose() -> str:
        found = rng.choice(texts)
        return html.escape(found if rng.random() < 0.7 else " ".join(found.split()[: rng.randint(1, 12)]) + ".")

    def links() -> str:
        items = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(rng.randint(2, 9))]
        return f"<ul><li>{'</li><li>'.join(items)}</li></ul>" if rng.random() < 0.7 else " | ".join(items)

    def around(kind: str) -> str:
        says = {
            "menu": links,
            "header": lambda: f"<h2>{words(1, 4)}</h2><p>{words(2, 9)}</p>",
            "footer": lambda: f"&copy; {words(1, 3)} &middot; {words(2, 12)}" if rng.random() < 0.7 else links(),
            "sidebar": lambda: f"<h3>{words(1, 4)}</h3>" + (links() if rng.random() < 0.6 else f"<p>{prose()}</p>"),
            "notice": lambda: rng.choice([prose(), f"<p>{prose()}</p>"]) + rng.choice(["", "<button>OK</button>", f'<a href="/x">{words(1, 2)}</a>']),
            "advert": lambda: rng.choice([prose(), words(3, 12), f"<p>{words(3, 20)}</p>", f'<a href="/y">{words(2, 8)}</a>', f"<h4>{words(2, 5)}</h4><p>{prose()}</p>"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><p>{prose()}</p><button>{words(1, 2)}</button>",
            "comments": lambda: "".join(f"<div><b>{words(1, 2)}</b><p>{prose()}</p></div>" for _ in range(rng.randint(1, 4))) if rng.random() < 0.6 else f"<p>{prose()}</p>",
            "share": lambda: links(),
        }
        return element(pick(AROUND[kind]), says[kind]())

    def passage() -> str:
        # Paragraphs mostly; some are never closed, as on real pages.
        kind = rng.random()
        if kind < 0.7:
            return f"<p{mark}>{prose()}</p>"
        if kind < 0.78:
            return f"<p{mark}><b>{prose()}<br>"
        if kind < 0.84:
            return element("blockquote>p", prose(), mark)
        if kind < 0.9:
            return f"<ul{mark}>" + "".join(f"<li>{prose()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.95:
            return f"<h2{mark}>{words(1, 6)}</h2>"
        return rng.choice([f"<div{mark}>{prose()}</div>", f"<pre{mark}>{prose()}</pre>", f"<figure{mark}><figcaption>{words(2, 10)}</figcaption></figure>", f"<table{mark}><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"])

    body = [f"<h1{mark}>{words(2, 9)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 2, 4, 6, 10, 16])):
        body.append(passage())
        if rng.random() < 0.2:
            body.append(around(rng.choice(["advert", "share", "form", "sidebar", "notice", "menu"])))
    if rng.random() < 0.3:
        body.append(around(rng.choice(["comments", "comments", "share", "footer"])))
    share = rng.choice([0.0, 0.5, 0.5, 0.5, 0.5, 0.8])
    before = [around(kind) for kind in ("header", "menu", "notice", "advert", "form") if rng.random() < share]
    after = [around(kind) for kind in ("share", "comments", "sidebar", "advert", "footer") if rng.random() < share]
    rng.shuffle(before)
    shown = element(pick(HOLDERS), "".join(body))
    if rng.random() < 0.5:
        # What stands around the main text is often inside one element with it.
        inner, outer = rng.randint(0, len(before)), rng.randint(0, len(after))
        shown = element(pick(WRAPPERS), "".join(before[inner:]) + shown + "".join(after[:outer]))
        before, after = before[:inner], after[outer:]
    return f"<html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body>{''.join(before)}{shown}{''.join(after)}</body></html>"


def labelled_pages(texts: list[str], count: int = MAX_LABELLED, seed: int = 0) -> list[str]:
    """Labelled pages made of texts; without any, of a few fixed words."""
    rng = random.Random(seed)
    texts = [t for t in texts if t.strip()] or ["One short line.", "A longer line of plain words, which ends as sentences do, with a point.", "More words follow here, and then more of them, so that a paragraph is made. It has two sentences."]
    return [labelled_page(rng, texts) for _ in range(count)]


def sampled_texts(pages: DataFrame) -> list[str]:
    """Texts of the blocks of a bounded sample of pages, in an order that doesn't depend on partitions."""
    fit = pages.where(F.length("html").between(1, MAX_SAMPLED_CHARS)).select("html", F.xxhash64("page_id", "url").alias("at"))
    # Rows are thinned by their hash before they are put in order, so that few are moved.
    share = max(1, fit.count() // (4 * MAX_SAMPLED))
    some = fit.where(F.pmod("at", F.lit(share)) == 0).orderBy("at", "html").limit(MAX_SAMPLED).collect()
    reader = Page(lambda name: None)
    return [block.text for row in some for block in reader.blocks(row.html)]


def fitted(pages: DataFrame) -> Field:
    return train(labelled_pages(sampled_texts(pages)))


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kinds = pages.select("page_id", "url").schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = field.reader()
        for batch in slices(batches, column=2):
            texts = [field.text(reader.blocks(source)) if source else "" for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    spelled = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"{spelled}, text string, n_chars long")
