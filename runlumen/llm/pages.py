"""HTML extraction: a bidirectional LSTM over the text blocks of a page keeps those of the article.

A page is cut into blocks: the text between boundaries of block elements, with character references
decoded, white space turned into one space, and scripts, styles, comments, titles and templates left
out. Each block has a tag path (names, class, id and role words of the elements around it) and words;
both are hashed into vectors, and with a few figures (length, share of links, place) they are the input
of a forward and a backward LSTM over the whole page, so each block is classified with all others in
view. Kept blocks are joined in page order by one newline.

There are no labels to learn from. Examples are up to ``SAMPLE`` pages of at most ``MOST`` bytes each,
taken by a hash of the page (hashes are ranked first, then these pages fetched), with marks from the names of their
elements (fixed lists below), and 1,000 layouts made up from the blocks of these pages and invented words,
whose article is known. Elements there are named in many ways or not at all, articles hold adverts, and comments read like articles.
Numpy fits the model on the driver (about 1 MB, carried to the tasks); all pages are read in tasks.

Defined results for odd input: a null or empty page, or one without an article, gives the empty text;
unclosed elements end with those around them, an unclosed comment, script or style with the page;
repeated pages are treated alike. Other columns come back as they are.
"""

from __future__ import annotations

import dataclasses
import html as markup
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlumen.llm.common import pieces

SAMPLE, MOST = 300, 1 << 17
PATHS, WORDS, WIDTH, HIDDEN, FIGURES = 4096, 8192, 16, 24, 5
EPOCHS, BATCH, RATE = 8, 16, 0.01

# Fixed values of the HTML standard: elements that end a block, hold no markup, or have no end.
BREAKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main
    menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead
    title tr ul""".split())
DROPPED = frozenset("script style template title iframe svg math object noembed noframes xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th",
          "option": "option", "thead": "tr td th", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
FENCES = frozenset("article aside div section main nav header footer form ul ol dl table td th body blockquote".split())

# Names that mark an article, and names of what stands around one.
MAIN_NAMES = frozenset("article main story post entry content".split())
OTHER_NAMES = frozenset("""nav header footer aside form noscript button select menu dialog textarea search label ad ads
    advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal
    newsletter subscribe sidebar widget navbar navigation breadcrumb breadcrumbs masthead topbar comment comments reply
    replies respond related recommended share sharing social login signup pagination pager copyright toolbar skip
    disqus feedback reviews complementary contentinfo""".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


# ---------------------------------------------------------------- blocks


class Paths:
    """Distinct tag paths, each by its parent and own names, so that a path costs its last element."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, tuple[str, ...]], int] = {}
        self.parent, self.names = [-1], [()]

    def child(self, parent: int, names: tuple[str, ...]) -> int:
        found = self.known.get((parent, names))
        if found is None:
            found = self.known[parent, names] = len(self.parent)
            self.parent.append(parent)
            self.names.append(names)
        return found


@dataclasses.dataclass
class Page:
    """Texts of the blocks of a page, their paths and their shares of linked text."""

    texts: list[str] = dataclasses.field(default_factory=list)
    paths: list[int] = dataclasses.field(default_factory=list)
    linked: list[float] = dataclasses.field(default_factory=list)


def blocks(html: str, paths: Paths) -> Page:
    """Blocks of a page in order; see the head of the module."""
    page, stack = Page(), [("", 0)]
    text: list[str] = []
    start, links, anchors = 0, 0, 0
    at, end = 0, len(html)

    def close() -> None:
        nonlocal text, links
        whole = " ".join("".join(text).split())
        if whole:
            page.texts.append(whole)
            page.paths.append(start)
            page.linked.append(min(1.0, links / len(whole)))
        text, links = [], 0

    def say(piece: str) -> None:
        nonlocal start, links
        piece = markup.unescape(piece)
        if not piece.isspace():
            if not any(not t.isspace() for t in text):
                start = stack[-1][1]
            if anchors:
                links += len(piece)
        text.append(piece)

    def drop_to(depth: int) -> None:
        nonlocal anchors
        while len(stack) > depth:
            anchors -= stack.pop()[0] == "a"

    while at < end:
        tag = TOKEN.search(html, at)
        if tag is None:
            say(html[at:])
            break
        if tag.start() > at:
            say(html[at:tag.start()])
        at, name = tag.end(), tag[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name in BREAKS:
            close()
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    drop_to(depth)
                    break
                if name not in BREAKS and stack[depth][0] in BREAKS:
                    break
            continue
        if name in DROPPED:
            if not tag[3].endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = shut.end() if shut else end
            continue
        if name in EMPTY:
            continue
        if name in BREAKS:
            ended = CLOSES.get(name, frozenset()) | {"p"}
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ended:
                    drop_to(depth)
                elif stack[depth][0] in FENCES:
                    break
        words = " ".join(a or b or c for a, b, c in NAMES.findall(tag[3])) if "=" in tag[3] else ""
        own = (name, *(w for w in SPLIT.split(words.lower()) if w and not w.isdigit()))
        stack.append((name, paths.child(stack[-1][1], own)))
        anchors += name == "a"
    close()
    return page


def marks(paths: Paths) -> np.ndarray:
    """For each path 1 inside an article, 0 inside what stands around one, -1 where names tell nothing."""
    found = np.full(len(paths.parent), -1, np.int8)
    for i in range(1, len(found)):
        names = set(paths.names[i])
        above = found[paths.parent[i]]
        found[i] = 0 if above == 0 or names & OTHER_NAMES else 1 if names & MAIN_NAMES else above
    return found


# ---------------------------------------------------------------- vectors of blocks


@dataclasses.dataclass
class Inputs:
    """Blocks of many pages one after the other, as hashed ids; pages are sorted by length, longest first."""

    order: np.ndarray
    sizes: np.ndarray
    path_of: np.ndarray
    parents: np.ndarray
    names: np.ndarray
    name_path: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    word_block: np.ndarray
    n_words: np.ndarray
    figures: np.ndarray


_SEEN: dict[str, int] = {}


def word_ids(text: str) -> list[int]:
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    found = []
    for word in text.lower().split():
        number = _SEEN.get(word)
        if number is None:
            number = _SEEN[word] = bucket(word, WORDS)
        found.append(number)
    return found


def inputs(pages: list[Page], paths: Paths) -> Inputs:
    """Ids and figures of the blocks of ``pages``."""
    sizes = np.array([len(p.texts) for p in pages])
    order = np.argsort(-sizes, kind="stable")
    texts = [t for i in order for t in pages[i].texts]
    ids = [word_ids(t) for t in texts]
    n_words = np.array([len(i) for i in ids], np.int64)
    counts = np.zeros(len(paths.parent))
    for i in range(1, len(counts)):
        counts[i] = counts[paths.parent[i]] + len(paths.names[i])
    names = [(bucket(n, PATHS), i) for i, own in enumerate(paths.names) for n in own]
    size = sizes[order]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    of = np.repeat(size, size)
    length = np.array([len(t) for t in texts], np.float64)
    ends = np.array([t[-1] in ".!?" for t in texts], np.float64)
    linked = np.array([v for i in order for v in pages[i].linked], np.float64)
    figures = np.stack([np.log1p(length) / 6, linked, place / of.clip(1), 1 / (1 + place), ends], 1)
    return Inputs(
        order, size, np.array([p for i in order for p in pages[i].paths], np.int64),
        np.array(paths.parent), np.array([n for n, _ in names], np.int64).reshape(-1),
        np.array([p for _, p in names], np.int64).reshape(-1), counts,
        np.array([w for own in ids for w in own], np.int64), np.repeat(np.arange(len(ids)), n_words),
        n_words, figures.astype(np.float32))


# ---------------------------------------------------------------- the network


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers by (step, page) forward and backward, -1 beyond a page's end."""
    longest = int(sizes.max(initial=0))
    first = np.cumsum(sizes) - sizes
    step = np.arange(longest)[:, None]
    inside = step < sizes
    return np.where(inside, first + step, -1), np.where(inside, first + sizes - 1 - step, -1)


class Labeller:
    """Hashed vectors, two LSTMs and a logistic output; all arrays in ``values``."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        width = 2 * WIDTH + FIGURES

        def random_values(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.values = {"path": random_values(PATHS, WIDTH, scale=0.5), "word": random_values(WORDS, WIDTH, scale=0.3),
                       "out": random_values(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            self.values[f"{way}_in"] = random_values(width, 4 * HIDDEN, scale=width ** -0.5)
            self.values[f"{way}_own"] = random_values(HIDDEN, 4 * HIDDEN, scale=HIDDEN ** -0.5)
            self.values[f"{way}_bias"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def block_vectors(self, x: Inputs) -> np.ndarray:
        path = np.zeros((len(x.parents), WIDTH), np.float32)
        np.add.at(path, x.name_path, self.values["path"][x.names])
        for i in range(1, len(path)):
            path[i] += path[x.parents[i]]
        path /= np.sqrt(x.counts.clip(1))[:, None].astype(np.float32)
        words = np.zeros((len(x.path_of), WIDTH), np.float32)
        full = np.flatnonzero(x.n_words)
        if len(full):
            starts = (np.cumsum(x.n_words) - x.n_words)[full]
            for a in range(0, len(full), 4096):
                own = full[a:a + 4096]
                low, high = starts[a], starts[a] + x.n_words[own].sum()
                words[own] = np.add.reduceat(self.values["word"][x.words[low:high]], starts[a:a + 4096] - low, axis=0)
            words[full] /= x.n_words[full, None]
        return np.concatenate([path[x.path_of], words, x.figures], 1)

    def lstm(self, way: str, vectors: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states by block; ``keep`` takes what the gradient needs."""
        weights, bias = self.values[f"{way}_own"], self.values[f"{way}_bias"]
        fed = vectors @ self.values[f"{way}_in"] + bias
        states = np.zeros((len(vectors), HIDDEN), np.float32)
        hidden = cell = np.zeros((at.shape[1], HIDDEN), np.float32)
        for row in at:
            live = int((row >= 0).sum())
            own, hidden, cell = row[:live], hidden[:live], cell[:live]
            z = fed[own] + hidden @ weights
            gates = sigmoid(z[:, :3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN:])
            admit, forget, show = np.split(gates, 3, axis=1)
            after = forget * cell + admit * new
            squashed = np.tanh(after)
            if keep is not None:
                keep.append((own, hidden, cell, admit, forget, show, new, squashed))
            hidden, cell = show * squashed, after
            states[own] = hidden
        return states

    def scores(self, x: Inputs) -> np.ndarray:
        """Probability of each block to be of the article."""
        vectors, (ahead, back) = self.block_vectors(x), steps(x.sizes)
        states = np.concatenate([self.lstm("ahead", vectors, ahead), self.lstm("back", vectors, back)], 1)
        return sigmoid(states @ self.values["out"] + self.values["bias"])

    def gradient(self, x: Inputs, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the labels and its gradient."""
        vectors, ways = self.block_vectors(x), dict(zip(("ahead", "back"), steps(x.sizes)))
        kept: dict[str, list] = {way: [] for way in ways}
        states = np.concatenate([self.lstm(w, vectors, at, kept[w]) for w, at in ways.items()], 1)
        p = sigmoid(states @ self.values["out"] + self.values["bias"])
        total = max(weight.sum(), 1e-9)
        loss = -(weight * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / total
        error = (weight * (p - labels) / total).astype(np.float32)
        grads = {"out": states.T @ error, "bias": error.sum(keepdims=True)}
        on_vectors = np.zeros_like(vectors)
        for k, way in enumerate(ways):
            own_out = self.values["out"][k * HIDDEN:(k + 1) * HIDDEN]
            weights = self.values[f"{way}_own"]
            at_gates = np.zeros((len(vectors), 4 * HIDDEN), np.float32)
            before = np.zeros((len(vectors), HIDDEN), np.float32)
            d_hidden = d_cell = np.zeros((0, HIDDEN), np.float32)
            for own, hidden, cell, admit, forget, show, new, squashed in reversed(kept[way]):
                more = np.zeros((len(own) - len(d_hidden), HIDDEN), np.float32)
                d_hidden = np.concatenate([d_hidden, more]) + error[own, None] * own_out
                d_cell = np.concatenate([d_cell, more]) + d_hidden * show * (1 - squashed ** 2)
                z = np.concatenate([
                    d_cell * new * admit * (1 - admit), d_cell * cell * forget * (1 - forget),
                    d_hidden * squashed * show * (1 - show), d_cell * admit * (1 - new ** 2)], 1)
                at_gates[own], before[own] = z, hidden
                d_hidden, d_cell = z @ weights.T, d_cell * forget
            grads[f"{way}_in"] = vectors.T @ at_gates
            grads[f"{way}_own"] = before.T @ at_gates
            grads[f"{way}_bias"] = at_gates.sum(0)
            on_vectors += at_gates @ self.values[f"{way}_in"].T
        by_path = np.zeros((len(x.parents), WIDTH), np.float32)
        np.add.at(by_path, x.path_of, on_vectors[:, :WIDTH])
        by_path /= np.sqrt(x.counts.clip(1))[:, None].astype(np.float32)
        for i in range(len(by_path) - 1, 0, -1):
            by_path[x.parents[i]] += by_path[i]
        grads["path"] = np.zeros_like(self.values["path"])
        np.add.at(grads["path"], x.names, by_path[x.name_path])
        per_word = on_vectors[:, WIDTH:2 * WIDTH] / x.n_words.clip(1)[:, None]
        grads["word"] = np.zeros_like(self.values["word"])
        np.add.at(grads["word"], x.words, per_word[x.word_block].astype(np.float32))
        return float(loss), grads

    def fit(self, examples: list[tuple[str, np.ndarray]], epochs: int, seed: int = 0) -> float:
        """Adam over shuffled batches of (page, labels of its blocks, -1 without); the last mean loss."""
        rng, step, mean = random.Random(seed), 0, 0.0
        first = {k: np.zeros_like(v) for k, v in self.values.items()}
        second = {k: np.zeros_like(v) for k, v in self.values.items()}
        batches = []
        for a in range(0, len(examples), BATCH):
            paths = Paths()
            pages = [blocks(html, paths) for html, _ in examples[a:a + BATCH]]
            x = inputs(pages, paths)
            own = [examples[a + i][1] for i in x.order]
            labels = np.concatenate(own) if own else np.zeros(0)
            if len(labels):
                batches.append((x, (labels == 1).astype(np.float32), (labels >= 0).astype(np.float32)))
        for epoch in range(epochs):
            rng.shuffle(batches)
            mean, rate = 0.0, RATE * (1 - 0.8 * epoch / epochs)
            for batch in batches:
                loss, grads = self.gradient(*batch)
                mean, step = mean + loss / len(batches), step + 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    unbiased = first[k] / (1 - 0.9 ** step)
                    self.values[k] -= (rate * unbiased / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return mean


# ---------------------------------------------------------------- examples


def marked_examples(pages: list[str]) -> list[tuple[str, np.ndarray]]:
    """Pages with labels from the names of their elements."""
    found = []
    for html in pages:
        paths = Paths()
        page = blocks(html, paths)
        found.append((html, marks(paths)[page.paths] if page.texts else np.zeros(0, np.int8)))
    return found


MARK = "\ue000"
ARTICLES = ["article", "main", "main|article", "div.content", "div#main-content", "div.post-body entry",
            "section.story", "div@main", "div.container|div.row|article", "div#content|div.post", "div", "div|section",
            "section", "td.article", "body"]
AROUND = ["nav|ul|li|a", "div.menu|a", "ul.navbar|li|a", "header|p", "header|h1", "div.header|div", "div#masthead|a",
          "footer|p", "div.footer|p", "div#copyright", "footer", "aside|p", "div.sidebar|p", "div.sidebar|h3",
          "aside.widget|ul|li", "div#sidebar|div", "div.cookie-notice|p", "div.notice", "div.alert|p", "div#consent|p",
          "div.ad", "div.ads", "div.advert|p", "aside.sponsored|a", "div.banner", "div.promo-box|p", "form|label",
          "form|p", "form.search|button", "form|select|option", "div.newsletter|form|p", "div.comments|p",
          "section#comments|div.comment|p", "ol.comment-list|li|p", "div.reply|p", "div.related|ul|li|a",
          "div.share|a", "div.breadcrumbs|a", "div.pagination|a", "noscript|p", "div.popup|p", "dialog|p",
          "div.login|form|label", "div.social|ul|li|a"]
INSIDE = ["p", "p", "p", "p", "p", "p", "p|b", "h1", "h2", "h3", "ul|li", "ol|li", "blockquote|p", "pre",
          "table|tr|td", "figure|figcaption", "dl|dd", "div", "p|a", "section|p"]


def opened(spec: str) -> tuple[str, str]:
    """Tags that open and close an element path such as ``div.ad|p``."""
    start, end = "", ""
    for part in spec.split("|"):
        name = re.match(r"\w+", part)[0]
        more = part[len(name):]
        kind = {".": "class", "#": "id", "@": "role"}.get(more[:1])
        link = ' href="/x"' if name == "a" else ""
        start += f'<{name} {kind}="{more[1:]}">' if kind else f"<{name}{link}>"
        end = f"</{name}>{end}"
    return start, end


def layouts(texts: list[str], number: int, seed: int = 0) -> list[tuple[str, np.ndarray]]:
    """Made-up pages around ``texts`` and invented words, with the labels of their blocks."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choices("abcdefghijklmnoprstuvwyzéüñ", k=rng.randint(2, 9))) for _ in range(n))

    def some(long: bool) -> str:
        if texts and rng.random() < 0.6:
            return rng.choice(texts)
        return (words(rng.randint(1, 80) if long else rng.randint(1, 6))).capitalize() + rng.choice([".", ""])

    def part(spec: str, mark: str, long: bool) -> str:
        start, end = opened(spec)
        if rng.random() < 0.12 and spec.endswith(("p", "li", "td")):
            end = end.split(">", 1)[1] if end.count("<") > 1 else "<br>"
        return f"{start}{mark}{markup.escape(some(long), quote=False)}{end}"

    def around(n: int) -> str:
        found = ""
        for _ in range(n):
            spec = rng.choice(AROUND)
            # comments, notices and sidebars read like articles; menus are short
            long = bool(re.search("comment|reply|sidebar|notice|advert|aside|footer|promo", spec)) and rng.random() < 0.7
            if "|" in spec and rng.random() < 0.6:
                outer, inner = spec.split("|", 1)
                start, end = opened(outer)
                found += start + "".join(part(inner, "", long) for _ in range(rng.randint(1, 6))) + end
            else:
                found += part(spec, "", long)
        return found

    found = []
    for _ in range(number):
        inner = "".join(
            (around(1) if rng.random() < 0.15 else part(rng.choice(INSIDE), MARK, rng.random() < 0.85))
            for _ in range(rng.randint(1, 20)))
        start, end = opened(rng.choice(ARTICLES)) if rng.random() < 0.9 else ("", "")
        inner += around(1) if rng.random() < 0.3 else ""
        body = around(rng.randint(0, 5)) + start + inner + end + around(rng.randint(0, 5))
        if rng.random() < 0.2:
            body = f"{around(1)}<main>{body}</main>{around(1)}"
        if rng.random() < 0.3:
            begin, finish = opened(rng.choice(["div.wrapper", "div#page", "div.container|div.row"]))
            body = begin + body + finish
        paths = Paths()
        page = blocks(f"<!DOCTYPE html><html><body>{body}</body></html>", paths)
        labels = np.array([t.startswith(MARK) for t in page.texts], np.int8)
        found.append((f"<!DOCTYPE html><html><body>{body}</body></html>".replace(MARK, ""), labels))
    # a text that is blank but for its mark has no block without it
    return [(h, y) for h, y in found if len(blocks(h, Paths()).texts) == len(y)]


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE, most: int = MOST, made_up: int = 1000,
          epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted on a bounded sample of pages and ``made_up`` layouts; see the head of the module."""
    short = (pages.select(F.col(html).alias("html")).filter(F.octet_length("html").between(1, most))
             .withColumn("hash", F.xxhash64("html")))
    wanted = [r["hash"] for r in short.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    few = short.filter(F.col("hash").isin(wanted)).groupBy("hash").agg(F.min("html").alias("html"))
    real = marked_examples([r["html"] for r in few.orderBy("hash").collect()])
    texts = [t for page, _ in real for t in blocks(page, Paths()).texts]
    model = Labeller()
    model.fit(real + layouts(texts, made_up), epochs)
    return model


# ---------------------------------------------------------------- extraction


def article_texts(model: Labeller, pages: list[str]) -> list[str]:
    """Article of each page."""
    paths = Paths()
    cut = [blocks(p, paths) for p in pages]
    x = inputs(cut, paths)
    keep = model.scores(x) >= 0.5
    texts, at = [""] * len(pages), 0
    for page, size in zip(x.order, x.sizes):
        texts[page] = "\n".join(t for t, k in zip(cut[page].texts, keep[at:at + size]) if k)
        at += size
    return texts


def extract(pages: DataFrame, model: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the text of the article in a new column ``out``, which must not be there yet."""
    if out in pages.columns:
        raise ValueError(f"column {out} is there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces([batch], html, 1 << 22):
                texts = article_texts(model, piece[html].fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{schema}, `{out}` string")
