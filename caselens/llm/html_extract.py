"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into its leaf blocks, the runs of text between block-level tags. Features of a block are its ancestors' tags and names
(class and id words, role), and of its text: length, share of links, punctuation, cue words. The field is trained on labelled pages
by stochastic gradients of the log-likelihood and decoded by Viterbi; blocks labelled as article make up the text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from caselens.llm.html_pages import ADS, FOOT, NOTE, SAY, SIDE, labelled_page

#: Labelled pages to train on, and times through them.
PAGES = 700
EPOCHS = 5

# Tags that stay inside a block, tags without an end, and those whose content is no text.
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt",
    "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mpadded", "mphantom", "mstyle", "mmultiscripts", "menclose", "merror", "semantics",
))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
SILENT = frozenset((
    "script", "style", "title", "head", "noscript", "template", "textarea", "select", "option", "button", "svg", "iframe", "object", "canvas", "annotation", "annotation-xml",
))
#: Of these, those whose content runs to the page's end where no end tag follows, as it isn't markup; a start of the others without an end
#: hides only the text up to the next tag. Those of APART stand between the words before and after them.
RAW = frozenset(("script", "style", "title", "textarea"))
APART = frozenset(("textarea", "select", "option", "button", "svg", "iframe", "object", "canvas"))
#: A start of the key tag ends an open one of these.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
}
#: Ends of what CLOSES looks at.
FENCE = frozenset("ul ol dl table body article section div main td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
CUES = tuple(sorted({w for group in (ADS, FOOT, NOTE, SAY, SIDE) for w in group}))
#: Cue words are looked for in blocks under so many characters: longer ones are prose, in which such words say nothing of the block's purpose.
CUE_CHARS = 2000
CUE = re.compile(r"\b(?:" + "|".join(re.escape(c) for c in CUES) + r")\b|©")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


@lru_cache(maxsize=50_000)
def _node(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role: ``div#ad#box``."""
    words: list[str] = []
    for m in NAMED.finditer(attributes):
        words += PART.findall((m[1] or m[2] or m[3] or "").lower())
    return "#".join([tag, *dict.fromkeys(words)])


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?![\w:-])[^>]*>", re.I)


def _behind(page: str, tag: str, at: int) -> int:
    """Where a silent element ends whose start tag ends at ``at``."""
    if tag in RAW:
        end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        return end.end() if end else len(page)
    depth = 1
    for m in _ends(tag).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if depth == 0:
            return m.end()
    after = page.find("<", at)
    return len(page) if after < 0 else after


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; character references decoded, white space inside a block one blank; empty ones are left out."""
    page = page or ""
    stack: list[tuple[str, str]] = []
    out: list[Block] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked, in_link, at, size = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, linked))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, path
        if not raw:
            return
        if not parts:
            path = tuple(n for _, n in stack)
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not token[1]
            elif tag == "br":
                add(" ")
            continue
        if tag in SILENT and tag != "head":
            if not token[1] and not token[3].rstrip().endswith("/"):
                at = _behind(page, tag, at)
            if tag in APART and parts:
                add(" ")
            continue
        flush()
        if token[1]:
            in_link = False
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = (end.start() if end and end[0][1] != "/" else end.end()) if end else at
            continue
        if ends := CLOSES.get(tag):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in FENCE:
                    break
        if tag not in VOID and not token[3].rstrip().endswith("/"):
            stack.append((tag, _node(tag, token[3])))
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found: list[str] = []
    for depth, node in enumerate(reversed(path)):
        tag, *words = node.split("#")
        found.append(f"in:{tag}")
        found += [f"name:{w}" for w in words]
        if depth == 0:
            found.append(f"own:{tag}")
        if depth == 1:
            found.append(f"under:{tag}")
    return tuple(dict.fromkeys(found))


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for k, b in enumerate(blocks):
        size = len(b.text)
        own = [*_path_features(b.path), f"size:{min(9, size.bit_length())}", f"links:{min(4, 4 * b.linked // max(1, size))}", "every"]
        if b.text[-1] in ".!?":
            own.append("stop")
        if "," in b.text:
            own.append("comma")
        own += [f"cue:{c}" for c in set(CUE.findall(b.text.lower()))] if size < CUE_CHARS else []
        if k == 0:
            own.append("first")
        if k == len(blocks) - 1:
            own.append("last")
        if k and b.path == blocks[k - 1].path:
            own.append("like before")
        out.append(own)
    return out


class Field:
    """Weights of a two-label chain: state[feature] favours label 1 (against 0), move[a][b] a step from a to b."""

    def __init__(self) -> None:
        self.state: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.state.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi labels; ties go to 0."""
        if not rows:
            return []
        s = self.scores(rows)
        m = self.move
        best, back = (0.0, s[0]), []
        for x in s[1:]:
            zero = (best[0] + m[0][0], best[1] + m[1][0])
            one = (best[0] + m[0][1], best[1] + m[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            best = (max(zero), max(one) + x)
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, rows: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block, and expected counts of the four moves; forward and backward in log space."""
        s, m = self.scores(rows), self.move
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        fore = [(0.0, s[0])]
        for x in s[1:]:
            a, b = fore[-1]
            fore.append((add(a + m[0][0], b + m[1][0]), add(a + m[0][1], b + m[1][1]) + x))
        after = [(0.0, 0.0)]
        for x in reversed(s[1:]):
            a, b = after[-1]
            after.append((add(m[0][0] + a, m[0][1] + b + x), add(m[1][0] + a, m[1][1] + b + x)))
        after.reverse()
        total = add(*fore[-1])
        one = [math.exp(f[1] + a[1] - total) for f, a in zip(fore, after, strict=True)]
        moves = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(1, len(s)):
            for i in (0, 1):
                for j in (0, 1):
                    moves[i][j] += math.exp(fore[k - 1][i] + m[i][j] + (s[k] if j else 0.0) + after[k][j] - total)
        return one, moves


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4, seed: int = 0) -> Field:
    """A field that maximises the likelihood of the labels, by AdaGrad steps page by page."""
    field, seen, rng = Field(), {}, random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(pages)
        for rows, labels in pages:
            if not rows:
                continue
            one, moves = field.marginals(rows)
            grad: dict[str, float] = {}
            for row, p, y in zip(rows, one, labels, strict=True):
                for f in row:
                    grad[f] = grad.get(f, 0.0) + y - p
            for f, g in grad.items():
                g -= decay * field.state.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + g * g
                field.state[f] = field.state.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            real = [[0, 0], [0, 0]]
            for a, b in zip(labels, labels[1:], strict=False):
                real[a][b] += 1
            for a in (0, 1):
                for b in (0, 1):
                    g, key = real[a][b] - moves[a][b], f"move{a}{b}"
                    seen[key] = seen.get(key, 1e-2) + g * g
                    field.move[a][b] += rate * g / math.sqrt(seen[key])
    return field


def labelled(seed: int) -> tuple[list[list[str]], list[int]]:
    page, truth = labelled_page(seed)
    blocks = leaf_blocks(page)
    marks: dict[str, int] = {" ".join(t.split()): y for t, y in truth}
    kept = [(f, marks[b.text]) for b, f in zip(blocks, features(blocks), strict=True) if b.text in marks]
    return [f for f, _ in kept], [y for _, y in kept]


def fitted(pages: int = PAGES, epochs: int = EPOCHS) -> Field:
    return train([labelled(k) for k in range(pages)], epochs)


def article(page: str | None, field: Field) -> str:
    """The main text: its blocks joined by two line feeds; empty for null, empty or articleless pages."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row. Null html counts as empty; repeated rows come out as often; other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(field or fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(h.as_py(), shared.value) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
