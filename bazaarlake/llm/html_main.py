"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is a run of text without a block-level tag inside. Its features come from the tags and the
class, id and role names (and their first letters) of its ancestors, its own tag, its length, links, punctuation and place, the lengths of its
neighbours, and whether it stands in the container that holds most of the page's text (the last two, and the first letters, where no known tag or name tells more).
The field has two labels (main text or not); it is trained on labelled pages by maximum
likelihood with numpy on the driver (a fixed number of pages), and pages are decoded by Viterbi
in the tasks, each page on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import small_batches
from bazaarlake.llm.layouts import labelled_pages, region_names

#: Pages that the field is trained on, steps of training, weight decay.
PAGES, STEPS, DECAY = 1200, 200, 1e-3
#: Tags whose content is no text of the page.
_HIDDEN = frozenset("script style head title noscript template svg iframe object canvas select textarea annotation annotation-xml".split())
#: Tags that don't end a block.
_MATH = frozenset("math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror maction semantics annotation annotation-xml".split())
_INLINE = _MATH | frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
#: Tags that can stand in a head; any other ends it.
_HEAD = frozenset("base link meta title style script noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open one of the same kind without an end tag, and where the search for it stops.
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table div section article aside nav header footer main form body blockquote".split())
_WHITE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects blocks: (own tag, features of the open tags, text, characters in links).

    The features of the open block-level tags ("in:" tag, "name:" class, id or role) are counted as tags
    open and close, so a block costs as many steps as it has different ones, however deep it stands.
    """

    def __init__(self, known: frozenset[str] | None = None):
        """known: the features that are wanted; None: all."""
        super().__init__(convert_charrefs=True)
        self.known = known
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.own: list[str] = []
        #: Numbers of the open block-level elements; of each block that of the element around its own, and of the one around that.
        self.numbers: list[int] = [0]
        self.count = 0
        self.homes: list[tuple[int, int]] = []
        self.tags: Counter[str] = Counter()
        self.around: dict[str, int] = {}
        self.blocks: list[tuple[str, tuple[str, ...], str, int]] = []
        self.text: list[str] = []
        self.linked = self.hidden = self.links = 0

    def end_block(self) -> None:
        if self.text:
            text = _WHITE.sub(" ", "".join(self.text)).strip()
            if text:
                own = self.own[-1] if self.own else "-"
                self.blocks.append((own, tuple(sorted(self.around)) if self.own else ("in:-",), text, self.linked))
                self.homes.append((self.numbers[-2] if len(self.numbers) > 1 else 0, self.numbers[-3] if len(self.numbers) > 2 else 0))
        self.text, self.linked = [], 0

    def start(self, tag: str, names: tuple[str, ...]) -> None:
        features = () if tag in _INLINE else tuple(x for x in {f"in:{tag}", *(f"name:{x}" for x in names), *(f"like:{x[:3]}" for x in names)} if self.known is None or x in self.known)
        self.open.append((tag, features))
        self.tags[tag] += 1
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"
        if tag not in _INLINE:
            self.own.append(tag)
            self.count += 1
            self.numbers.append(self.count)
        for x in features:
            self.around[x] = self.around.get(x, 0) + 1

    def end_head(self, anywhere: bool = False) -> None:
        """Ends an open head; unless anywhere, only one whose own content this is."""
        if not self.tags["head"]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "head":
                self.close(i)
                break
            if not anywhere:
                break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _HEAD:
            self.end_head(tag == "body")
        if tag == "br":
            self.text.append("\n")
        if tag not in _INLINE:
            self.end_block()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in _CLOSES.get(tag, ()):
                    self.close(i)
                    break
                if self.open[i][0] in _BARRIER:
                    break
            if tag in _BARRIER:  # a paragraph can't hold these
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == "p":
                        self.close(i)
                        break
                    if self.open[i][0] in _BARRIER:
                        break
        if tag not in _VOID:
            names = tuple(x for k, v in attrs if k in ("class", "id", "role") and v for x in re.findall(r"[a-z]+", v.lower()))
            self.start(tag, names)

    def close(self, i: int | None = None) -> None:
        """Ends the open tags from the i-th on; without i, ends the page."""
        if i is None:
            super().close()
            self.end_block()
            return
        for tag, features in self.open[i:]:
            self.tags[tag] -= 1
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"
            if tag not in _INLINE:
                self.own.pop()
                self.numbers.pop()
            for x in features:
                self.around[x] -= 1
                if not self.around[x]:
                    del self.around[x]
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.end_block()
        if not self.tags[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close(i)
                break
            if tag in _INLINE and self.open[i][0] not in _INLINE:
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def page_blocks(html: str, known: frozenset[str] | None = None) -> list[tuple[str, tuple[str, ...], str, int]]:
    """The blocks of a page; the last of each one's features says how its container stands to the one that holds most of the text: itself ("home:here"), around or inside it ("home:next"), or apart."""
    parser = _Blocks(known)
    parser.feed(html)
    parser.close()
    size: Counter[int] = Counter()
    for (home, _), (_, _, text, linked) in zip(parser.homes, parser.blocks, strict=True):
        size[home] += len(text) - min(linked, len(text))
    best = max(size, key=lambda x: (size[x], -x), default=0)
    above = {outer for home, outer in parser.homes if home == best}
    where = lambda home, outer: "here" if home == best else "next" if outer == best or home in above else "apart"
    return [(own, (*around, f"home:{where(*home)}"), text, linked) for home, (own, around, text, linked) in zip(parser.homes, parser.blocks, strict=True)]


#: Features of ancestors that tell what a block is: tags of regions, and names that the training pages' containers have.
ROLES = frozenset([*(f"in:{x}" for x in "article main nav header footer aside form".split()), *(f"name:{x}" for x in region_names())])


def block_features(blocks: list[tuple[str, tuple[str, ...], str, int]]) -> list[list[str]]:
    out, longest = [], max((len(b[2]) for b in blocks), default=0)
    size = [0, *(min(text.count(" ") + 1, 64).bit_length() for _, _, text, _ in blocks), 0]
    for place, (own, around, text, linked) in enumerate(blocks):
        f = ["bias", f"own:{own}", f"words:{size[place + 1]}", f"links:{round(4 * min(1.0, linked / max(1, len(text))))}"]
        f += [f"ends:{text[-1] in '.!?…'}", f"stops:{min(3, len(re.findall(r'[.!?]', text)))}", "place:" + ("only" if len(blocks) == 1 else "first" if not place else "last" if place == len(blocks) - 1 else "inner")]
        if ROLES.isdisjoint(around):  # no tag or name tells what it is
            f += [f"before:{size[place]}", f"behind:{size[place + 2]}", f"share:{min(4, 5 * len(text) // max(1, longest))}", f"part:{4 * place // len(blocks)}", *around]
        else:
            f += [x for x in around if not x.startswith(("like:", "home:"))]
        out.append(f)
    return out


#: Words of a block without links that can't be the only thing on a page that isn't main text.
LONG = 25


def must_hold(blocks: list[tuple[str, tuple[str, ...], str, int]]) -> list[int]:
    """Places of the long blocks without links."""
    return [i for i, (_, _, text, linked) in enumerate(blocks) if not linked and text.count(" ") + 1 >= LONG]


class Field:
    """Weights of features by label (1: main text), and of label pairs."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.names[x] for x in f if x in self.names]].sum(0) for f in features]).reshape(-1, 2)

    def decode(self, features: list[list[str]], one_of: list[int]) -> list[int]:
        """The best labels; if they are all 0 and one_of has places, the best ones with label 1 at one of these."""
        labels = self.viterbi(features)
        if any(labels) or not one_of:
            return labels
        score, n = self.scores(features), len(features)
        ahead, behind = score.copy(), np.zeros((n, 2))  # the best scores up to a place, and behind it, by its label
        for t in range(1, n):
            ahead[t] += (ahead[t - 1][:, None] + self.move).max(0)
        for t in range(n - 2, -1, -1):
            behind[t] = (self.move + (score[t + 1] + behind[t + 1])[None, :]).max(1)
        at = max(one_of, key=lambda t: (ahead[t, 1] + behind[t, 1], -t))
        return self.viterbi(features, at)

    def viterbi(self, features: list[list[str]], main: int | None = None) -> list[int]:
        """The best labels; main: a place that has label 1."""
        if not features:
            return []
        score = self.scores(features)
        if main is not None:
            score[main, 0] = -np.inf
        best, back = score[0], []
        for row in score[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(0))
            best = through.max(0) + row
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


class _Examples:
    """Labelled pages, padded to the longest, with the truth in numbers."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]]):
        pages = [p for p in pages if p[1]]
        self.names = {x: i for i, x in enumerate(sorted({x for f, _ in pages for row in f for x in row}))}
        self.n, self.longest = len(pages), max(len(y) for _, y in pages)
        self.size = np.array([len(y) for _, y in pages])
        labels = np.zeros((self.n, self.longest), np.int64)
        rows, columns = [], []
        for p, (features, y) in enumerate(pages):
            labels[p, : len(y)] = y
            for t, f in enumerate(features):
                rows += [p * self.longest + t] * len(f)
                columns += [self.names[x] for x in f]
        self.rows, self.columns = np.array(rows), np.array(columns)
        self.here = np.arange(self.longest) < self.size[:, None]
        self.truth = np.eye(2)[labels] * self.here[..., None]
        self.moves = np.einsum("pti,ptj->ij", self.truth[:, :-1], self.truth[:, 1:])

    def likelihood(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean log likelihood of the pages, its gradients, and the marginals of the labels; the forward and backward recursions run over all pages at once."""
        n, longest, here = self.n, self.longest, self.here
        score = np.stack([np.bincount(self.rows, emit[self.columns, k], n * longest).reshape(n, longest) for k in (0, 1)], -1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + score[:, t]
            alpha[:, t] = np.where(here[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = score[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            beta[:, t] = np.where(here[:, t + 1, None], new, 0)
        total = np.logaddexp(*alpha[np.arange(n), self.size - 1].T)
        belief = np.exp(alpha + beta - total[:, None, None]) * here[..., None]
        moves = np.exp(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
        off = ((self.truth - belief) / n).reshape(-1, 2)
        of_emit = np.stack([np.bincount(self.columns, off[self.rows, k], len(self.names)) for k in (0, 1)], 1)
        mean = ((self.truth * score).sum() + (self.moves * move).sum() - total.sum()) / n
        return float(mean), of_emit, (self.moves - moves.sum((0, 1))) / n, belief


def train_field(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, decay: float = DECAY) -> Field:
    """Maximum likelihood by gradient ascent (Adam)."""
    examples = _Examples(pages)
    w = [np.zeros((len(examples.names), 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        _, *grads, _ = examples.likelihood(*w)
        for i, g in enumerate(grads):
            g = g - decay * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(examples.names, w[0], w[1])


def labelled_examples(pages: list[tuple[str, list[tuple[str, bool]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages (html, blocks with labels) -> features and labels."""
    out = []
    for html, truth in pages:
        blocks = page_blocks(html)
        if [b[2] for b in blocks] == [_WHITE.sub(" ", text).strip() for text, _ in truth]:
            out.append((block_features(blocks), [int(y) for _, y in truth]))
    return out


@cache
def _standard_field() -> Field:
    """Trained once in a process on the labelled layouts."""
    return train_field(labelled_examples(labelled_pages(PAGES)))


def _extract(names: dict[str, int], emit: np.ndarray, move: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = Field(names, emit, move), frozenset(names)
        for batch in batches:
            texts = []
            for html in batch.column(2):
                blocks = page_blocks(html.as_py() or "", known)
                labels = field.decode(block_features(blocks), must_hold(blocks))
                texts.append(" ".join(b[2] for b, y in zip(blocks, labels, strict=True) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame, labelled: list[tuple[str, list[tuple[str, bool]]]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, from its whole html.

    Character references are decoded, white space inside a block becomes one space, and the
    blocks of main text are joined by one space. Returns one row per row of `pages`: the id, url,
    text, n_chars (code points). Defined cases: null and empty html, and pages without main text, give
    an empty text (a page with a block of LONG words and no links has some: the best labelling with such a block is taken); broken and cut-off html is read as far as it goes; pages of any length are
    read whole; repeated rows, null ids and null urls are kept; an empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(pages.sparkSession, 500)
    field = train_field(labelled_examples(labelled)) if labelled is not None else _standard_field()
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extract(field.names, field.emit, field.move), "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_html_main(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
