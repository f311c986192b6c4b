"""Main text of web pages by two-pass block rules.

A page is cut into blocks of running text. The first pass decides each block by
stop-word density, length and link density. Where it stands (inside an article or not)
moves these limits, if the page's articles hold most of its good text. Blocks of
elements that hold no main text by their name or class (menus, footers, adverts) are
left out, but not where nothing would be left. The second pass gives short, undecided
blocks the label of their nearest decided neighbour; the nearer one shares more open elements.

Stop words are listed for four languages. A block that has next to none of them and reads as
sentences (long ones, ended by marks, in lower case) is good as well; sentences with few of them
are undecided, and so is text in another script.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindrift.session import bound_batches

# Common function words of the languages that are told from lists of names and links.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on as with be by this are at from or an have not but which they you were
    de la le les des et en un une du que qui dans pour pas sur est au avec par il elle ne se ce plus nous vous
    der die das und den von zu mit ist im für auf des ein eine nicht dem sich auch es an werden aus er hat dass
    el los las y un una por con para su al del se no lo como más pero sus le ya o este sí porque esta entre cuando
    """.split()
)
# Elements that end a block, and those whose content is never main text.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
DROPPED = frozenset(
    "title button select option textarea template noscript iframe object svg math dialog canvas audio video map label input datalist".split()
)
UNWANTED = frozenset("nav footer aside form menu".split())
IN_HEAD = frozenset("head base link meta title script style noscript template".split())
# What a start tag ends, up to what.
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
UNENDED = ("title", "button", "label", "textarea")
LISTS = frozenset("ul ol menu dir dl table select".split())
RAW = frozenset(("script", "style", "xmp", "noembed"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Words in class names, ids and roles of elements that are not main text.
HINTS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation
    menu sidebar footer masthead breadcrumb breadcrumbs comment comments disqus respond reply replies cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing
    social related recommended widget pagination pager toolbar copyright disclaimer contentinfo complementary search
    """.split()
)
COMMENTS = frozenset(("comment", "comments", "disqus", "respond", "reply", "replies"))
_HEADER = frozenset(("header", "banner", "masthead"))

#: Rules of the first pass: link density over LINKS is bad, inside articles that hold the text over ALL_LINKS; below SHORT characters
#: a block is undecided; stop words of a share of at least STOPS make a block good, outside such articles from LONG characters on.
#: Scripts without spaces have no stop words here: there it is marks of punctuation, of a share of at least MARKS of the characters.
#: Below a share of FEW the block's language may not be listed: then half of its words have to be in sentences of SENTENCE words or more.
LINKS, ALL_LINKS, SHORT, STOPS, LONG, MARKS, FEW, SENTENCE = 0.33, 0.8, 60, 0.12, 200, 0.015, 0.04, 5

_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STEP = re.compile(r"""[^>=]*+(?:(>)|=\s*+(?:(["'])|[^\s>]*+))""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*+)))?""")
_NO_DISPLAY = re.compile(r"(?i)display\s*:\s*none")
_PARTS = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_SENTENCE = re.compile(r"(?<=[.!?\u2026\u037e\u0589\u061f\u06d4\u0964])[\"'\u00bb\u201d\u2019)\]]*(?:\s+|$)")
_MARKS = re.compile(r"[\u3001\u3002\uff01\uff0c\uff1f.,!?]|(?<=[\u0e00-\u0eff]) ")


@dataclass(eq=False)
class Unwanted:
    """An element whose name or class says that it holds no main text, and whether it was ever closed."""

    closed: bool = False


@dataclass
class Block:
    """One block: its text, the characters of it inside links, and where it stands."""

    text: str
    linked: int
    main: bool
    heading: bool
    inside: tuple[Unwanted, ...] = ()
    where: tuple[int, ...] = ()  # numbers of the open elements, outermost first


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(named: dict[str, str]) -> bool:
    return "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))


def _hints(named: dict[str, str]) -> set[str]:
    """Words of class, id and role; names that say what an element has or lacks do not count."""
    found: set[str] = set()
    for key in ("class", "id", "role"):
        for name in named.get(key, "").split():
            parts = [p.lower() for p in _PARTS.split(name)]
            if parts[0] not in ("has", "with", "no", "without", "is", "not"):
                found.update(parts)
    return found


class _Tags:
    """Reads the tags of a page. A quoted value may hold anything and be of any length.

    Where a tag does not end because a quote does not, tags up to that quote are read
    without regard to quotes, so that no part of a page is searched again and again.
    """

    def __init__(self, page: str) -> None:
        self.page, self.loose = page, -1

    def read(self, lt: int) -> tuple[str, bool, str, int] | None:
        """Name, whether it closes, attributes and end of the tag that starts at ``lt``."""
        start = _START.match(self.page, lt)
        if start and lt >= self.loose:
            at = start.end()
            while m := _STEP.match(self.page, at):
                at = m.end()
                if m[1]:
                    return start[2].lower(), bool(start[1]), self.page[start.end() : at - 1], at
                if m[2]:
                    close = self.page.find(m[2], at)
                    if close < 0:
                        break
                    at = close + 1
            self.loose = at
        m = start and _LOOSE.match(self.page, lt)
        return (m[2].lower(), bool(m[1]), m[3], m.end()) if m else None


class _Cutter:
    """Cuts one page into blocks, with a stack of its open elements: names, and what each adds to the state."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.words: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, str, Unwanted | None]] = []
        self.where: list[int] = []  # numbers of the elements on the stack
        self.pushed = 0
        self.open: dict[str, int] = {}  # elements of a name, and states ("drop", "main", "header"), that are open
        self.unwanted: tuple[Unwanted, ...] = ()
        self.link = False
        self.heading = False

    def text(self, raw: str) -> None:
        if raw and not self.open.get("*drop"):
            self.words.append((html.unescape(raw) if "&" in raw else raw, self.link))

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(w for w, _ in self.words).split())
            if text and (not self.open.get("*header") or self.heading):
                linked = sum(len("".join(w.split())) for w, l in self.words if l)
                self.blocks.append(Block(text, linked, self.open.get("*main", 0) > 0, self.heading, self.unwanted, tuple(self.where)))
            self.words = []

    def _push(self, name: str, state: str, unwanted: Unwanted | None) -> None:
        self.stack.append((name, state, unwanted))
        self.pushed += 1
        self.where.append(self.pushed)
        for k in (name, state):
            self.open[k] = self.open.get(k, 0) + 1
        if unwanted:
            self.unwanted = (*self.unwanted, unwanted)

    def _pop(self, closed: bool) -> str:
        name, state, unwanted = self.stack.pop()
        self.where.pop()
        for k in (name, state):
            self.open[k] -= 1
        if unwanted:
            unwanted.closed = closed
            self.unwanted = self.unwanted[:-1]
        return name

    def _end(self, names: tuple[str, ...], up_to: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of one of the names, and all inside it, unless one of ``up_to`` is between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self._pop(len(self.stack) == k + 1)
                return
            if self.stack[k][0] in up_to:
                return

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
        elif name == "br":
            self.text(" ")
        if name in VOID:
            return
        if name == "a":
            self.link = not closing
        elif name in HEADINGS:
            self.heading = not closing
        if closing:
            if self.open.get(name):
                self._end((name,))
            return
        if name not in BLOCKS and name not in DROPPED and not attributes.strip():
            return  # running text; its end tag is not looked for
        if self.open.get("head") and name not in IN_HEAD:
            self._end(("head",))
        if name in BLOCKS and any(self.open.get(x) for x in UNENDED):
            self._end(UNENDED)
        if name in BLOCKS and self.open.get("p"):
            self._end(("p",), LISTS | UNWANTED | MAIN)
        if name in ENDS_ITEM and any(self.open.get(x) for x in ENDS_ITEM[name]):
            self._end(ENDS_ITEM[name], LISTS)
        self._open(name, attributes)

    def _open(self, name: str, attributes: str) -> None:
        if attributes.endswith("/") and name not in BLOCKS:
            return
        named = _attributes(attributes) if attributes.strip() else {}
        hints = _hints(named)
        within = self.open.get("*main", 0) > 0
        if name in DROPPED or name not in ("html", "body") and (hints & COMMENTS or _hidden(named)):
            self._push(name, "*drop", None)
        elif name in MAIN:
            self._push(name, "*main", None)
        elif name == "header" and within:
            self._push(name, "*header", None)  # headings of an article stay
        elif name not in ("html", "body") and (name == "header" or name in UNWANTED or hints & HINTS and not (within and hints & HINTS <= _HEADER)):
            self._push(name, "*", Unwanted())
        else:
            self._push(name, "*", None)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without scripts, controls and comments. Broken markup is read as far as it goes."""
    out, tags, at, end = _Cutter(), _Tags(page), 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            out.text(page[at:])
            break
        if lt > at:
            out.text(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        tag = tags.read(lt)
        if not tag:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag that never ends
                stop = page.find("<", lt + 1)
                at = end if stop < 0 else stop
            else:
                out.text("<")
                at = lt + 1
            continue
        name, closing, attributes, at = tag
        if name in RAW:
            if not closing:
                stop = re.compile(rf"(?i)</{name}[^>]*>").search(page, at)
                at = stop.end() if stop else end
            continue
        out.tag(name, closing, attributes)
    out.flush()
    return out.blocks


def has_sentences(text: str) -> bool:
    """Whether at least half of the words stand in sentences of SENTENCE words or more that are not in title case."""
    total = good = 0
    for part in _SENTENCE.split(text):
        words = part.split()
        total += len(words)
        if len(words) >= SENTENCE and part[-1] not in ",:;" and 2 * sum(not w[0].isupper() for w in words) > len(words):
            good += len(words) if _SENTENCE.search(part[-1]) else 0
    return total > 0 and 2 * good >= total


def has_good_words(text: str) -> bool | None:
    """Whether the text has the function words of sentences, or in scripts without spaces their punctuation.

    Where a listed language is unlikely, sentences count; without them, text of another script than Latin is undecided, and
    so are sentences with some function words, but too few.
    """
    words = _WORDS.findall(text.lower())
    letters = sum(map(len, words))
    if 2 * len(_UNSPACED.findall(text)) > letters:
        return len(_MARKS.findall(text)) >= MARKS * len(text)
    stops = sum(w in STOP_WORDS for w in words)
    if stops >= STOPS * max(1, len(words)):
        return True
    if has_sentences(text):
        return True if stops < FEW * len(words) else None
    return None if stops < FEW * len(words) and 2 * len(_LATIN.findall(text)) < letters else False


def decide(b: Block, articles: bool) -> bool | None:
    """First pass: good, bad or undecided. ``articles``: the page's articles hold its text (see ``trusted``).

    Then a long block inside them that has few stop words is undecided and not bad, and one
    outside has to be longer.
    """
    links = b.linked / max(1, len(b.text.replace(" ", "")))
    inside = articles and b.main
    short = len(b.text) < SHORT or b.heading
    if links > (ALL_LINKS if inside and not short else LINKS):
        return False
    if short:
        return None
    good = has_good_words(b.text)
    if inside:
        return good or (None if links <= LINKS else False)
    return good if not good or not articles or len(b.text) >= LONG else False


def trusted(blocks: list[Block]) -> bool:
    """Whether at least half of the good text stands inside articles; of all text outside links, if none is good."""
    if not any(b.main for b in blocks):
        return False
    for sizes in ([len(b.text) * (decide(b, False) is True) for b in blocks], [len(b.text) * (b.linked == 0) for b in blocks]):
        if any(sizes):
            return 2 * sum(n for n, b in zip(sizes, blocks) if b.main) >= sum(sizes)
    return True


def wanted(blocks: list[Block]) -> list[Block]:
    """The blocks that stand in no unwanted element.

    An element that was never closed, and holds most of the page's good text, does not count; nor does,
    where nothing good is left, the outermost one that holds most of it.
    """
    good = [len(b.text) if decide(b, False) else 0 for b in blocks]
    ignored: set[Unwanted] = set()
    held: dict[Unwanted, int] = {}
    for b, n in zip(blocks, good):
        for u in b.inside:
            held[u] = held.get(u, 0) + n
    ignored.update(u for u, n in held.items() if not u.closed and n >= LONG and 2 * n >= sum(good))
    while True:
        inside = [next((u for u in b.inside if u not in ignored), None) for b in blocks]
        if any(u is None and (n or b.main) for u, n, b in zip(inside, good, blocks)):
            break
        held = {}
        for u, n in zip(inside, good):
            if u:
                held[u] = held.get(u, 0) + n
        most = max(held, key=held.get, default=None)
        if most is None or held[most] < LONG:
            break
        ignored.add(most)
    return [b for b, u in zip(blocks, inside) if u is None]


def main_text(page: str | None) -> str:
    """The main text; empty if there is none."""
    blocks = wanted(blocks_of(page or ""))
    articles = trusted(blocks)
    labels = [decide(b, articles) for b in blocks]
    if not any(labels):  # nothing long: what is undecided is all there is
        labels = [(x is None or x) and (b.main or not articles) for b, x in zip(blocks, labels)]
    elif articles:
        runs = [list(run) for _, run in groupby(range(len(blocks)), lambda i: blocks[i].main)]
        labels = [x for run in runs for x in _inherit([blocks[i] for i in run], [labels[i] for i in run], blocks[run[0]].main)]
    else:
        labels = _inherit(blocks, labels)
    return "\n\n".join(b.text for b, x in zip(blocks, labels) if x)


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """How many open elements two blocks share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _inherit(blocks: list[Block], labels: list[bool | None], inside: bool = False) -> list[bool]:
    """Second pass: an undecided block takes the nearer decided neighbour's label; the page's ends are bad.

    Nearer is the neighbour with which it shares more elements, then the one with fewer blocks between. At equal
    distance a heading follows the next block, and any other is good if both are.
    ``inside`` an article that holds the text the ends do not count, and without any decided block all is good.
    """
    n = len(labels)
    none = ((1, 2 * n), True) if inside else ((1, 0), False)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        last, side = None, [none] * n
        for i in order:
            if labels[i] is not None:
                last = i
            elif last is not None:
                side[i] = ((-_shared(blocks[i].where, blocks[last].where), abs(i - last)), labels[last])
            elif not inside:
                side[i] = ((0, i + 1 if order.step > 0 else n - i), False)
        sides.append(side)
    out = []
    for i, x in enumerate(labels):
        (d0, a), (d1, b) = sides[0][i], sides[1][i]
        out.append(x if x is not None else a if d0 < d1 else b if d1 < d0 or blocks[i].heading else a and b)
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars`` (code points).

    Null html is empty and gives empty text; null ids and urls stay null; repeated rows come
    back repeated; an empty table gives no rows; other columns are not read. A map over the
    pages: no shuffle, and a task holds one batch.
    """
    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
