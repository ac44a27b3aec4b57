"""Main text of a page by two passes of block rules.

The page is cut into blocks at block elements. The first pass classes a block by where it
stands (navigation, forms, notices ... are boilerplate), its link density, length and stop-word
density; text in languages without listed stop words by its sentences. Short blocks, and middling
ones, stay open; the second pass gives them the label of the nearest decided neighbours. An element
that only its class or id marks is no boilerplate if it holds the page's article, nor is a form that
holds most of the page's prose. Each page is worked on where it is read: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import fields_udf

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video select datalist".split())
#: Silent elements whose content is raw: nothing but their own end tag ends them.
RAW = frozenset("script style noscript iframe title textarea xmp".split())
#: Elements whose blocks are boilerplate.
AROUND = frozenset("nav footer aside button menu dialog label fieldset".split())
#: Elements that mark the article.
WITHIN = frozenset("article main".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mo mn ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mpadded "
    "mphantom mtable mtr mtd menclose mmultiscripts annotation annotation-xml".split()
)
#: Inline elements that are not shown: the source of a formula.
UNSEEN = frozenset("annotation annotation-xml".split())
#: Elements that are themselves a block of text.
TEXTUAL = frozenset("p blockquote li dd td pre h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended comment comments comentarios "
    "kommentare commentaires disqus reply replies respond widget widgets toolbar pagination pager copyright "
    "complementary contentinfo search hidden".split()
)
#: Those of reader comments: boilerplate also where the page's longest article is one of them.
COMMENT_MARKS = frozenset(
    "comment comments comentarios kommentare commentaires disqus reply replies respond".split()
)
#: Frequent words of four languages (fixed values).
STOP = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it "
    "its more no not of on one only or other our out she so some than that the their them then there they this "
    "to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour que qui "
    "sa se ses son sont sur un une vous "
    "aber als auch auf aus bei das dem den der des die durch ein eine einen einer es für hat ich im in ist mit nach "
    "nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con de del el ella en entre es esta este ha la las lo los más me muy no o para pero por que se sin "
    "sobre son su sus también un una y ya".split()
)

OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Classes that say how a page is laid out, or what it has, and not what the element is: right-sidebar, has-menu.
LAYOUT = re.compile(
    r"(?:[a-z0-9]+[-_]+)*(?:no|has|have|with|without)[-_]+[a-z0-9_-]+|"
    r"(?:[a-z0-9]+[-_]+)*(?:left|right|both|double|single|one|two|three)[-_]*sidebars?(?:[-_]+(?:layout|page|template))?|"
    r"(?:[a-z0-9]+[-_]+)*sidebars?[-_]+(?:left|right|both|none|no|layout|page|template)"
)
#: Elements that hold the page: never boilerplate. Of articles only hidden and style count.
PAGE = frozenset("html body".split())
WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write no spaces between words (fixed ranges): Thai to Burmese, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Ends of sentences, and of clauses in unspaced scripts.
SENTENCE = re.compile(r"[.!?…؟।۔]+(?=[\s\"'»”’)]|$)")
CLAUSE = re.compile("[。．！？，、；：…၊။។\u0e2f ]+")


@dataclass
class Block:
    text: str
    link_chars: int
    sign: int  # the innermost marked element, -1 if none
    holder: int  # the innermost article or main, -1 if none
    heading: bool
    around: bool = False

    @property
    def within(self) -> bool:
        return self.holder >= 0


@dataclass
class Sign:
    """An element that is marked: hard, form, class or soft."""

    kind: str
    parent: int


@dataclass
class Holder:
    """An article or main: the marked element and the holder around it."""

    name: str
    sign: int
    parent: int


@dataclass(frozen=True)
class Limits:
    """Limits of the block rules."""

    max_links: float = 0.33
    short: int = 70
    long: int = 200
    low: float = 0.10
    high: float = 0.22


def marked(element: str, attributes: str) -> str:
    """How attributes mark an element as boilerplate: hard (hidden, or comments), class, soft or not at all ("").

    Soft is a paragraph or the like with a class of three words or more of which the last is no mark,
    such as notice-board-story.
    """
    if element in PAGE or not attributes:
        return ""
    seen, kinds = set(), set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "hidden":
            return "hard"
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "hard"
        elif name in ("class", "id", "role") and element not in WITHIN:
            for token in value.split():
                if name == "class" and LAYOUT.fullmatch(token):
                    continue
                words = re.split(r"[^a-z0-9]+", token)
                if not MARKS.isdisjoint(words):
                    soft = element in TEXTUAL and len(words) > 2 and words[-1] not in MARKS
                    kinds.add("hard" if not COMMENT_MARKS.isdisjoint(words) else "soft" if soft else "class")
    return next((k for k in ("hard", "class", "soft") if k in kinds), "")


def tag_end(page: str, at: int, lost: set[str]) -> int:
    """Position of the ``>`` that ends a tag, quoted values passed over; -1 if there is none.

    ``lost`` holds quotes that the rest of the page lacks, so that a page is read once however broken.
    """
    while m := QUOTE_OR_END.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if m[0] not in lost and page[max(0, m.start() - 40) : m.start()].rstrip().endswith("="):
            close = page.find(m[0], at)
            if close < 0:
                lost.add(m[0])
            else:
                at = close + 1
    return -1


def marks(page: str) -> Iterator[tuple[str, str, str]]:
    """Text and tags of a page in order: ("text", characters, ""), ("open", name, attributes), ("close", name, "")."""
    at, lost = 0, set()
    while m := OPENS.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m[1] or m[2]:  # a comment is passed over; of CDATA only the marks are
            at = m.end() if m[2] else (page.find("-->", m.end()) + 1 or len(page) - 2) + 2
            continue
        end = tag_end(page, m.end(), lost)
        if end < 0:
            return
        at = end + 1
        if m[5]:
            yield ("close" if m[4] else "open"), m[5].lower(), page[m.end() : end]
            name = m[5].lower()
            if name in RAW and not m[4] and not page[m.end() : end].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = close.start() if close else len(page)
    if at < len(page):
        yield "text", page[at:], ""


class Reader:
    """Open elements and the block that is being read."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.signs: list[Sign] = []
        self.holders: list[Holder] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, silent, whether a sign, whether a holder
        self.names: Counter[str] = Counter()
        self.silent = self.links = 0
        self.sign = self.holder = -1
        self.in_link = self.heading = False

    def push(self, name: str, silent: bool = False, kind: str = "") -> None:
        within = name in WITHIN
        self.open.append((name, silent, bool(kind), within))
        self.names[name] += 1
        self.silent += silent
        if kind:
            self.signs.append(Sign(kind, self.sign))
            self.sign = len(self.signs) - 1
        if within:
            self.holders.append(Holder(name, self.sign, self.holder))
            self.holder = len(self.holders) - 1

    def pop(self, name: str) -> None:
        """End elements up to the innermost one of that name, if there is one."""
        while self.names[name]:
            last, silent, sign, within = self.open.pop()
            self.names[last] -= 1
            self.silent -= silent
            if sign:
                self.sign = self.signs[self.sign].parent
            if within:
                self.holder = self.holders[self.holder].parent
            if last == name:
                return

    def text(self, raw: str) -> None:
        if not self.silent:
            decoded = html.unescape(raw)
            self.parts.append(decoded)
            if self.in_link:
                self.links += len("".join(decoded.split()))

    def end(self) -> None:
        """End the block."""
        joined = " ".join("".join(self.parts).split())
        if joined:
            self.found.append(Block(joined, self.links, self.sign, self.holder, self.heading))
        self.parts, self.links = [], 0

    def opens(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append("\n")
        if name == "a":
            self.in_link = True
        kind = marked(name, attributes)
        if name in EMPTY:
            if name == "hr":
                self.end()
            return
        if name in INLINE:
            if kind:
                self.end()
                self.push(name, kind=kind)
            elif name in UNSEEN and not attributes.endswith("/"):
                self.push(name, silent=True)
            elif self.names[name]:  # inside a marked one, whose own end must be told from this one's
                self.push(name)
            return
        self.end()
        if name == "p" and self.open and self.open[-1][0] == "p":
            self.pop("p")
        self.heading = name in HEADINGS
        if not attributes.endswith("/"):
            if name in AROUND or name == "header" and self.holder < 0:
                kind = "hard"
            elif name == "form" and kind != "hard":
                kind = "form"
            self.push(name, name in SILENT, kind)

    def closes(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in INLINE:
            if self.names[name]:
                if self.open[-1][0] != name or self.open[-1][2]:
                    self.end()
                self.pop(name)
            return
        self.end()
        self.heading = False
        self.pop(name)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def read(page: str) -> Reader:
    """The page read to its end. End tags without a start are passed over."""
    reader = Reader()
    for kind, value, attributes in marks(page):
        if kind == "text":
            reader.text(value)
        elif kind == "open":
            reader.opens(value, attributes)
        else:
            reader.closes(value)
    reader.end()
    return reader


def largest(holders: list[Holder], found: list[Block], name: str) -> Holder | None:
    """The article, or main, with most text, nested ones included; of equal ones the first."""
    chars = [0] * len(holders)
    for b in found:
        if b.holder >= 0:
            chars[b.holder] += len(b.text)
    for i in range(len(holders) - 1, -1, -1):
        if holders[i].parent >= 0:
            chars[holders[i].parent] += chars[i]
    own = [i for i, h in enumerate(holders) if h.name == name and chars[i]]
    return holders[max(own, key=lambda i: (chars[i], -i))] if own else None


def page_forms(signs: list[Sign], found: list[Block], limits: Limits) -> set[int]:
    """Forms that hold more than half of the page's prose."""
    if all(s.kind != "form" for s in signs):
        return set()
    prose = [0] * len(signs)
    whole = 0
    for b in found:
        if first_pass(b, limits) in ("good", "near"):
            whole += len(b.text)
            if b.sign >= 0:
                prose[b.sign] += len(b.text)
    for i in range(len(signs) - 1, -1, -1):
        if signs[i].parent >= 0:
            prose[signs[i].parent] += prose[i]
    return {i for i, s in enumerate(signs) if s.kind == "form" and 2 * prose[i] > whole}


def blocks(page: str, limits: Limits = Limits()) -> list[Block]:
    """Blocks with text, in the order of the page, each knowing whether it stands in boilerplate.

    Marks by class or id, and forms, around the largest article and main do not count; nor do forms
    with most of the prose; a soft mark counts unless the block is certain prose.
    """
    reader = read(page)
    signs, found = reader.signs, reader.found
    lifted = page_forms(signs, found, limits)
    for name in sorted(WITHIN):
        holder = largest(reader.holders, found, name)
        at = holder.sign if holder else -1
        while at >= 0:
            if signs[at].kind != "hard":
                lifted.add(at)
            at = signs[at].parent
    inside = []  # hard, class and form: True; soft only: None; not at all: False
    for i, s in enumerate(signs):
        above = inside[s.parent] if s.parent >= 0 else False
        own = False if i in lifted else None if s.kind == "soft" else True
        inside.append(True if True in (above, own) else None if None in (above, own) else False)
    for b in found:
        state = inside[b.sign] if b.sign >= 0 else False
        b.around = bool(state) if state is not None else first_pass(b, limits) != "good"
    return found


def weight(text: str) -> int:
    """Length of a text; a character of an unspaced script says as much as three letters."""
    return len(text) if text.isascii() else len(text) + 2 * sum(1 for _ in UNSPACED.finditer(text))


def is_prose(text: str, words: list[str]) -> bool:
    """Whether a text in a language without listed stop words consists of sentences.

    Unspaced scripts: clauses of 4 to 60 characters on average. Others: at least two sentences of six words
    or more on average, most words in lower case (or of a script without cases).
    """
    unspaced = sum(1 for _ in UNSPACED.finditer(text))
    if 2 * unspaced > len(text):
        clauses = [c for c in CLAUSE.split(text) if c]
        return len(clauses) > 1 and 4 * len(clauses) <= unspaced <= 60 * len(clauses)
    sentences = sum(1 for _ in SENTENCE.finditer(text))
    capitals = sum(w[0].isupper() for w in words)
    return sentences > 1 and len(words) >= 6 * sentences and 10 * capitals <= 4 * len(words)


def first_pass(block: Block, limits: Limits) -> str:
    """good, bad, near (probably good) or short (open)."""
    chars = len(block.text)
    if block.around:
        return "bad"
    if block.link_chars > limits.max_links * chars:
        return "bad"
    if block.text.startswith("©") and not (block.within and chars > limits.long):
        return "bad"
    size = weight(block.text)
    if size < limits.short or block.heading:
        return "short"
    words = WORD.findall(block.text)
    density = sum(w.lower() in STOP for w in words) / len(words) if words else 0.0
    if density >= limits.high:
        return "good" if size > limits.long else "near"
    if density >= limits.low:
        return "good" if size > 2 * limits.long else "near"
    if is_prose(block.text, words):
        return "good" if size > limits.long else "near"
    return "short" if block.within else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of the nearest decided ones on both sides; where these differ, ``near`` is good.

    The edge of an article counts as a good neighbour for blocks inside it, the edge of the page
    as a bad one. Where a page marks its article and that has text, blocks outside are boilerplate.
    """
    n = len(found)
    if any(b.within and label in ("good", "near") for b, label in zip(found, labels)):
        labels = [label if b.within else "bad" for b, label in zip(found, labels)]
    if "good" not in labels:  # a page of short paragraphs only
        labels = ["good" if label == "near" else label for label in labels]
    before, after = [""] * n, [""] * n
    last, inside = "bad", False
    for i in range(n):
        if found[i].within != inside:
            inside = found[i].within
            last = "good" if inside else "bad"
        before[i] = last
        last = labels[i] if labels[i] in ("good", "bad") and not (labels[i] == "bad" and inside) else last
    last, inside = "bad", False
    for i in range(n - 1, -1, -1):
        if found[i].within != inside:
            inside = found[i].within
            last = "good" if inside else "bad"
        after[i] = last
        last = labels[i] if labels[i] in ("good", "bad") and not (labels[i] == "bad" and inside) else last
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif label == "near":
            out.append("good" in (before[i], after[i]))
        else:
            out.append(before[i] == after[i] == "good" or found[i].heading and after[i] == "good")
    return out


def main_text(page: str | None, limits: Limits = Limits()) -> str:
    found = blocks(page or "", limits)
    good = second_pass(found, [first_pass(b, limits) for b in found])
    return " ".join(b.text for b, keep in zip(found, good) if keep)


def extract_batch(pages: pd.Series) -> pd.DataFrame:
    texts = [main_text(p) for p in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, main text (empty if none), its length in code points.

    A null page counts as empty. Broken markup, whole pages of any length, repeated rows and null
    ids or URLs are kept as they are; other columns are not read; an empty table gives an empty
    result.
    """
    extract = fields_udf(extract_batch, "text string, n_chars long")
    return pages.select(F.col(id_col), F.col(url_col), extract(F.col(html_col)).alias("_found")).select(
        id_col, url_col, "_found.*"
    )
