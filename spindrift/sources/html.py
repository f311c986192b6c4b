"""HTML pages: section trees, flat text, links and boilerplate lines."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindrift.functions import text as X

_FIELDS = {
    "section_id": T.StringType(), "section_number": T.StringType(), "section_title": T.StringType(), "parent_section_id": T.StringType(),
    "level": T.IntegerType(), "ord": T.IntegerType(), "last_ord": T.IntegerType(), "own_text": T.StringType(), "has_table": T.BooleanType(),
}
_SECTIONS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS.items()]))
_ID_NUMBER = re.compile(r"_Sec([A-Za-z]?\d[\w.]*)")
_IGNORED = ("script", "style", "noscript")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _clean(text: str) -> str:
    lines = (re.sub(r"[ \t\f\v]+", " ", line).strip() for line in text.splitlines())
    return "\n".join(line for line in lines if line)


class _Tree(HTMLParser):
    """Collects sections in document order with their own text; tables become rows of cells between bars."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self.open: list[dict | None] = []  # one entry per open <section>, None without an id
        self.flat: list[str] = []
        self.ignore = 0
        self.heading: tuple[str, list[str]] | None = None
        self.table: list[list[str]] | None = None
        self.depth = 0

    def _here(self) -> list[str]:
        for s in reversed(self.open):
            if s is not None:
                return s["parts"]
        return self.flat

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _IGNORED:
            self.ignore += 1
        if self.ignore:
            return
        self._here().append("\n")
        if tag == "section":
            parent = next((s for s in reversed(self.open) if s is not None), None)
            node = None
            if a.get("id"):
                node = {"section_id": a["id"], "parts": [], "number": None, "title": None, "table": False, "ord": len(self.sections) + 1}
                node |= {"parent": parent and parent["section_id"], "level": len(self.open) + 1, "last": node["ord"]}
                self.sections.append(node)
            self.open.append(node)
        elif tag == "span" and self.open and self.open[-1] is not None:
            kinds = (a.get("class") or "").split()
            kind = "number" if "tg-number" in kinds else "title" if "tg-title" in kinds else None
            if kind and self.open[-1][kind] is None:
                self.heading = (kind, [])
        elif tag == "table":
            self.table = []
            if self.open and self.open[-1] is not None:
                self.open[-1]["table"] = True
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.table[-1].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in _IGNORED:
            self.ignore = max(0, self.ignore - 1)
        if self.ignore:
            return
        if tag == "span" and self.heading:
            kind, parts = self.heading
            self.open[-1][kind] = " ".join("".join(parts).split())
            self.heading = None
        elif tag == "table" and self.table is not None:
            rows = [[" ".join(c.split()) or " " for c in r] for r in self.table if r]
            self.table = None
            if rows:
                wide = max(map(len, rows))
                lines = [r + [" "] * (wide - len(r)) for r in rows]
                lines.insert(1, ["---"] * wide)
                self._here().append("\n" + "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n")
        elif tag == "section" and self.open:
            node = self.open.pop()
            if node is not None:
                node["last"] = len(self.sections)
        self._here().append("\n")

    def handle_data(self, data: str) -> None:
        if self.ignore:
            return
        if self.heading:
            self.heading[1].append(data)
        if self.table:
            if self.table[-1]:
                self.table[-1][-1] += data
        else:
            self._here().append(data)


def parsed(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


@F.pandas_udf(_SECTIONS)
def section_tree(pages: pd.Series) -> pd.Series:
    """Sections with ids in document order: ``ord`` to ``last_ord`` are a section and all below it."""
    out = []
    for page in pages:
        rows = []
        for s in parsed(page).sections:
            number = s["number"] or (m[1] if (m := _ID_NUMBER.search(s["section_id"])) else None)
            rows.append(
                {"section_id": s["section_id"], "section_number": number, "section_title": s["title"], "parent_section_id": s["parent"], "level": s["level"],
                 "ord": s["ord"], "last_ord": s["last"], "own_text": _clean("".join(s["parts"])), "has_table": s["table"]}
            )
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def flat_text(pages: pd.Series) -> pd.Series:
    """The text of a page, a line for each element."""
    return pd.Series([_clean("".join(parsed(p).flat)) for p in pages])


def links(html: Column | str) -> Column:
    """Targets of anchors, each once, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(X.text_of(html), F.lit(r'(?i)<a\s[^>]*?href="([^"#]+)"'), F.lit(1)))


def title(html: Column | str) -> Column:
    return X.stripped(F.regexp_extract(X.text_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def without_lines(text: Column | str, patterns: list[str]) -> Column:
    """Text without blank lines and lines that match a pattern."""
    lines = F.transform(F.split(X.text_of(text), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("|".join(f"(?:{p})" for p in patterns))), "\n")


def _plain(c: Column) -> Column:
    """Without tags, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


# Patterns of landing pages and of the heads of interpretations.
FIELD = r"(?s)field--name-{}.*?field--item[^>]*>\s*(.*?)\s*</div>"
FIRST_HEADING, PUBLISHED = r"(?s)<h1[^>]*>(.*?)</h1>", r"^First Published\s*"
CODE, SECTION, DATE = r"\bCode:\s*((?:19|20)\d{2})\s+([A-Za-z /]+?Code)\b", r"\bSection:\s*([A-Z]{0,3}\d[\w.\-]*(?:\.\d+)*)", r"\bDate:\s*([A-Za-z]+ \d{1,2},? \d{4})"
CODE_SECTION, STATE_STATUTE, HEAD = r"\b([A-Z]\d{2,4}(?:\.\d+)+)\b", r"\b(160D-\d{3,4})\b", 400


def entity_field(html: Column | str, name: str) -> Column:
    """Text of the first item of a named field of a landing page; empty if there is none."""
    return _plain(F.regexp_extract(X.text_of(html), FIELD.format(re.escape(name)), 1))


def landing_fields(html: Column | str) -> Column:
    """Title, date of publication and edition of a document's landing page, as a struct."""
    title = F.regexp_replace(F.regexp_extract(X.text_of(html), FIRST_HEADING, 1), r"<[^>]+>", "")
    published = F.regexp_replace(entity_field(html, "document-entity-pub-date"), PUBLISHED, "")
    return F.struct(_plain(title).alias("title"), F.trim(published).alias("pub_date"), entity_field(html, "document-entity-terms").alias("edition"))


def interpretation_fields(text: Column | str) -> Column:
    """Edition, kind of code, section and date of the head of an interpretation, as a struct; null where it does not say."""
    fields = {"edition": (CODE, 1), "code_type": (CODE, 2), "section": (SECTION, 1), "date": (DATE, 1)}
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(X.text_of(text), p, k)), F.lit("")).alias(name) for name, (p, k) in fields.items()])


def likely_section(title: Column | str, text: Column | str) -> Column:
    """The section that a title or the first characters of a text name: a code's, else a statute's; empty if none."""
    parts = (X.text_of(title), F.left(X.text_of(text), F.lit(HEAD)))
    codes = [F.nullif(F.regexp_extract(p, CODE_SECTION, 1), F.lit("")) for p in parts]
    return F.coalesce(*codes, F.regexp_extract(F.concat_ws(" ", *parts), STATE_STATUTE, 1))


def new_links(pages: DataFrame, most: int = 40) -> DataFrame:
    """``url, page_no`` of a paged listing (``page_no, html``): each link where it is first met, up to the first page without a new one."""
    met = pages.filter(F.col("page_no") < most).select("page_no", F.posexplode(links("html")).alias("pos", "url"))
    first = met.groupBy("url").agg(F.min(F.struct("page_no", "pos")).alias("at"))
    fresh = first.select(F.col("at.page_no").alias("page_no")).distinct()
    every = pages.filter(F.col("page_no") < most).select("page_no").distinct()
    end = every.join(fresh, "page_no", "left_anti").agg(F.coalesce(F.min("page_no"), F.lit(most)).alias("end"))
    return first.crossJoin(F.broadcast(end)).filter("at.page_no < end").select("url", F.col("at.page_no").alias("page_no"))  # one row


#: Places of a page's main content, in order of preference, and elements without any.
MAIN_PLACES = ("main", "#displayBody", ".pageContent", "#ContentPlaceHolder1", "div[role=main]", ".contentArea")
NO_CONTENT = ("script", "style", "noscript", "nav", "header", "footer", "form", "iframe", "svg", "button")
MAIN_LEAST = 200


def _is_place(place: str, tag: str, a: dict) -> bool:
    if place[0] == "#":
        return a.get("id") == place[1:]
    if place[0] == ".":
        return place[1:] in (a.get("class") or "").split()
    return tag == "div" and a.get("role") == "main" if "[" in place else tag == place


class _Places(HTMLParser):
    """Collects the text of the first element of each of MAIN_PLACES, and that of the body, without NO_CONTENT."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: dict[str, list[str]] = {"body": []}
        self.open: list[tuple[str, list[str]]] = []
        self.ignore = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return self.handle_data("\n")
        if tag in NO_CONTENT:
            self.ignore += 1
        a = dict(attrs)
        mine = [p for p in MAIN_PLACES if p not in self.texts and _is_place(p, tag, a)] if not self.ignore else []
        self.texts.update((p, []) for p in mine)
        self.open.append((tag, mine))
        self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _ in self.open):
            return
        while self.open:
            t, _ = self.open.pop()
            self.ignore -= t in NO_CONTENT
            if t == tag:
                break
        self.handle_data("\n")

    def handle_data(self, data: str) -> None:
        if not self.ignore:
            self.texts["body"].append(data)
            for _, mine in self.open:
                for p in mine:
                    self.texts[p].append(data)


@F.pandas_udf(T.StringType())
def main_content(pages: pd.Series) -> pd.Series:
    """Lines of the page's main content: the first of MAIN_PLACES with more than MAIN_LEAST characters, else the body."""
    out = []
    for page in pages:
        p = _Places()
        p.feed(page or "")
        p.close()
        texts = (_clean("".join(p.texts[x])) for x in (*MAIN_PLACES, "body") if x in p.texts)
        texts = [(t, len(" ".join(t.split()))) for t in texts]
        out.append(next((t for t, n in texts[:-1] if n > MAIN_LEAST), _clean("".join(p.texts["body"]))))
    return pd.Series(out)
