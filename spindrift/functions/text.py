"""Text functions on columns: cleaning, provenance, numbers, queries and labels.

All but the decoding of character references are built-in expressions, so that they stay inside
code generation; null text counts as empty unless said otherwise.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Longest text that is sent to an embedding provider.
EMBED_CHARS = 30_000
#: Price of a million tokens, and the bill above which a build asks first.
USD_PER_MILLION, USD_LIMIT = 0.13, 1.00
_SPACE = r"[\s\x1c-\x1f\x85   ]+"


def text_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def sanitize_ascii(c: Column | str) -> Column:
    """Typographic marks by their ASCII forms, no control characters but tab and line ends, ``?`` for the rest."""
    c = F.translate(text_of(c), "‘’“”–• ", "''\"\"-- ")
    c = F.replace(F.replace(c, F.lit("—"), F.lit("--")), F.lit("…"), F.lit("..."))
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(c, r"[^\x00-\x7E]", "?")


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape)


_CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]


@F.pandas_udf(T.StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _CLOSED.sub(_closed, t))


def unescaped(c: Column | str, closed: bool = False) -> Column:
    """With character references (named, decimal, hexadecimal) decoded; with ``closed`` only those that end in a semicolon.

    Otherwise older names also count without one, as browsers read them (``&amp`` at the end of a text that was cut).
    """
    return (_unescaped_closed if closed else _unescaped)(text_of(c))


def _lines(c: Column) -> Column:
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.transform(lines, lambda x: stripped(F.regexp_replace(x, r"[ \t\f\x0b]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_lines(c: Column | str, closed: bool = False) -> Column:
    """Character references decoded (see :func:`unescaped`), runs of blanks inside a line as one space, lines trimmed, empty lines dropped."""
    return _lines(unescaped(c, closed))


def strip_tags(c: Column | str, closed: bool = False) -> Column:
    """Tags as spaces, character references decoded, then :func:`clean_lines`, which decodes once more."""
    return clean_lines(unescaped(F.regexp_replace(text_of(c), r"<[^>]+>", " "), closed), closed)


def content_hash(c: Column | str) -> Column:
    return F.sha2(text_of(c), 256)


def _relative(path: Column | str) -> Column:
    return F.ltrim(F.translate(text_of(path), "\\", "/"), F.lit("/"))


def jurisdiction(path: Column | str) -> Column:
    """The first folder of the path; empty for a bare file name."""
    p = _relative(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise("")


def basename(path: Column | str) -> Column:
    return F.substring_index(_relative(path), "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-case extension with its dot, or empty; leading dots start a name."""
    return F.lower(F.regexp_extract(text_of(name), r"[^.](\.[^.]*)$", 1))


def stem(name: Column | str) -> Column:
    return F.regexp_replace(text_of(name), r"(?<=[^.])\.[^.]*$", "")


def year_in(c: Column | str) -> Column:
    """The first year from 1900 to 2099 in the text, or null."""
    return F.nullif(F.regexp_extract(text_of(c), r"(?:19|20)\d{2}", 0), F.lit(""))


def edition(label: Column | str, name: Column | str) -> Column:
    """The label, or what the file name says: building code with year, development ordinance, else the stem."""
    label, name = (text_of(x) for x in (label, name))
    code = F.rtrim(F.concat(F.lit("IBC "), F.regexp_extract(name, r"\d{4}", 0)))
    return (
        F.when(label != "", label)
        .when(name.contains("International_Building_Code") | name.contains("IBC"), code)
        .when(name.contains("UDO") | name.contains("Unified_Development"), "Durham UDO")
        .otherwise(stem(name))
    )


def _some(*cols: Column | str) -> list[Column]:
    return [F.nullif(text_of(c), F.lit("")) for c in cols]


def build_meta(edition_: Column | str, breadcrumb: Column | str, number: Column | str, title: Column | str, juris: Column | str) -> Column:
    """What is known of a chunk's place, joined by bars; empty parts are left out."""
    head = F.nullif(F.concat_ws(" ", *_some(number, title)), F.lit(""))
    e, b, j = _some(edition_, breadcrumb, juris)
    return F.concat_ws(" | ", e, b, head, j)


def embed_input(meta: Column | str, body: Column | str) -> Column:
    return F.when(text_of(meta) != "", F.concat(text_of(meta), F.lit("\n\n"), text_of(body))).otherwise(text_of(body))


def embed_guard(c: Column | str, most: int = EMBED_CHARS) -> Column:
    c = text_of(c)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def number_parts(number: Column | str) -> Column:
    """``R101.2.1`` as [101, 2, 1]: arrays compare in section order. Null if any part is no number."""
    parts = F.transform(F.split(F.regexp_replace(text_of(number), "^[A-Za-z]+", ""), r"\."), lambda x: x.try_cast("int"))
    good = F.regexp_replace(text_of(number), "^[A-Za-z]+", "").rlike(r"^\d+(\.\d+)*$")
    return F.when(good, parts)


def parent_number(number: Column | str) -> Column:
    """``101.2.1`` has parent ``101.2``; a number without a dot has none."""
    n = text_of(number)
    return F.when(F.instr(n, ".") > 0, F.regexp_replace(n, r"\.[^.]*$", ""))


def split_heading(c: Column | str) -> Column:
    """A heading as a struct of its leading number and its title (either may be null)."""
    line = F.regexp_replace(stripped(text_of(c)), _SPACE, " ")
    pattern = r"^(?:§ ?)?([A-Z]{0,4}\d[\w.\-]*?)\.? (.*\S)?$"
    number = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    title = F.when(number.isNotNull(), F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))).otherwise(F.nullif(line, F.lit("")))
    return F.struct(number.alias("number"), title.alias("title"))


def human_size(n: Column | str) -> Column:
    """Bytes as B, whole KB or MB with one decimal."""
    n = F.col(n) if isinstance(n, str) else n
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(F.floor(n / kb).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / mb), F.lit(" MB")))
    )


def tokens_of(chars: Column) -> Column:
    """Estimated tokens of so many characters."""
    return F.floor(chars / 4).cast("long")


def usd_of(tokens: Column) -> Column:
    return tokens / F.lit(1e6) * F.lit(USD_PER_MILLION)


def fts_terms(query: Column | str) -> Column:
    """Terms of a full-text query: its syntax characters are blanks; repeats and case stay."""
    return F.filter(F.split(F.regexp_replace(text_of(query), r'["()*:^]', " "), r"\s+"), lambda t: t != "")


def fts_query(query: Column | str) -> Column:
    return F.array_join(F.transform(fts_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def short_codes(query: Column | str) -> Column:
    """Tokens of two to eight capitals and digits with at least one of each, in order."""
    parts = F.transform(F.split(text_of(query), r"[\s,;:()\[\]{}/]+"), lambda t: F.regexp_replace(t, r"^[.\-'\"]+|[.\-'\"]+$", ""))
    return F.filter(parts, lambda t: t.rlike("^[A-Z0-9]{2,8}$") & t.rlike("[A-Z]") & t.rlike("[0-9]"))


def slug(c: Column | str, most: int = 80) -> Column:
    s = F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most))


def source_label(c: Column | str) -> Column:
    """A book of the state code by its part after the colon, with its edition; other books as they are."""
    c = text_of(c)
    part = F.regexp_replace(c, "(?s)^[^:]*:", "")
    return F.when(c.contains("North Carolina State Building Code") & (F.instr(c, ":") > 0), F.concat(F.lit("NC 2024 "), stripped(part))).otherwise(c)


def safe_name(c: Column | str) -> Column:
    """A file name of letters, digits, dot, underscore and hyphen, 200 characters at most."""
    s = F.regexp_replace(basename(c), r"[^A-Za-z0-9._\-]", "_")
    return F.left(F.regexp_replace(s, "^[._]+|[._]+$", ""), F.lit(200))


def start_line(text: Column, offset: Column) -> Column:
    """Number of the line at a character offset, from 1."""
    head = F.left(text, offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def haystack(*cols: Column | str) -> Column:
    """All parts (null: empty) in lower case, joined by spaces, for substring tests."""
    return F.lower(F.concat_ws(" ", *[text_of(c) for c in cols]))


def html_meta(html: Column | str, name: str) -> Column:
    """Content of the first ``<meta name= content=>`` of that name, decoded and trimmed, or empty."""
    found = F.regexp_extract(text_of(html), rf'(?i)<meta\s+name="{name}"\s+content="([^"]*)"', 1)
    return stripped(unescaped(found))


#: Accents of Latin letters that terms are compared without.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold(c: Column | str) -> Column:
    """Lower case without the accents of Latin letters, as full-text terms are compared."""
    return F.translate(F.lower(text_of(c)), *ACCENTS)


def terms(c: Column | str) -> Column:
    """The runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def n_terms(c: Column | str) -> Column:
    """How many :func:`terms` there are."""
    return F.regexp_count(fold(c), F.lit(r"[\p{L}\p{N}]+"))


def term_text(c: Column | str) -> Column:
    """The :func:`terms` with a blank between them, but with their accents, which are cheaper to take off each different word."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}]++", " "))


def n_words(c: Column | str) -> Column:
    """How many words a text has that is empty or has a blank between words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 if they are that, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def legacy_doc_text(content: Column) -> Column:
    """Readable runs of an old binary word file: twenty printable characters or more, three in ten of them letters."""
    text = F.replace(F.decode(content, "ISO-8859-1"), F.lit("\u0000"), F.lit(""))
    text = F.regexp_replace(text, r"[\x01-\x08\x0b\x0c\x0e-\x1f]", " ")
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"[\x20-\x7e\t\r\n]{20,}"), F.lit(0)), stripped)
    letters = lambda r: F.length(F.regexp_replace(r, "[^A-Za-z]", ""))
    runs = F.filter(runs, lambda r: (r != "") & (letters(r) / F.length(r) >= 0.3))
    body = F.array_join(F.transform(runs, lambda r: F.regexp_replace(r, r"[ \t]+", " ")), "\n")
    return F.concat(F.lit("(extracted via binary Latin-1 fallback -- formatting lost)\n\n"), body)
