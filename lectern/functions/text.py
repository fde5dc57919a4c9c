"""Scalar text functions as expressions. Only compatibility normalisation (NFKC), for which
Spark has no function, and named entities run in Python, a column of a batch at a time."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ZERO_WIDTH = "[\\u200b-\\u200d\\ufeff]"
SPACE = "[\\s\\u00a0\\u3000\\u2000-\\u200a\\u2028\\u2029]"


@pandas_udf(StringType())
def _composed(texts):
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility normalisation. Texts in ASCII are in that form and never leave the JVM."""
    plain = c.rlike(r"^\p{ASCII}*$")
    return F.when(plain, c).otherwise(_composed(F.when(~plain, c)))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(c: Column) -> Column:
    """For comparing: NFKC, no zero-width characters, single spaces, trimmed, lower case; null
    counts as empty."""
    c = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), ZERO_WIDTH, "")
    return F.lower(F.trim(F.regexp_replace(c, SPACE + "+", " ")))


def book_key(title: Column) -> Column:
    """The normalised title without white space, punctuation and symbols of any script."""
    return F.regexp_replace(normalize_text(title), "[\\s\\p{P}\\p{S}]", "")


def title_key(title: Column) -> Column:
    """The key of a title without its bracketed parts."""
    return book_key(F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), "[(【\\[][^)】\\]]*[)】\\]]", ""))


def clean_text(c: Column) -> Column:
    """Unix line ends, no zero-width characters, no trailing blanks on lines, one empty line at
    most, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), "\r\n?", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"), F.lit(" \n\t\r"))


@pandas_udf(StringType())
def decode_entities(texts):
    """Named and numeric character references; unknown ones and numbers beyond Unicode stay."""
    mark = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z0-9]+);")

    def one(m):
        name = m.group(1)
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if code <= 0x10FFFF else m.group()
        known = html.entities.html5.get(name + ";") or html.entities.html5.get(name.lower() + ";") or m.group()
        return known.replace("\u00a0", " ") if name.lower() == "nbsp" else known

    return texts.map(lambda t: t if t is None or "&" not in t else mark.sub(one, t))


def html_text(c: Column) -> Column:
    """Text of HTML: scripts and styles dropped, block tags to line ends, other tags gone,
    character references decoded."""
    c = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, "(?i)</?(p|div|br|li|ul|tr|td|h[1-6]|table)[^>]*>", "\n")
    return clean_text(decode_entities(F.regexp_replace(c, "<[^>]*>", "")))


def mask_credentials(c: Column) -> Column:
    """User names, passwords and tokens of URLs, with or without a scheme."""
    return F.regexp_replace(c, "(//)[^/\\s@]+@", "$1***@")


def search_words(query: str) -> list[str]:
    """The words of a query, normalised like the texts that it is looked up in."""
    plain = re.sub("[\u200b-\u200d\ufeff]", "", unicodedata.normalize("NFKC", query))
    return plain.lower().split()


def one_line(c: Column, most: int) -> Column:
    """Control and zero-width characters and runs of white space as one space, trimmed and cut."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200d\\ufeff]", " ")
    return truncate(F.trim(F.regexp_replace(c, "\\s+", " ")), most)


def says_something(c: Column) -> Column:
    """Whether `one_line` leaves anything of a text, told by the first character that it leaves."""
    return F.coalesce(c, F.lit("")).rlike("[^\\x00-\\x20\\x7f-\\x9f\\u200b-\\u200d\\ufeff]")


def without_repeated_subtitle(title: Column) -> Column:
    """A subtitle behind the last colon goes if what stands before holds it already."""
    head = F.rtrim(F.regexp_extract(title, "^(.*)(?:: |：)(.*)$", 1))
    squeezed = lambda c: F.regexp_replace(nfkc(c), "\\s+", "")
    tail = squeezed(F.regexp_extract(title, "^(.*)(?:: |：)(.*)$", 2))
    return F.when((tail != "") & F.contains(squeezed(head), tail), head).otherwise(title)


# Colours that number and name the branches of a series, and brackets that hold one.
BRANCHES = "赤青緑白黄"
OPENING, CLOSING = "([【", ")]】"


def _last_brackets(c: Column) -> Column:
    """(inner, rest): what the brackets at a text's end hold, and the text before them; null where
    it ends in none, or in brackets within brackets. Each step is computed once."""

    def cut(t: Column) -> Column:
        start, inner = t["start"], F.substring(t["plain"], t["start"] + 1, F.length(t["plain"]) - t["start"] - 1)
        ends = F.endswith(t["plain"], F.lit(")")) & (start > 0) & ~F.contains(inner, F.lit(")"))
        return F.struct(F.when(ends, inner).alias("inner"), F.when(ends, F.substring(t["c"], F.lit(1), start - 1)).alias("rest"))

    def opened(t: Column) -> Column:
        start = F.length(t["plain"]) - F.length(F.substring_index(t["plain"], "(", -1))
        return let(F.struct(t["c"].alias("c"), t["plain"].alias("plain"), start.alias("start")), cut)

    return let(F.struct(c.alias("c"), F.translate(F.rtrim(c), OPENING + CLOSING, "(((" + ")))").alias("plain")), opened)


def _series(c: Column) -> Column:
    """A series' name without its catalogue number: a last word of digits and hyphens with the
    single letter before it (or the kana that it is glued to), digits at the end of the last word,
    and then the branch of the edition."""

    def without_number(words: Column) -> Column:
        last, rest = F.element_at(words, -1), F.slice(words, 1, F.size(words) - 1)
        name = F.rtrim(last, F.lit("0123456789-"))
        number = F.substring(last, F.length(name) + 1, F.length(last))
        kana = F.substring(name, -1, 1).between("ぁ", "ん") & F.rlike(number, F.lit("^-?[0-9]+-[0-9]"))
        letter = lambda x: (F.length(x) == 1) & (x.rlike("^[A-Za-z]$") | x.between("ぁ", "ン") | F.contains(F.lit(BRANCHES), x))
        whole = F.when((F.size(rest) > 1) & letter(F.element_at(rest, -1)), F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
        shorter = F.concat(rest, F.array(F.when(kana, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)))
        glued = letter(name) & (F.size(rest) > 0)
        return F.when(number == "", words).when((name == "") & (F.size(rest) > 0), whole).when(glued, rest).otherwise(shorter)

    def without_branch(words: Column) -> Column:
        last = F.element_at(words, -1)
        branch = F.endswith(last, F.lit("版")) & F.contains(F.lit(BRANCHES), F.substring(last, -2, 1)) & ((F.length(last) == 2) | (F.length(last) == 3) & F.startswith(last, F.lit("新")))
        return F.when(branch & (F.size(words) > 1), F.slice(words, 1, F.size(words) - 1)).otherwise(words)

    words = F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+")
    return F.trim(F.array_join(let(let(words, without_number), without_branch), " "))


def _is_series(c: Column) -> Column:
    """Whether brackets name a series: not a volume, a part, an edition (a publisher's name may end
    alike) or an extra."""
    edition = F.endswith(c, F.lit("版")) & ~F.endswith(c, F.lit("出版"))
    volume = c.isin("上", "中", "下") | F.endswith(c, F.lit("巻")) | F.startswith(c, F.lit("第")) | F.lower(c).isin("vol", "vol.")
    return (c != "") & ~edition & ~volume & ~F.contains(c, F.lit("特典"))


def label(title: Column) -> Column:
    """The series name in the last brackets of a title, or in those before where the last hold
    an edition; empty without any."""
    def named(one: Column, otherwise) -> Column:
        return let(_series(one["inner"]), lambda name: F.when(_is_series(name), name).otherwise(otherwise))

    def before(one: Column) -> Column:
        return named(one, let(_last_brackets(one["rest"]), lambda two: named(two, F.lit(""))))

    return let(_last_brackets(nfkc(F.coalesce(title, F.lit("")))), before)


def color_name(hex_color: Column) -> Column:
    """The name of a colour's hue; greys have none, words stay, three digits count double."""
    h = F.regexp_replace(F.lower(F.coalesce(hex_color, F.lit(""))), "#", "")
    six = F.when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    parts = F.struct(*[(F.conv(F.substring(six, i, 2), 16, 10).cast("double") / 255).alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))])

    def hue(c: Column) -> Column:
        r, g, b = c["r"], c["g"], c["b"]
        top, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
        turn = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
        return F.when(d >= 0.08, F.pmod(turn * 60, F.lit(360.0)))

    def name(u: Column) -> Column:
        return F.when(u.isNull(), "").when((u < 20) | (u >= 345), "red").when(u < 40, "orange").when(u < 70, "yellow").when(u < 170, "green").when(u < 260, "blue").when(u < 300, "purple").otherwise("pink")

    return F.when(six.rlike("^[0-9a-f]{6}$"), let(let(parts, hue), name)).when(h.rlike("^[a-z]+$"), h).otherwise("")


def expanded_end(start: Column, end: Column) -> Column:
    """The end of a range whose leading digits were left out: 1234-56 is 1234 to 1256, and
    1998-02 carries to 2002."""
    unit = F.pow(F.lit(10), F.length(end)).cast("long")
    tail = end.cast("long")
    short = F.length(end) < F.length(start.cast("string"))
    return F.when(short, F.floor(start / unit) * unit + tail + F.when(tail < start % unit, unit).otherwise(0)).otherwise(tail)


def points_of(c: Column) -> Column:
    """The first number of a text about points; 0 without one."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(nfkc(c), "([0-9][0-9,]*)", 1), ",", "").try_cast("bigint"), F.lit(0))


# What a details line calls the publisher, and how long a name may be.
PUBLISHER_WORDS, PUBLISHER_CHARS = ("出版社", "publisher"), 100


def publisher_of(c: Column) -> Column:
    """The publisher of a details line: what calls it so, the edition behind a semicolon and a
    date in brackets go."""
    visible = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), "\\p{Cf}", "")
    words = F.trim(F.regexp_replace(visible, "\\s+", " "))

    def name(line: Column) -> Column:
        head = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.when(head.isin(*PUBLISHER_WORDS), F.substring(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line))).otherwise(line)
        value = F.trim(F.substring_index(value, ";", 1))
        last = F.substring_index(value, "(", -1)
        dated = F.endswith(value, F.lit(")")) & last.rlike("[0-9]{4}") & (F.length(F.replace(last, F.lit(")"), F.lit(""))) == F.length(last) - 1)
        return F.when(dated & (last != value), F.substring(value, F.lit(1), F.length(value) - F.length(last) - 1)).otherwise(value)

    return F.substring(F.trim(let(words, name)), 1, PUBLISHER_CHARS)


def is_store_id(c: Column) -> Column:
    """Whether a product number is that of an electronic book."""
    return F.coalesce(c, F.lit("")).rlike("^B0[A-Z0-9]{8}$")


def store_id_of_url(url: Column) -> Column:
    """The ten characters behind /dp/ or /product/ of a URL; null without any."""
    return F.nullif(F.regexp_extract(url, r"/(?:dp|gp/product|product)/([A-Z0-9]{10})(?:[/?#]|$)", 1), F.lit(""))


def effective_price(price: Column, points: Column) -> Column:
    """What a book costs after its points; null without a price."""
    return price - F.coalesce(points, F.lit(0))


def escape_markdown(c: Column) -> Column:
    """Marks of Markdown lose their meaning, list marks at line starts included."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\`*_\[\]()<>#!|~{}])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(c, "^([-+])", r"\\$1"), r"^(\d+)\.", r"$1\\.")


def note_file_name(title: Column, fallback: str = "untitled") -> Column:
    """A file name for a book's notes."""
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|#^\[\]\x00-\x1f]', "_")
    base = F.substring(F.regexp_replace(F.trim(F.regexp_replace(base, "\\s+", " ")), "[. ]+$", ""), 1, 120)
    return F.concat(F.when(base == "", fallback).otherwise(base), F.lit(".md"))


def embed_text(*parts: Column) -> Column:
    """The text that a vector stands for: what is not blank, one part a line."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def title_candidates(title: Column) -> Column:
    """Titles to look a book up by: whole, without brackets, without subtitle, longest word."""
    full = F.trim(F.coalesce(title, F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(full, "[（(【［\\[][^)）】］\\]]*[)）】］\\]]", " "), "\\s+", " "))
    short = F.trim(F.get(F.split(plain, "[:：―～]"), F.lit(0)))
    longest = F.aggregate(F.split(short, "\\s+"), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.array_distinct(F.filter(F.array(full, plain, short, longest), lambda c: c != ""))


def cited(answer: Column, count: int) -> Column:
    """The numbers in square brackets of an answer that name one of `count` sources, in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= count))))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def price_of(c: Column) -> Column:
    """The first number of a price text in digits of any width, thousands separators removed."""
    return F.regexp_replace(F.regexp_extract(nfkc(c), "([0-9][0-9,]*)", 1), ",", "").try_cast("bigint")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[a-z]+://([^/:?#]+)", 1))


def isbn10(digits: Column) -> Column:
    """The ten-digit number of nine digits with its check digit."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, i: s + (11 - i) * F.substring(digits, i, F.lit(1)).cast("int"))
    check = (11 - total % 11) % 11
    return F.concat(digits, F.when(check == 10, "X").otherwise(check.cast("string")))


def status_reason(code: Column, blocked: Column | None = None) -> Column:
    """Why an opened page gave no price: access to it was blocked (told by the page, whatever its
    status), else by its HTTP status (null: unknown): it is gone, it failed and is to be fetched
    again, or it shows no price."""
    by_status = F.when(code == 404, "not_found").when(code >= 400, "page_error").otherwise("no_price")
    return by_status if blocked is None else F.when(blocked, "blocked").otherwise(by_status)
