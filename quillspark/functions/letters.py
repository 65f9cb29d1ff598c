"""Column functions over the text of letters: line tests and value extractors.

Every function takes and gives Columns of built-in Spark functions, so plans
stay in the JVM. Null texts count as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the patterns of letters' lines.
WHITE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
UNCLEAN = "  |^ | $|[\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
CURRENCIES = "IDR|USD|SGD|EUR|AUD|JPY|GBP|Rp"
CURRENCY = f"(?i)\\b({CURRENCIES})\\b"
NUMBER = "\\d[\\d.,]*\\d|\\d"
AMOUNT = f"(?i)(?:{CURRENCIES})\\s*\\(?\\s*([\\d.,]*\\d)"
MONEY = f"(?:{CURRENCIES})\\s*\\(?-?[\\d.,]+\\)?"
PAIR = "^([A-Za-z][A-Za-z0-9 ./&'%()\\-]{1,38}?)\\s*:\\s*(.*)$"
LABEL = "^[A-Za-z][A-Za-z0-9 ./&'%()\\-]*$"
WORDS = "^[A-Za-z]{2}[A-Za-z ]*$"
SHARE = "(?i)^([A-Za-z][A-Za-z ./&'\\-]{1,38}?)\\s+[\\d.,]+%\\s+of\\s+[\\d.,]+%\\s*:\\s*(.*)$"
BULLET = f"(?i)^[:\\s]*([A-Za-z][A-Za-z ./&'\\-]{{1,38}}?)\\s*:?\\s+({MONEY})\\s*$"
NESTED = f"(?i)^([A-Za-z][A-Za-z ./&'\\-]{{1,38}}?)\\s+({MONEY})\\s*$"
CLOSE = "^[A-Z][A-Za-z .]{2,24},\\s+(?:\\d{1,2}\\s+\\w+\\s+\\d{4}|\\w+\\s+\\d{1,2},\\s+\\d{4})\\s*$"
CAPITALS = "^[A-Z]{40,}$"
SIGN_DATE = "^\\s*,?\\s*\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}\\s*$"
FOOTER = "(?i)page \\d+ of \\d+|for and on behalf of"
EDGES = " :-,"
HEADINGS = 6


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space runs as one space, none at the ends. Texts that are so already,
    which one search finds out, aren't written anew."""
    c = filled(c)
    blank = F.lit(" ")
    unclean = F.contains(c, F.lit("  ")) | F.startswith(c, blank) | F.endswith(c, blank) | (c.rlike("[^ -~]") & c.rlike(UNCLEAN))
    return F.when(unclean, F.btrim(F.regexp_replace(c, WHITE, " "))).otherwise(c)


def is_junk(line: Column) -> Column:
    return line.rlike(CAPITALS) | line.rlike(SIGN_DATE) | line.rlike(FOOTER)


def is_junk_line(line: Column) -> Column:
    """is_junk of a clean line: each pattern is tried only where its length and a plain search allow it."""
    n = F.length(line)
    return ((n >= 40) & ~F.contains(line, F.lit(" ")) & line.rlike(CAPITALS)) | (n.between(8, 12) & line.rlike(SIGN_DATE)) | (F.contains(F.lower(line), F.lit(" of")) & line.rlike(FOOTER))


def is_share_line(line: Column) -> Column:
    return F.contains(line, F.lit("%")) & F.contains(line, F.lit(":")) & line.rlike(SHARE)


def is_close_line(line: Column) -> Column:
    return F.contains(line, F.lit(", ")) & F.right(line, F.lit(1)).between("0", "9") & line.rlike(CLOSE)


def pair_of_line(line: Column, before: Column) -> tuple[Column, Column, Column]:
    """Of a clean line whether it is a pair, its label and its value. A label holds no
    colon, so the line is cut at the first one, and only what is before it is tested."""
    label = F.rtrim(before)
    pair = (F.length(before) < F.length(line)) & F.length(before).between(2, 200) & (F.length(label) <= 39) & before.rlike(LABEL)
    return pair, label, F.btrim(F.substring(line, F.length(before) + 2, F.length(line)))


def is_pair(line: Column) -> Column:
    return line.rlike(PAIR)


def is_label(label: Column) -> Column:
    """At least two letters, and letters are 40 % of what isn't a space."""
    letters = F.length(F.regexp_replace(label, "[^\\p{L}]", ""))
    solid = F.length(F.replace(label, F.lit(" ")))
    return label.rlike(WORDS) | ((letters >= 2) & (solid > 0) & (letters * 10 >= solid * 4))


def label_value(line: Column, pattern: str) -> tuple[Column, Column]:
    return clean(F.regexp_extract(line, pattern, 1)), F.btrim(F.regexp_extract(line, pattern, 2))


def currency(c: Column) -> Column:
    return F.upper(F.regexp_extract(filled(c), CURRENCY, 1))


def first_number(c: Column) -> Column:
    return F.regexp_extract(filled(c), NUMBER, 0)


def last_number(c: Column) -> Column:
    found = F.regexp_extract_all(filled(c), F.lit(f"({NUMBER})"))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def currency_amount(c: Column) -> Column:
    """The number after the first currency, '' without one."""
    return F.regexp_extract(filled(c), AMOUNT, 1)


def amount(c: Column) -> Column:
    found = currency_amount(c)
    return F.when(found != "", found).otherwise(first_number(c))


def without_money(c: Column) -> Column:
    return F.btrim(F.get(F.split(filled(c), CURRENCY, 2), F.lit(0)), F.lit(EDGES))


def strip_currency(c: Column) -> Column:
    c = filled(c)
    parts = F.split(c, CURRENCY, 2)
    value = F.btrim(F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit(EDGES))
    before = F.get(F.split(value, CURRENCY, 2), F.lit(0))
    number = first_number(before)
    return F.when(~c.rlike(CURRENCY), F.btrim(c)).when(~value.rlike(CURRENCY), value).when(number != "", number).otherwise(F.btrim(before))


TAKES = {"raw": filled, "amount": amount, "last_amount": last_number, "currency": currency, "text_only": without_money, "strip_currency": strip_currency}


def take(name: Column, raw: Column) -> Column:
    """The extractor that name says, applied to raw."""
    out = F.when(name == "raw", TAKES["raw"](raw))
    for key, function in TAKES.items():
        if key != "raw":
            out = out.when(name == key, function(raw))
    return out


def initials(title: Column) -> Column:
    words = F.filter(F.split(filled(title), WHITE), lambda w: w != "")
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
    return F.when(letters == "", "?").otherwise(letters)


def bare(c: Column) -> Column:
    """Without white space at the ends; inside, it stays."""
    return F.regexp_replace(filled(c), f"^{WHITE}|{WHITE}$", "")


def headings(lines: Column, most: int = HEADINGS) -> Column:
    """The first lines that aren't blank, bare."""
    return F.slice(F.filter(F.transform(lines, bare), lambda x: x != ""), 1, most)


def title_of(heads: Column, titles: Column) -> Column:
    """The first title that a heading contains; null if none does, '' without titles."""
    held = F.filter(titles, lambda t: F.exists(heads, lambda h: F.contains(F.lower(h), t)))
    return F.when(F.size(titles) == 0, "").otherwise(F.get(held, F.lit(0)))


def title_place(heads: Column, titles: Column) -> Column:
    """1-based place of the first heading with a title, 0 if there is none."""
    return F.array_position(F.transform(heads, lambda h: F.exists(titles, lambda t: F.contains(F.lower(h), t))), True).cast("int")


def title_reference(heads: Column, titles: Column) -> Column:
    """The heading after the title's, unless it is a pair or junk."""
    k = title_place(heads, titles)
    following = F.when(k > 0, F.get(heads, k))
    return F.when(~is_pair(following) & ~is_junk(following), F.btrim(following))


def letterhead(heads: Column, titles: Column) -> Column:
    """The first heading, if the title's isn't the first."""
    return F.when(title_place(heads, titles) > 1, F.btrim(F.get(heads, F.lit(0))))


def ratio(share: Column, nett: Column) -> Column:
    """share of nett in percent, to four decimals; null if either isn't a number or nett is 0."""
    number = lambda c: F.regexp_replace(F.replace(filled(c), F.lit(",")), "[^\\d.]", "").try_cast("double")
    s, n = number(share), number(nett)
    return F.when(n != 0, F.round(s / n * 100, 4))
