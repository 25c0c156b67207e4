"""Scalar expressions over catalogue columns; each takes and returns Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import B_SIDE_FIELDS, EDITABLE_FIELDS, NORM_COLUMNS, SOURCE_FIELDS, SUBSTRING_FIELDS

#: White space as Unicode has it; Spark's own classes know ASCII only.
SPACE = r"[\s\x0b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def null_if_blank(c: Column | str) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def blank(c: Column | str) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def norm_columns() -> dict[str, Column]:
    """The lower-cased copies of eight columns."""
    return {to: F.lower(F.col(c)) for c, to in NORM_COLUMNS.items()}


def year_sort(year: Column | str) -> Column:
    """The first run of four digits, if it lies between 1850 and 2100."""
    n = F.nullif(F.regexp_extract(_col(year), "([0-9]{4})", 1), F.lit("")).cast("int")
    return F.when(n.between(1850, 2100), n)


def norm_key(c: Column | str) -> Column:
    """Null as empty; lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), f"{SPACE}+", " "))


def record_key(matrix: Column | str = "matrix_number", label_number: Column | str = "label_number", artist: Column | str = "artist", title: Column | str = "title") -> Column:
    """``mx:`` and the matrix number, or ``lk:`` and label number, artist and title."""
    m = norm_key(matrix)
    return F.when(m != "", F.concat(F.lit("mx:"), m)).otherwise(F.concat(F.lit("lk:"), F.concat_ws("|", norm_key(label_number), norm_key(artist), norm_key(title))))


def content_hash(fields: list[str] = SOURCE_FIELDS) -> Column:
    """SHA-1, in base64, of all source columns parted by U+0001; null as empty."""
    return F.base64(F.unhex(F.sha1(F.concat_ws("\u0001", *(F.coalesce(F.col(f), F.lit("")) for f in fields)))))


def derived_columns() -> dict[str, Column]:
    """Everything derived from the source columns."""
    return {"year_sort": year_sort("year"), **norm_columns(), "record_key": record_key()}


def search_columns() -> dict[str, Column]:
    """Lower-cased copies of the columns searched by substring."""
    return {f"{c}_lc": F.lower(F.col(c)) for c in SUBSTRING_FIELDS}


#: Number, separator and side mark at the end of a label number (fixed value).
_SIDE = r"(?i)^(.+?)([\s._\-/]+)?([A-D]{1,2}\d{0,2})$"


def release_base(label_number: Column | str) -> Column:
    """The number without its side mark; null without one.

    A mark follows a separator or a digit; what is left has two characters at
    least.
    """
    t = trimmed(label_number)
    head, separator = F.regexp_extract(t, _SIDE, 1), F.regexp_extract(t, _SIDE, 2)
    base = F.regexp_replace(F.trim(head), r"[\s._\-/]+$", "")
    return F.when((head != "") & ((separator != "") | head.rlike("[0-9]$")) & (F.length(base) >= 2), base)


def side_marker_number(label_number: Column | str) -> Column:
    """The number of the side mark (0 if it has none); null without a release base."""
    mark = F.regexp_extract(trimmed(label_number), r"(?i)[A-D](\d{0,2})$", 1)
    return F.when(release_base(label_number).isNotNull(), F.coalesce(F.nullif(mark, F.lit("")).cast("int"), F.lit(0)))


def side_rank(label_number: Column | str) -> Column:
    """(letter, number) of a final side letter; ('Z', 999) without one."""
    t = F.coalesce(trimmed(label_number), F.lit(""))
    letter, number = F.regexp_extract(t, r"(?i)([A-D])(\d{0,2})$", 1), F.regexp_extract(t, r"(?i)([A-D])(\d{0,2})$", 2)
    return F.struct(
        F.when(letter == "", "Z").otherwise(F.upper(letter)).alias("letter"),
        F.when(letter == "", 999).otherwise(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0))).alias("number"))


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """Longest common start, whatever the case, as ``a`` writes it."""
    x, y = F.coalesce(trimmed(a), F.lit("")), F.coalesce(trimmed(b), F.lit(""))
    short = F.least(F.length(x), F.length(y))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.lower(F.substring(x, i, F.lit(1))) != F.lower(F.substring(y, i, F.lit(1))))
    return F.when(short == 0, "").otherwise(F.substring(x, F.lit(1), F.coalesce(F.array_min(differs) - 1, short)))


def dismiss_key(own_key: Column | str, stub_key: Column | str, own_matrix: Column | str, stub_matrix: Column | str) -> Column:
    return F.concat_ws("\u0001", *(norm_key(c) for c in (own_key, stub_key, own_matrix, stub_matrix)))


def spelling_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def is_uncertain(c: Column | str) -> Column:
    return F.coalesce(F.lower(trimmed(c)) == "dubious entry", F.lit(False))


def credit_if_different(credit: Column | str, base: Column | str) -> Column:
    """Null if the credit says what the base says, but for case and spacing; null if empty."""
    c, b = F.nullif(_col(credit), F.lit("")), F.nullif(_col(base), F.lit(""))
    return F.when(b.isNull() | (norm_key(c) != norm_key(b)), c)


def has_b_side() -> Column:
    """Whether any of the six flip-side columns is filled."""
    return reduce(or_, [F.coalesce(F.col(f), F.lit("")) != "" for f in B_SIDE_FIELDS])


def has_flip_side() -> Column:
    return ~blank("b_side_title") | ~blank("b_side_artist")


#: The six identity columns and their flip-side twins.
TWINS = {f: f"b_side_{f}" for f in ("artist", "artist_credit", "title", "title_credit", "label_number", "matrix_number")}
CARRIED = ["label", "country", "year", "format", "producer"]


def flip_side() -> dict[str, Column]:
    """The editable columns of the entry for the flip side; blank values are null."""

    def filled(c: str) -> Column:
        return F.when(~blank(c), F.col(c))

    got = {a: filled(b) for a, b in TWINS.items()} | {b: filled(a) for a, b in TWINS.items()} | {c: filled(c) for c in CARRIED}
    return {f: got.get(f, F.lit(None).cast("string")) for f in EDITABLE_FIELDS}


def substring_term(q: Column | str) -> Column:
    """A query for codes (with a digit) as it is, else with runs of other signs as one blank; lower case."""
    q = _col(q)
    plain = F.lower(F.trim(F.regexp_replace(q, "[^A-Za-z0-9]+", " ")))
    return F.when(q.rlike("[0-9]"), F.lower(q)).otherwise(plain)


def phrase_term(q: Column | str) -> Column:
    """The query as at most twelve words without quotes and stars; null if none is left."""
    clean = trimmed(F.regexp_replace(trimmed(q), r'["*]', ""))
    words = F.filter(F.split(clean, f"{SPACE}+"), lambda w: w != "")
    return F.nullif(F.array_join(F.slice(words, 1, 12), " "), F.lit(""))


def facet_value(facet: str, raw: Column | str) -> Column:
    """The path part of a facet value: trimmed, lower case but for years, URL-encoded; null if blank."""
    v = null_if_blank(raw)
    v = v if facet == "years" else F.lower(v)
    coded = F.url_encode(v)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def record_label(artist: Column | str = "artist", title: Column | str = "title") -> Column:
    return F.nullif(F.concat_ws(" – ", null_if_blank(artist), null_if_blank(title)), F.lit(""))


def page_metadata(site: str = "Catalogue entry.") -> dict[str, Column]:
    """Heading, page title and description of a record's page; ``site`` closes the description.

    The wording is fixed: "label no.", "matrix", "produced by", "B-side:", "Record".
    """
    heading = F.coalesce(record_label(), F.lit("Record"))
    release = F.nullif(F.concat_ws(", ", null_if_blank("label"), null_if_blank("year")), F.lit(""))
    facts = F.nullif(F.concat_ws(
        ", ", F.concat(F.lit("label no. "), null_if_blank("label_number")), F.concat(F.lit("matrix "), null_if_blank("matrix_number")),
        F.concat(F.lit("produced by "), null_if_blank("producer")), F.concat(null_if_blank("format"), F.lit('"')), null_if_blank("country")), F.lit(""))
    b_side = null_if_blank("b_side_title")
    none = F.lit("")
    return {
        "heading": heading,
        "page_title": F.concat(heading, F.coalesce(F.concat(F.lit(" ("), release, F.lit(")")), none)),
        "description": F.concat(
            heading, F.coalesce(F.concat(F.lit(" — "), release), none), F.lit(". "),
            F.coalesce(F.concat(F.lit("B-side: "), b_side, F.lit(". ")), none), F.coalesce(F.concat(facts, F.lit(". ")), none), F.lit(site)),
    }


def version_label(v: Column | str) -> Column:
    """First letter upper, the rest as it is."""
    v = _col(v)
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, F.lit(2), F.length(v)))


#: Parts of the agents that are let through (fixed values).
SEARCH_ENGINES = [
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot", "applebot", "petalbot", "bravebot", "facebookexternalhit",
    "twitterbot", "linkedinbot", "whatsapp", "telegrambot", "discordbot", "vercel",
]


def is_search_engine(agent: Column | str) -> Column:
    low = F.lower(F.coalesce(_col(agent), F.lit("")))
    return reduce(or_, [low.contains(x) for x in SEARCH_ENGINES])


def client_ip(forwarded: Column | str, real: Column | str) -> Column:
    """First address forwarded for, else the real one, else 'unknown'."""
    first = null_if_blank(F.split(_col(forwarded), ",")[0])
    return F.coalesce(first, null_if_blank(real), F.lit("unknown"))
