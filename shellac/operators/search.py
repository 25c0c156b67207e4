"""Keyword, fielded and bulk search; sorting and paging."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrase_term, substring_term
from ..schema import PHRASE_FIELDS, RESULT_COLUMNS, SORT_COLUMNS, SUBSTRING_FIELDS
from ..storage import BROADCAST_ROWS, sized, stored
from .audit import grid_join

PAGE_SIZE, LAST_PAGE, SORTED_UP_TO = 100, 10_000, 5_000

def _bases() -> tuple[str, str]:
    """Letters that are written as one sign with their marks, and the letters without them, side by side (from Unicode's decompositions)."""
    marked, plain = [], []
    for sign in map(chr, range(0x80, 0x2FFF)):
        base, *marks = unicodedata.normalize("NFD", sign)
        if marks and all(unicodedata.category(m).startswith("M") for m in marks) and base.isalpha():
            marked.append(sign)
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _bases()


def token_text(c: Column) -> Column:
    """Lower-case words without marks, each led by a blank; null as empty."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(folded, r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " ")))


#: What searches read, as derived columns: words of the phrase fields, and the substring fields in lower case, both joined by U+0001.
PHRASE_TEXT, SUBSTRING_TEXT = "phrase_text", "substring_text"


def with_search_text(cat: DataFrame) -> DataFrame:
    """Add the two searched columns where they are missing; stored with a generation, they are made once."""
    words = [F.nullif(token_text(F.col(f)), F.lit(" ")) for f in PHRASE_FIELDS]
    made = {PHRASE_TEXT: F.concat_ws("\u0001", *words), SUBSTRING_TEXT: F.lower(F.concat_ws("\u0001", *SUBSTRING_FIELDS))}
    return cat.withColumns({k: v for k, v in made.items() if k not in cat.columns})


def phrase_match(q: Column | str, fields: list[str] = PHRASE_FIELDS) -> Column:
    """Whether the words of ``q`` stand side by side, in order, in one of the fields; the last word is a prefix."""
    term = phrase_term(F.lit(q) if isinstance(q, str) else q)
    phrase = token_text(term)
    return F.coalesce((phrase != " ") & reduce(or_, [F.contains(token_text(F.col(f)), phrase) for f in fields]), F.lit(False))


def substring_match(q: Column | str, fields: list[str] = SUBSTRING_FIELDS) -> Column:
    """Whether ``q`` stands in any of the fields, whatever the case; terms under three characters match nothing.

    The fields are joined by U+0001, which no term holds, and looked through once.
    """
    term = substring_term(F.lit(q) if isinstance(q, str) else q)
    joined = F.lower(F.concat_ws("\u0001", *fields))
    return F.coalesce((F.length(term) >= 3) & F.contains(joined, term), F.lit(False))


def text_match(q: str) -> Column:
    """The keyword test on the two searched columns: :func:`phrase_match` or :func:`substring_match`."""
    phrase, term = token_text(phrase_term(F.lit(q))), substring_term(F.lit(q))
    found = (phrase != " ") & F.contains(F.col(PHRASE_TEXT), phrase) | (F.length(term) >= 3) & F.contains(F.col(SUBSTRING_TEXT), term)
    return F.coalesce(found, F.lit(False)) if q.strip() else F.lit(False)


def matches(cat: DataFrame, q: str) -> DataFrame:
    """Rows of a keyword search, whole; a blank query has none."""
    return with_search_text(cat).filter(text_match(q)).select(*cat.columns)


#: (column, descending) of an order; nulls come last either way.
Keys = list[tuple[str, bool]]


def order_keys(sort: str | None, direction: str | None, total: int) -> Keys:
    """Id last; without a sort by artist while the result is small, else by id."""
    column = SORT_COLUMNS.get(sort or "")
    if column is None:
        return [("artist_norm", False), ("id", False)] if total <= SORTED_UP_TO else [("id", False)]
    return [(column, direction == "desc"), ("id", False)]


def as_order(keys: Keys) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def ordering(sort: str | None, direction: str | None, total: int) -> list[Column]:
    """The columns of :func:`order_keys`."""
    return as_order(order_keys(sort, direction, total))


def order_rows(df: DataFrame, sort: str | None = None, direction: str | None = None, total: int | None = None) -> DataFrame:
    return df.orderBy(*ordering(sort, direction, df.count() if total is None else total))


def before(keys: Keys, values: tuple) -> Column:
    """Whether a row comes before the place of ``values`` in an order."""
    out, same = F.lit(False), F.lit(True)
    for (name, down), v in zip(keys, values, strict=True):
        c = F.col(name)
        if v is None:
            less, equal = c.isNotNull(), c.isNull()
        else:
            less, equal = F.coalesce(c > v if down else c < v, F.lit(False)), F.coalesce(c == v, F.lit(False))
        out, same = out | same & less, same & equal
    return out


#: Pages from this many rows on are found by ranges; so many rows may be sorted to find one, so many ranges are counted in a pass, and so many keys tell where they begin.
DEEP_FROM, SORTED_ROWS, RANGES, SAMPLED_KEYS = 20_000, 100_000, 32, 2_048


def rank_range(df: DataFrame, keys: Keys, rank: int, total: int, most: int | None = None) -> tuple[Column, int]:
    """Rows among which that of a rank (from 0) stands: a test for them, and how many rows come before them.

    A bounded sample of the keys gives the borders of ranges, one pass counts the
    rows before each, and the range of the rank is cut again until it has ``most``
    rows (SORTED_ROWS) or no two keys to tell apart.  Only counts and keys reach
    the driver.
    """
    most = SORTED_ROWS if most is None else most
    test, skipped, n = F.lit(True), 0, total
    names = [c for c, _ in keys]
    while n > most:
        inside = df.filter(test).select(*names)
        spread = inside.withColumn("_h", F.xxhash64(*names)).orderBy("_h").limit(SAMPLED_KEYS).drop("_h")
        sample = list(dict.fromkeys(tuple(r) for r in spread.orderBy(*as_order(keys)).collect()))
        borders = [sample[i * len(sample) // RANGES] for i in range(1, RANGES)] if len(sample) >= RANGES else sample[1:]
        borders = list(dict.fromkeys(borders))
        if not borders:
            break
        counts = [0, *inside.agg(*(F.count_if(before(keys, b)).alias(f"c{i}") for i, b in enumerate(borders))).first(), n]
        at = max(i for i, c in enumerate(counts[:-1]) if c <= rank - skipped)
        low, high = None if at == 0 else borders[at - 1], None if at == len(borders) else borders[at]
        if counts[at + 1] - counts[at] == n:
            break
        for border, inside_of in ((low, lambda b: ~before(keys, b)), (high, lambda b: before(keys, b))):
            if border is not None:
                test = test & inside_of(border)
        skipped, n = skipped + counts[at], counts[at + 1] - counts[at]
    return test, skipped


def parse_page(page: object) -> int:
    """The integer that leads ``page``, 1 without one, from 1 to the last page."""
    found = re.match(r"\s*([+-]?[0-9]+)", str(page or "1"))
    return min(max(int(found[1]), 1), LAST_PAGE) if found else 1


def page_slice(ordered: DataFrame, page: object = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a frame that is already ordered, by an offset; :func:`keyed_page` is for deep pages."""
    n = parse_page(page)
    return ordered.offset((n - 1) * size).limit(size)


def keyed_page(df: DataFrame, keys: Keys, page: object = 1, size: int = PAGE_SIZE, total: int | None = None, deep_from: int | None = None, most: int | None = None) -> DataFrame:
    """One page in the order of keys.

    Early pages are a top-k.  For deep ones the range of the page's first row is
    found by counts, the keys of that range alone are sorted for the page's first
    one, and a top-k of the rows from there on is the page.
    """
    start = (parse_page(page) - 1) * size
    if start < (DEEP_FROM if deep_from is None else deep_from):
        return page_slice(df.orderBy(*as_order(keys)), page, size)
    total = df.count() if total is None else total
    if start >= total:
        return df.limit(0)
    names = [c for c, _ in keys]
    test, skipped = rank_range(df, keys, start, total, most)
    first = df.filter(test).select(*names).orderBy(*as_order(keys)).offset(start - skipped).limit(1).first()
    return df.filter(~before(keys, tuple(first))).orderBy(*as_order(keys)).limit(size)


def paged(df: DataFrame, keys: Keys, page: object = 1, size: int = PAGE_SIZE, total: int | None = None, deep_from: int | None = None) -> DataFrame:
    """A page with its places: ``page_pos`` (from 1, over all pages) and ``total``.

    Only the page's own rows are numbered.
    """
    n = parse_page(page)
    total = df.count() if total is None else total
    kept = keyed_page(df, keys, n, size, total, deep_from)
    place = F.row_number().over(Window.orderBy(*as_order(keys))) + (n - 1) * size
    return kept.withColumns({"page_pos": place.cast("long"), "total": F.lit(total).cast("long")})


def page_numbers(total: int, page: object = 1, size: int = PAGE_SIZE) -> dict[str, int]:
    """First and last row shown, and the number of pages."""
    n = parse_page(page)
    return {"first_row": min((n - 1) * size + 1, total), "last_row": min(n * size, total), "pages": max(1, -(-total // size))}


def phrase_figures(q: str) -> tuple[Column, Column]:
    """How often the phrase stands in a row's phrase text, and the row's number of words."""
    phrase, text = token_text(phrase_term(F.lit(q))), F.col(PHRASE_TEXT)
    hits = (F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.greatest(F.length(phrase), F.lit(1))
    words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(phrase == " ", 0.0).otherwise(hits), words.cast("double")


def relevance(tf: Column, words: Column, n_all: int, n_hit: int, avg_words: float, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = max(math.log((n_all - n_hit + 0.5) / (n_hit + 0.5)), 1e-6) if n_all else 0.0
    return -idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / (avg_words or 1.0))))


def bm25(cat: DataFrame, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Relevance of the rows with the phrase, ascending (better is lower): ``id``, ``score``.

    Frequency counts the phrase in all fields, length the words of all fields;
    equal weights.  The corpus figures come from one aggregate over all rows.
    """
    texts = with_search_text(cat)
    tf, words = phrase_figures(q)
    figures = texts.agg(F.count("*").alias("n"), F.avg(words).alias("words"), F.count_if(tf > 0).alias("hit")).first()
    return texts.filter(tf > 0).select("id", relevance(tf, words, figures["n"], figures["hit"], figures["words"], k1, b).alias("score"))


def keyword_search(cat: DataFrame, q: str, sort: str | None = None, direction: str | None = None, page: object = 1, ranked: bool = True) -> DataFrame:
    """A page of a keyword search: result columns, ``page_pos``, ``total``.

    With a sort, or few hits, in that order; else phrase hits by relevance, then
    the others by id, or all by id where they are not ``ranked``.  One aggregate gives the total and the corpus figures, one
    more pass the page: a row's score needs nothing but the row and the figures.
    """
    texts, test = with_search_text(cat), text_match(q)
    tf, words = phrase_figures(q)
    figures = texts.agg(F.count_if(test).alias("total"), F.count("*").alias("n"), F.avg(words).alias("words"), F.count_if(tf > 0).alias("hit")).first()
    total, found = figures["total"], texts.filter(test)
    if sort in SORT_COLUMNS or total <= SORTED_UP_TO or not ranked:
        order = order_keys(sort, direction, total)
    else:
        found = found.withColumn("_score", F.when(tf > 0, relevance(tf, words, figures["n"], figures["hit"], figures["words"])))
        order = [("_score", False), ("id", False)]
    return paged(found, order, page, total=total).select(*RESULT_COLUMNS, "page_pos", "total")


#: Searched field -> its flip-side column.
B_SIDE = {"artist": "b_side_artist", "title": "b_side_title", "label_number": "b_side_label_number", "matrix_number": "b_side_matrix_number"}
EXACT = {"artist": "artist_norm", "label": "label_norm", "producer": "producer_norm", "riddim": "riddim_norm", "country": "country_norm", "origin": "origin_norm", "genre": "genre_norm", "format": "format_norm"}
SEARCHED = ["artist", "title", "label", "label_number", "matrix_number", "producer", "country", "format", "year", "genre", "riddim", "origin", "notes"]


def field_match(terms: dict[str, str]) -> Column | None:
    """All given fields hold: terms of three characters as substrings, shorter ones exactly."""
    tests = []
    for field in SEARCHED:
        term = (terms.get(field) or "").strip()
        if not term:
            continue
        column = "song_origin" if field == "origin" else field
        if len(term) >= 3:
            test = F.contains(F.lower(F.col(column)), F.lit(term.lower()))
            if field in B_SIDE:
                test = F.coalesce(test, F.lit(False)) | F.contains(F.lower(F.col(B_SIDE[field])), F.lit(term.lower()))
        else:
            test = F.col(EXACT[field]) == term.lower() if field in EXACT else F.col(column) == term
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(and_, tests) if tests else None


def field_search(cat: DataFrame, terms: dict[str, str], sort: str | None = None, direction: str | None = None, page: object = 1) -> DataFrame:
    """A page of a fielded search: result columns, ``page_pos``, ``total``; without a field it is empty."""
    test = field_match(terms)
    found = cat.limit(0) if test is None else cat.filter(test)
    total = found.count()
    return paged(found, order_keys(sort, direction, total), page, total=total).select(*RESULT_COLUMNS, "page_pos", "total")


#: Terms are looked up by pieces of eight signs, shorter terms by pieces of three.
LONG_PIECE, SHORT_PIECE = 8, 3


def pieces(c: Column, size: int) -> Column:
    """The distinct pieces of ``size`` signs, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: Distinct search terms of a bulk search are broadcast up to this many, beyond it joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Queries of one term that a row holds.
TERM_QUERIES = 1_000


def bulk_search(cat: DataFrame, queries: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Substring matches of many queries at once: ``query_id``, ``id``.

    ``near`` gives candidates (``term``, ``id``) for terms, from a stored index
    (:mod:`postings`); what it gives is checked.  Without an index, as follows.

    Distinct terms are looked up once each, by the rarest of their pieces among
    those of all rows: one pass counts the wanted pieces, a second one lists rows
    under the rarest ones.  Where the terms are few enough to be broadcast, a row
    is checked where it is listed, and only its hits leave the task.  The result
    equals :func:`substring_match` query by query.
    """
    asked = queries.select("query_id", substring_term(F.col("q")).alias("term")).filter(F.length("term") >= SHORT_PIECE)
    asked = stored(asked.distinct(), "asked")
    terms = asked.select("term").distinct()
    rows = with_search_text(cat).select("id", F.col(SUBSTRING_TEXT).alias("text"))
    if near:
        hits = near(terms).join(rows, "id").filter(F.contains("text", F.col("term"))).select("term", "id")
        return _by_query(hits, asked)
    rows = rows.repartition("id")  # a table of few files keeps all tasks busy
    figures = terms.agg(F.count("*").alias("n"), F.count_if(F.length("term") < LONG_PIECE).alias("short")).first()
    sizes = [SHORT_PIECE] * (figures["short"] > 0) + [LONG_PIECE] * (figures["short"] < figures["n"])
    few = figures["n"] <= BROADCAST_TERMS
    side = F.broadcast if few else lambda df: df.hint("merge")
    each = F.explode(F.concat(*[pieces(F.col("text"), n) for n in sizes or [SHORT_PIECE]])).alias("g")
    own = F.when(F.length("term") < LONG_PIECE, pieces(F.col("term"), SHORT_PIECE)).otherwise(pieces(F.col("term"), LONG_PIECE))
    wanted = terms.select("term", F.explode(own).alias("g"))
    counts = rows.select(each).join(side(wanted.select("g").distinct()), "g", "left_semi").groupBy("g").count()
    known = wanted.join(counts, "g").groupBy("term").agg(F.min(F.struct("count", "g")).alias("best"))
    best = stored(known.select("term", F.col("best.g").alias("g")), "best")
    if few:
        hits = rows.select("id", "text", each).join(F.broadcast(best), "g").filter(F.contains("text", F.col("term"))).select("term", "id")
    else:
        hits = rows.select("id", each).join(side(best), "g").select("term", "id").join(rows, "id").filter(F.contains("text", F.col("term"))).select("term", "id")
    return _by_query(hits, asked)


def _by_query(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of each query, from those of each term; pairs are made last, in lists of a term's queries, and not shuffled.

    Hits alone are made distinct.  Only where a query has several terms, its pairs
    could come twice, so that they are made distinct, too.
    """
    hits = stored(hits.distinct(), "hits")
    asked = asked.select("term", F.struct("query_id").alias("_q"))  # a struct: null is a query like all others
    several = stored(asked.groupBy("_q").agg(F.count("*").alias("n")).filter("n > 1").select("_q"), "several")
    mixed = several.limit(1).count() > 0
    one = asked.join(sized(several), "_q", "left_anti") if mixed else asked
    figures = one.groupBy("term").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    part = F.pmod(F.xxhash64("_q"), F.lit(-(-(figures["most"] or 1) // TERM_QUERIES)))
    lists = one.groupBy("term", part.alias("_part")).agg(F.collect_list("_q").alias("_queries"))
    if (figures["n"] or 0) <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(lists), "term")
    else:  # a common term's hits go to many tasks
        met = grid_join(hits, stored(lists, "term_queries"), ["term"], "id", "_part")
    pairs = met.select(F.explode("_queries").alias("_q"), "id").select("_q.query_id", "id")
    if not mixed:
        return pairs
    rest = hits.join(sized(asked.join(sized(several), "_q", "left_semi")), "term").select("_q.query_id", "id").distinct()
    return pairs.unionByName(rest)


def record_by_id(cat: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given ids, all source columns; unknown ids give none."""
    return cat.join(ids.select("id").distinct(), "id", "left_semi")
