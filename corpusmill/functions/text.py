"""What search results show: blobs, snippets, highlights, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import between, bound, chunked, running
from .fold import fold

BEFORE, WINDOW, PLAIN = 130, 420, 360


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def blob(*fields: Column) -> Column:
    """Non-empty fields joined by a space and folded."""
    return fold(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))


def first_hit(folded: Column, needles: list[str]) -> Column:
    """0-based place of the first needle, in the order given, that occurs; -1 if none does."""
    places = [F.nullif(F.instr(folded, n), F.lit(0)) for n in needles]
    return F.coalesce(*places, F.lit(0)) - 1 if places else F.lit(-1)


def snippet(source: Column, needles: list[str]) -> Column:
    """A window around the first hit; without needles the start of the text."""
    if not needles:
        return F.substring(source, 1, PLAIN)
    start = bound(fold(source), lambda f: F.greatest(first_hit(f, needles) - BEFORE, F.lit(0)))
    return bound(start, lambda at: F.concat(F.when(at > 0, F.lit("...")).otherwise(F.lit("")), F.substring(source, at + 1, F.lit(WINDOW))))


RANGES = "struct<low:int,high:int>"


def hit_ranges(folded: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a needle as structs (low, high), 0-based, end exclusive."""
    parts = F.split(folded, "\\Q" + needle + "\\E", -1)
    gaps = bound(parts, lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))

    def step(at: Column, gap: Column) -> tuple[Column, Column]:
        low = at + F.length(gap)
        return low + len(needle), F.struct(low.alias("low"), (low + len(needle)).alias("high"))

    return running(gaps, F.lit(0), step, RANGES)["out"]


def merge_ranges(ranges: Column) -> Column:
    """Ranges of one row sorted, with those that touch or overlap merged; of many rows: operators.state.islands."""

    def step(last: Column, r: Column) -> tuple[Column, Column]:
        apart = last.isNull() | (r["low"] > last["high"])
        grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))
        return F.when(apart, r).otherwise(grown), F.when(apart, last)

    ended = running(F.array_sort(ranges), F.lit(None).cast(RANGES), step, RANGES)
    return bound(ended, lambda e: F.filter(F.concat(e["out"], F.array(e["state"])), lambda r: r.isNotNull()))


def highlight(raw: Column, needles: list[str]) -> Column:
    """The raw text, escaped, with every needle's occurrences in the folded text marked."""
    if not needles:
        return escape_html(raw)
    ordered = sorted(set(needles), key=lambda n: (-len(n), n))
    return bound(raw, lambda text: _marked(text, bound(fold(text), lambda f: merge_ranges(F.concat(*[hit_ranges(f, n) for n in ordered])))))


def _marked(raw: Column, ranges: Column) -> Column:
    def pieces(x: Column) -> Column:
        part = lambda low, high: escape_html(between(x["chunks"], low, high))
        step = lambda at, r: (r["high"], F.concat(part(at, r["low"]), F.lit("<mark>"), part(r["low"], r["high"]), F.lit("</mark>")))
        made = running(x["ranges"], F.lit(0), step, "string")
        return bound(made, lambda m: F.concat(F.array_join(m["out"], ""), part(m["state"], F.length(raw))))

    return bound(F.struct(chunked(raw).alias("chunks"), ranges.alias("ranges")), pieces)


def url_part(value: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def view_url(file_id: Column, base: str = "https://files.example/d/") -> Column:
    return F.concat(F.lit(base), url_part(file_id), F.lit("/view"))


def preview_url(file_id: Column, base: str = "https://files.example/d/") -> Column:
    return F.concat(F.lit(base), url_part(file_id), F.lit("/preview"))


def disposition(path: Column) -> Column:
    """How a file is sent: shown for pdf and txt, else as an attachment."""
    return F.when(F.lower(path).rlike("\\.(pdf|txt)$"), F.lit("inline")).otherwise(F.lit("attachment"))


def preview_kind(path: Column) -> Column:
    return F.when(F.lower(path).rlike("\\.(doc|docx|txt|rtf)$"), F.lit("text")).otherwise(F.lit("file"))


def date_phrase(month: str, year: str) -> str:
    """The phrase that stands for a date filter; a month without a year filters nothing."""
    return "" if not year else f"{month} de {year}".strip() if month else f"de {year}"


TOKENS = 42
#: A token of a raw text is what fold.terms finds in the folded one: accents written apart belong to their letter.
TOKEN = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\u0300-\\u036F]*"
HIT, NEVER = "struct<place:int,word:int>", 2**31 - 1


def _best(hits: Column, n_words: int, size: int) -> Column:
    """(found, -place): the most different words that size tokens from a hit on hold, and the earliest such hit.

    Hits are met from the last to the first with the next place of each word, so the time is in proportion to hits and words.
    """

    def step(ahead: Column, hit: Column) -> tuple[Column, Column]:
        now = F.transform(ahead, lambda x, i: F.when(i == hit["word"], hit["place"]).otherwise(x))
        found = F.size(F.filter(now, lambda x: x - size < hit["place"]))
        return now, F.struct(found.alias("found"), (-hit["place"]).alias("before"))

    zero = F.array(*[F.lit(NEVER)] * max(n_words, 1))
    none = F.struct(F.lit(0).alias("found"), F.lit(0).alias("before"))
    return F.coalesce(F.array_max(running(F.reverse(hits), zero, step, "struct<found:int,before:int>")["out"]), none)


def placed_snippet(raw: Column, hits: Column, n_words: int, size: int = TOKENS) -> Column:
    """(found, snippet) of a text whose hits (place, word) are known, as an array of HIT in any order; of two words at a place the
    first counts. Without hits the snippet is the beginning; a null text has none, and null hits are none.
    """

    def cut(x: Column) -> Column:
        n = F.size(x["tokens"])
        at = F.greatest(F.lit(0), F.least(-x["best"]["before"], n - size))
        near = F.transform(F.filter(x["hits"], lambda h: (h["place"] >= at) & (h["place"] < at + size)), lambda h: h["place"])

        def chosen(c: Column) -> Column:
            token = lambda i: F.get(x["tokens"], i)
            shown = lambda i: F.when(F.array_contains(c["near"], i), F.concat(F.lit("<mark>"), token(i), F.lit("</mark>"))).otherwise(token(i))
            parts = F.transform(F.sequence(c["at"], F.least(c["at"] + size, n) - 1), lambda i: F.concat(F.when(i > c["at"], F.get(x["gaps"], i)).otherwise(F.lit("")), shown(i)))
            return F.concat(F.when(c["at"] > 0, F.lit("...")).otherwise(F.get(x["gaps"], F.lit(0))), F.array_join(parts, ""), F.when(c["at"] + size < n, F.lit("...")).otherwise(F.get(x["gaps"], n)))

        whole = F.when(n == 0, x["raw"]).otherwise(bound(F.struct(at.alias("at"), near.alias("near")), chosen))
        return F.when(x["raw"].isNotNull(), F.struct(x["best"]["found"].alias("found"), whole.alias("snippet")))

    def told(x: Column) -> Column:
        first = F.filter(x["sorted"], lambda h, i: (i == 0) | (F.get(x["sorted"], i - 1)["place"] != h["place"]))
        return bound(first, lambda h: bound(F.struct(x["raw"].alias("raw"), x["tokens"].alias("tokens"), x["gaps"].alias("gaps"), h.alias("hits"), _best(h, n_words, size).alias("best")), cut))

    known = F.coalesce(hits.cast(f"array<{HIT}>"), F.array().cast(f"array<{HIT}>"))
    made = F.struct(raw.alias("raw"), F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split(raw, TOKEN, -1).alias("gaps"), F.array_sort(known).alias("sorted"))
    return bound(made, told)


def token_snippet(source: Column, words: list[str], size: int = TOKENS, *others: Column) -> Column:
    """The run of size tokens with most different query words (prefixes; the earliest such run), its hits marked.

    Ellipses stand for what is cut off. Of several columns the one that holds most words counts, the first of those that hold as
    many; null if all are null. It runs in the JVM and reads each token; `TextIndex.snippets` takes the places from postings instead.
    """

    def of(raw: Column) -> Column:
        tokens = F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0))
        word = lambda t: F.coalesce(*[F.when(t.startswith(w), F.lit(i)) for i, w in enumerate(words)], F.lit(-1))
        met = F.transform(tokens, lambda t, i: F.struct(i.alias("place"), bound(fold(t), word).alias("word")))
        return placed_snippet(raw, F.filter(met, lambda h: h["word"] >= 0), len(words), size)

    found = F.array(*[of(c) for c in (source, *others)])
    better = lambda best, x: F.when(best.isNull() | (x["found"] > best["found"]), x).otherwise(best)
    none = F.lit(None).cast("struct<found:int,snippet:string>")
    return F.aggregate(found, none, better)["snippet"]
