"""Spelling variant grouping by a rare-first q-gram prefix filter.

Words are counted over all documents. A word of m code points has m - 1 positional bigrams. One inserted, deleted or replaced
code point leaves all but two of them, so of two words that are near, ordered by one global order (how many distinct words hold
the bigram, rarest first, then the bigram, then its place), one of the first three bigrams of each is the same and untouched:
their least untouched bigram is preceded by two touched ones at most on either side. So words are joined by their three rarest
bigrams alone. An untouched bigram keeps its place, or moves by one with the length; and as the one edit lies on one side of it,
all that is on the other side is equal too, which is part of the join's key. What meets is verified by edit distance.

Runs of letters (A-Z, a-z, U+00C0-U+00FF) are the occurrences; A-Z are lower-cased. With h the unsigned crc32 of the UTF-8 of
`<doc_id>:<run>`, a run whose h is divisible by TYPO loses the code point h % length. Bigrams are of 90 letters, so their
counts (8,100 at most) are one constant of the plan. Forms are followed by pointer doubling: a form occurs at least twice as
often, so chains end.

Null text: none. Null doc_id: an empty string before the colon. Repeated documents: each counts. Very long texts: a task holds the
runs of one text at a time. Ties: words of equal counts go by code-point order. Empty tables give no rows. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

TYPO, LETTERS, OCCURRENCES, PREFIX = 97, 5, 3, 3
# The runs, and the letters that are lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = 26 + 64


def words(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of so many letters with so many occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= letters)
    low = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.left("run", at), F.substr("run", at + 2))
    told = low.withColumn("h", h).select(F.when(F.col("h") % TYPO == 0, typo).otherwise(F.col("run")).alias("word"))
    return told.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter(word: Column, at: Column) -> Column:
    """0 to ALPHABET - 1."""
    code = F.ascii(F.substr(word, at + 1, F.lit(1)))
    return F.when(code < 128, code - 97).otherwise(code - 0xC0 + 26)


def bigram(word: Column, at: Column) -> Column:
    return letter(word, at) * ALPHABET + letter(word, at + 1)


def places(word: Column) -> Column:
    return F.sequence(F.lit(0), F.length(word) - 2)


def rarest(own: DataFrame) -> DataFrame:
    """(word, n, at): the places of each word's PREFIX rarest bigrams."""
    held = own.select(F.explode(F.array_distinct(F.transform(places(F.col("word")), lambda i: bigram(F.col("word"), i)))).alias("b")).groupBy("b").count().collect()  # ALPHABET^2 rows at most
    counts = [0] * ALPHABET * ALPHABET
    for r in held:
        counts[r["b"]] = r["count"]
    table = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<long>")
    ranked = F.transform(places(F.col("word")), lambda i: F.struct(F.get(table, bigram(F.col("word"), i)).alias("count"), bigram(F.col("word"), i).alias("b"), i.alias("at")))
    return own.select("word", "n", F.explode(F.slice(F.array_sort(ranked), 1, PREFIX)["at"]).alias("at"))


def near_pairs(own: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words that differ by one code point, once; the shorter or lesser one first.

    Words meet by digests of what they must share; edit distance decides.
    """
    at, size = F.col("at"), F.length("word")
    # an edit changes how many of the letters occur an odd number of times: by one if the length changes, else by none or two
    odd = F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), lambda i: letter(F.col("word"), i) % 64), F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))
    rows = materialize(rarest(own).withColumns({"size": size, "head": F.left("word", at + 2), "tail": F.substr("word", at + 1), "odd": odd}), "prefixes")

    def keys(far: int) -> Column:
        """Digests of what two words share: how much longer the other is, the untouched bigram's place, and all on its one side.

        far: 1 for the shorter word, which says where the longer one has it; 0 for that.
        """
        one = lambda more, part, moved: F.xxhash64(F.lit(more), F.lit(part), F.col("size") + far * more, at + far * moved, part)
        return F.array(*[F.struct(F.lit(more).alias("more"), one(more, part, moved).alias("key")) for more in (0, 1) for part, moved in (("head", 0), ("tail", more))])

    side = lambda far, name: rows.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"), F.explode(keys(far)).alias("k")).select(name, f"n_{name}", f"odd_{name}", "k.*")
    changed = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b")))
    like = F.when(F.col("more") == 1, changed == 1).otherwise((F.col("a") < F.col("b")) & (changed <= 2))
    met = side(1, "a").join(side(0, "b"), ["more", "key"]).where(like)
    verified = met.where(F.levenshtein("a", "b", 1) == 1)
    return verified.select("a", "n_a", "b", "n_b").distinct()


def forms(own: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of own (word, n): a near word of largest n that is at least twice the word's."""
    pairs = near_pairs(own)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    told = own.join(best, "word", "left")
    ok = -F.col("best.m") >= 2 * F.col("n")
    return told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best.near")).alias("form"), F.when(ok, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """found with root: the last of the forms that follow from a word; the word itself if it has none."""
    links = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        # every chain is half as long
        more = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(links.join(more, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(links)
        links, moved = after.drop("moved"), not after.where("moved").isEmpty()
        links._corpusmill_path = after._corpusmill_path
        if not moved:
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of docs (doc_id, text)."""
    own = materialize(words(docs), "vocabulary")
    return rooted(materialize(forms(own), "near"))
