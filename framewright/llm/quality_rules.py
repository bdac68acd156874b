"""Quality rules by distribution divergence, with DataFrame operations only.

A document's histogram of character classes and of common words is compared to those of each language in the corpus
by Jensen-Shannon distance (base 2, so 0 to 1); the nearest reference counts. References are sums over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

# Common words of English, French, German and Spanish.
COMMON_WORDS = sorted(
    set(
        """the of and to a in is that it for was on with as be by are this at from
        de la le et les en des un du une que est pour par dans avec qui pas sur au
        der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als
        de la que el en y los las se del un por con no una su para es al lo""".split()
    )
)
#: Distances beyond which a document is turned away, and what it must have for either to be asked.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.30, 0.50
LEAST_CHARS, LEAST_WORDS = 200, 50
#: References written into the expression; more of them become a broadcast row, so that the plan doesn't grow with them.
LITERAL_LANGUAGES = 64

#: Bits of a packed window that its hash gives up besides those of the position; only tests give up any.
SPARE_BITS = 0

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _occurrences(text: Column, char_class: str) -> Column:
    return F.size(F.split(text, char_class)) - 1


def _windows(h: Column, bits: Column) -> Column:
    """Hash and position of every 3-word window in one long, so that a primitive sort brings equal windows side by side.

    h: hashes of the words; bits: as many as a position needs.
    """
    n = F.size(h)
    packed = lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.xxhash64(h[i], h[i + 1], h[i + 2]), bits), bits).bitwiseOR(i.cast("long"))
    return F.when(n < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), packed))


def _neighbours(sorted_array: Column, pair) -> Column:
    """pair(a, b) of each element and the next one, where that isn't null."""
    most = F.greatest(F.size(sorted_array) - 1, F.lit(0))
    return F.filter(F.zip_with(F.slice(sorted_array, 1, most), F.slice(sorted_array, 2, most), pair), lambda p: p.isNotNull())


def _equal_windows(h: Column, windows: Column, bits: Column) -> tuple[Column, Column]:
    """Places (a, b) of neighbours among the packed windows that have equal hashes, and whether all of them are equal."""
    key = lambda x: F.call_function("shiftrightunsigned", x, bits)
    place = lambda x: (x - F.call_function("shiftleft", key(x), bits)).cast("int")
    pairs = _neighbours(windows, lambda a, b: F.when(key(a) == key(b), F.struct(place(a).alias("a"), place(b).alias("b"))))
    same = lambda p: (h[p["a"]] == h[p["b"]]) & (h[p["a"] + 1] == h[p["b"] + 1]) & (h[p["a"] + 2] == h[p["b"] + 2])
    return pairs, F.forall("pairs", same)


def _equal_triples(h: Column) -> Column:
    """The same places with nothing packed: windows sorted by the hashes of their three words."""
    triple = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.struct(F.struct(h[i], h[i + 1], h[i + 2]).alias("w"), i.alias("at"))))
    return _neighbours(triple, lambda a, b: F.when(a["w"] == b["w"], F.struct(a["at"].alias("a"), b["at"].alias("b"))))


def features(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """All columns of docs in the struct `doc`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    the histograms `classes` (space, bytes beyond ASCII, symbols, digits, punctuation, the rest) and `common`
    (COMMON_WORDS in hash order, then all other words)."""
    spark = docs.sparkSession
    codes = sorted(r[0] for r in spark.createDataFrame([(w,) for w in COMMON_WORDS], "w string").select(F.xxhash64("w")).collect())
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc", "text", words_of(text).alias("words"))
    rows = rows.select("doc", "text", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc", "text", "h", "word_chars",
        F.size("h").cast("long").alias("n_words"),
        (F.length(F.bin(F.size("h"))) + SPARE_BITS).alias("bits"),
        _occurrences(text, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.sort_array(F.concat(F.filter("h", lambda x: x.isin(codes)), F.array(*map(F.lit, codes)).cast("array<long>"))).alias("found"),
    )
    if repeats:
        rows = rows.withColumn("windows", F.sort_array(_windows(F.col("h"), F.col("bits"))))
        pairs, exact = _equal_windows(F.col("h"), F.col("windows"), F.col("bits"))
        # A position takes bits from the hash, so the words decide; where they differ, the text is sorted anew by its words.
        rows = rows.withColumn("pairs", pairs).withColumn("pairs", F.when(exact, F.col("pairs")).otherwise(_equal_triples(F.col("h"))))
        starts = F.array_distinct(F.concat(F.transform("pairs", lambda p: p["a"]), F.transform("pairs", lambda p: p["b"])))
        rows = rows.withColumn("starts", starts)
        covered = F.concat("starts", F.transform("starts", lambda p: p + 1), F.transform("starts", lambda p: p + 2))
        rows = rows.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long"))
    else:
        rows = rows.withColumn("n_repeat_words", F.lit(None).cast("long"))
    chars, spaces = F.length("text"), F.length("text") - F.col("word_chars")
    extra = F.octet_length("text") - chars
    digits, marks = _occurrences(text, "[0-9]"), _occurrences(text, r"[!\x22'()+,./:;=?@\[\\\]^_`{}~-]")
    rest = F.greatest(F.lit(0), chars - spaces - extra - F.col("n_symbols") - digits - marks)
    at = [F.array_position("found", F.lit(c)) for c in codes] + [F.size("found") + 1]
    counts = [b - a - 1 for a, b in zip(at, at[1:], strict=False)]
    other = F.col("n_words") - (F.size("found") - len(codes))
    made = {
        "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "classes": F.array(*(x.cast("double") for x in (spaces, extra, F.col("n_symbols"), digits, marks, rest))),
        "common": F.array(*(x.cast("double") for x in (*counts, other))),
    }
    rows = rows.select("doc", *(v.alias(k) for k, v in made.items()))
    # A generator of one row of plain columns: filters stay above it, or they would repeat all of the above in each use.
    return rows.select("doc", F.explode(F.array(F.struct(*made))).alias("made")).select("doc", "made.*")


def references(found: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Class and common-word shares of each language, summed over all documents."""
    n_classes, n_common = 6, len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(n_common)]
    rows = found.where(F.col("doc.lang").isNotNull()).groupBy(F.col("doc.lang").alias("lang")).agg(F.sum("n_words").alias("n"), *sums).where("n > 0").orderBy(F.desc("n"), "lang").collect()
    share = lambda v: [x / (sum(v) or 1.0) for x in v]
    return [(share([r[f"c{i}"] for i in range(n_classes)]), share([r[f"w{i}"] for i in range(n_common)])) for r in rows]


def _distance(counts: Column, total: Column, shares: list[float] | Column) -> Column:
    def term(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    both = F.aggregate(F.zip_with(counts, shares if isinstance(shares, Column) else F.array(*map(F.lit, shares)), term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), both / 2))


def judge(found: DataFrame, known: list[tuple[list[float], list[float]]]) -> DataFrame:
    """found with class_distance, word_distance (null where the length guards hold or nothing is known), base_failed and kept."""
    chars = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)
    nearest = lambda column, total, which: F.least(*[_distance(F.col(column), total, k[which]) for k in known]) if len(known) > 1 else (_distance(F.col(column), total, known[0][which]) if known else F.lit(None).cast("double"))
    if len(known) > LITERAL_LANGUAGES:
        row = found.sparkSession.createDataFrame([tuple([k[which] for k in known] for which in (0, 1))], "known0 array<array<double>>, known1 array<array<double>>")
        found = found.crossJoin(F.broadcast(row))
        nearest = lambda column, total, which: F.array_min(F.transform(f"known{which}", lambda q: _distance(F.col(column), total, q)))
    out = found.withColumn("chars", chars).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    asked = F.col("n_words") >= LEAST_WORDS
    out = out.withColumn("class_distance", F.when((F.col("chars") >= LEAST_CHARS) & asked, nearest("classes", F.col("chars"), 0)))
    out = out.withColumn("word_distance", F.when(asked, nearest("common", F.col("n_words").cast("double"), 1)))
    near = F.coalesce(F.col("class_distance") <= MOST_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MOST_WORD_DISTANCE, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("chars", "known0", "known1")


def quality_rules(docs: DataFrame) -> DataFrame:
    """All columns of docs in the struct `doc`, the counts of features(), base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows that repeat. kept also asks
    that the document's nearest language reference be within MOST_CLASS_DISTANCE and MOST_WORD_DISTANCE.
    Null and empty texts have no words and fail. A null lang adds to no reference; such a document is still judged.
    Without any reference the distances turn nothing away. Repeated rows are judged one by one; an empty table gives
    an empty table; further columns stay inside `doc`.
    """
    known = references(features(docs.select("text", "lang"), repeats=False))
    return judge(features(docs), known)
