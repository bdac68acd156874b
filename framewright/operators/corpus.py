"""Consistency checks and text shaping for collections of papers, notes and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a paper and what a preprint number look like.
PAPER, NUMBER = r"paper_\d{3}", r"(?:1[5-9]|2\d)\d{2}\.\d{5}"

# A text is read as a row of pieces, whichever of these comes first at a place: a finished link, a group in brackets that
# names a paper, a paper with further numbers behind slashes, a word (with the bracket before it) up to the next paper,
# and any other character.
LINK, GROUP, CHAIN = r"\[[^\]]*\]\([^)]*\)", rf"\[[^\[\]]*{PAPER}[^\[\]]*\]", rf"{PAPER}(?:/\d{{3}})*"
PIECES = rf"{LINK}|{GROUP}|{CHAIN}|\[?[\w./]+?(?={PAPER}|[^\w./]|$)|[\s\S]"


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing): rows in which a field is null or empty."""
    counts = rows.agg(*(F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields))).alias("x")).select("x.*")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that occur more than once."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distribution(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def missing_headings(notes: DataFrame, headings: list[str]) -> DataFrame:
    """(heading, missing) over notes (name, text)."""
    counts = notes.agg(*(F.count_if(~F.coalesce(F.contains("text", F.lit(h)), F.lit(False))).alias(f"h{i}") for i, h in enumerate(headings)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(h).alias("heading"), F.col(f"h{i}").alias("missing")) for i, h in enumerate(headings)))).alias("x")).select("x.*")


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of two collections has."""
    left = a.select(key).distinct()
    right = b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def mentions(texts: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """Distinct matches of a pattern (its whole, or its first group) over all texts, as `id`."""
    group = 1 if "(" in pattern.replace("(?", "") else 0
    return texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), group)).alias("id")).distinct()


def level_counts(texts: DataFrame, levels: list[str], column: str = "text") -> DataFrame:
    """(level, n): table cells that hold a level and nothing else."""
    counts = [F.coalesce(F.sum(F.regexp_count(column, F.lit(rf"\| {v} \|"))), F.lit(0)).cast("long").alias(f"l{i}") for i, v in enumerate(levels)]
    return texts.agg(*counts).select(F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"l{i}").alias("n")) for i, v in enumerate(levels)))).alias("x")).select("x.*")


def matrix_rows(text: DataFrame) -> DataFrame:
    """(section, paper, cells) of the table rows of a Markdown text (doc, line, text) whose first cell is a paper, under
    its last second-level heading."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.regexp_extract("text", "^## (.+)$", 1)
    x = text.withColumn("section", F.last(F.when(heading != "", heading), ignorenulls=True).over(w))
    cells = F.transform(F.slice(F.split("text", r"\|"), 2, 100), lambda c: F.trim(c))
    paper = F.regexp_extract(F.col("cells")[0], r"^\[?(paper_\d+)\]?(?:\([^)]*\))?$", 1)
    return x.where(F.col("text").startswith("|")).withColumn("cells", F.slice(cells, 1, F.size(cells) - 1)).withColumn("paper", paper).where("paper != ''").select("section", "paper", "cells")


def squeezed(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def from_inverted(index: Column) -> Column:
    """The text of a map from words to their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def paper_id(url: Column) -> Column:
    """The last part of an address, without a version."""
    return F.regexp_replace(F.substring_index(url, "/", -1), r"v\d+$", "")


def same_path(path: Column) -> Column:
    """A path with forward slashes, without ./ and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(^|/)\./", "$1"), "/{2,}", "/")


def linked(text: Column, address: str = "https://example.org/") -> Column:
    """Papers (paper_001), chains of any length (paper_001/002/003), groups in brackets ([paper_001, Sec 2]) and numbers
    (2401.01234) as links. A finished link is a piece of its own and stays, so doing it twice changes nothing."""
    link = lambda name: F.concat(F.lit("["), name, F.lit(f"]({address}"), name, F.lit(")"))
    papers = lambda chain: F.array_join(F.transform(F.regexp_extract_all(chain, F.lit(r"\d{3}"), 0), lambda n: link(F.concat(F.lit("paper_"), n))), ", ")
    item = lambda x: F.when(x.rlike(f"^{PAPER}$"), link(x)).otherwise(x)
    items = lambda group: F.array_join(F.transform(F.split(F.regexp_replace(group, r"^\[|\]$", ""), ","), lambda x: item(F.trim(x))), ", ")
    number = lambda word: F.regexp_extract(word, rf"^({NUMBER})(?!\d|\.\w)", 1)

    def shown(piece: Column) -> Column:
        word = F.when(number(piece) != "", F.concat(link(number(piece)), F.substring(piece, 11, 1 << 20))).otherwise(piece)
        return F.when(piece.rlike(f"^{LINK}$"), piece).when(piece.rlike(f"^{GROUP}$"), items(piece)).when(piece.rlike(f"^{CHAIN}$"), papers(piece)).otherwise(word)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), 0), shown), "")


def entries_of_feed(xml: Column) -> Column:
    """Entries (id, title, summary, published) of an Atom feed held as text."""
    schema = "entry array<struct<id: string, title: string, summary: string, published: string>>"
    return F.from_xml(xml, schema)["entry"]


def works_of(reply: Column) -> Column:
    """Works (id, title, year, venue, abstract) of a search reply held as JSON; what is absent is null."""
    schema = "results array<struct<id: string, title: string, publication_year: int, primary_location: struct<source: struct<display_name: string>>, abstract_inverted_index: map<string, array<int>>>>"
    return F.transform(
        F.from_json(reply, schema)["results"],
        lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["publication_year"].alias("year"), r["primary_location"]["source"]["display_name"].alias("venue"), from_inverted(r["abstract_inverted_index"]).alias("abstract")),
    )
