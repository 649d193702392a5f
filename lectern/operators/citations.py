"""In-text citations, and the links of chunks to references, figures, tables and formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.classify import is_reference_title

# What counts as a mark of a citation, figure, table or formula.
NUMERIC = r"\[(\d+(?:[,\-\s]+\d+)*)\]"
_NAME = r"[A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?"
AUTHOR_YEAR = rf"({_NAME})\s*,\s*(\d{{4}}[a-z]?)|({_NAME})\s+\((\d{{4}}[a-z]?)\)|\(({_NAME})\s+(\d{{4}}[a-z]?)\)"
GROUP = r"[\[(]([^\])]*;[^\])]*)[\])]"
IN_GROUP = r"([A-Z][A-Za-z'’-]+)[^;]*?(\d{4}[a-z]?)"
FIGURE = r"(?i)(?:figures?|figs?\.?|图)\s*([A-Za-z]?\d+[A-Za-z]?(?:-?\d+)?)"
TABLE = r"(?i)(?:tables?|tab\.|表)\s*([A-Za-z]?\d+[A-Za-z]?(?:-?\d+)?)"
FORMULA = [r"(?i)(?:Equation|式)\s*\((\d+)\)", r"(?i)Eq\.?\s*(\d+)", r"\((\d+)\)(?!\s*[,\.])"]
TITLES = ["dr", "jr", "md", "phd", "sr"]


def surname_of(authors: Column | str) -> Column:
    """The first author's surname of an author list: the first of its candidates that is no title.

    Candidates are the last two words before "et al", the word after an initial, and the last two words of the first name (up
    to "and", "&" or a comma). If all are titles, the last candidate there is."""
    whole = F.trim(F.col(authors) if isinstance(authors, str) else authors)
    words = lambda x: F.filter(F.transform(F.split(x, r"\s+"), lambda w: F.regexp_replace(w, "[.,]+$", "")), lambda w: w != "")
    listed, name = words(F.regexp_extract(whole, r"(?is)^(.*?)\s+et\s+al", 1)), F.regexp_extract(whole, r"(?s)^(.*?)(?: and |&|,|$)", 1)
    first, at = words(name), F.try_element_at
    initial = F.when(name.rlike(r"^\s*\p{Lu}.?(?=\s)"), at(first, F.lit(2)))
    candidates = F.filter(F.array(at(listed, F.lit(-1)), at(listed, F.lit(-2)), initial, at(first, F.lit(-1)), at(first, F.lit(-2))), lambda w: w.isNotNull())
    return F.coalesce(at(F.filter(candidates, lambda w: ~F.lower(w).isin(TITLES)), F.lit(1)), at(candidates, F.lit(-1)))


def expand_numbers(group: Column) -> Column:
    """"1, 2-4" -> [1, 2, 3, 4]; a range needs its hyphen between the numbers, without spaces."""
    pieces = F.filter(F.split(group, r"[,\s]+"), lambda p: p.rlike(r"\d"))
    one = lambda p: F.when(p.rlike(r"^\d+-\d+$"), F.when(F.split(p, "-")[1].cast("int") >= F.split(p, "-")[0].cast("int"), F.sequence(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(F.transform(F.filter(F.split(p, "-"), lambda x: x != ""), lambda x: x.cast("int")))
    return F.flatten(F.transform(pieces, one))


def numeric_citations(chunks: DataFrame, ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row for each cited number: the id, order among the chunk's marks, the mark, and ref_no."""
    marks = chunks.select(ident, F.posexplode(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1))).alias("mark_no", "inside"))
    return marks.select(ident, "mark_no", F.concat(F.lit("["), "inside", F.lit("]")).alias("raw_text"), F.explode(expand_numbers(F.col("inside"))).alias("ref_no"))


def cited_references(chunks: DataFrame, references: DataFrame, ident: str = "chunk_id") -> DataFrame:
    """Per chunk the sorted distinct ref_ids it cites by number; ids that the paper's list lacks are dropped.

    chunks: id, paper_id, text; references: paper_id, ref_id (ref_<n>)."""
    cited = numeric_citations(chunks, ident).join(chunks.select(ident, "paper_id"), ident).select(ident, "paper_id", F.concat(F.lit("ref_"), "ref_no").alias("ref_id")).distinct()
    return cited.join(references.select("paper_id", "ref_id").distinct(), ["paper_id", "ref_id"]).groupBy(ident).agg(F.sort_array(F.collect_set("ref_id")).alias("ref_ids"))


def places(text: Column, pattern: str) -> Column:
    """All matches of a pattern with the number of characters before them: array of (at, hit)."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at: int, hit: string>>").alias("out"))
    step = lambda s, x: F.struct((s["end"] + x["gap"] + F.length(x["hit"])).alias("end"), F.array_append(s["out"], F.struct((s["end"] + x["gap"]).alias("at"), x["hit"].alias("hit"))).alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), start, step, lambda s: s["out"])


def _cited(author: Column, year: Column, position: Column) -> Column:
    return F.struct(author.alias("author"), year.alias("year"), position.alias("position"))


def author_years(text: Column) -> Column:
    """(author, year, position) of author-year citations in order; lists in brackets are taken apart at ; ."""
    groups = places(text, GROUP)
    # what stands between a list's brackets and semicolons
    pieces = lambda g: F.transform(places(F.substring(g["hit"], F.lit(2), F.length(g["hit"]) - 2), r"[^;]+"), lambda p: F.struct((p["at"] + g["at"] + 1).alias("at"), p["hit"].alias("hit")))
    cut = F.filter(F.flatten(F.transform(groups, pieces)), lambda p: p["hit"].rlike(IN_GROUP))
    part = lambda p, i: F.regexp_extract(p["hit"], IN_GROUP, i)
    listed = F.transform(cut, lambda p: _cited(part(p, 1), part(p, 2), p["at"] + F.length(F.split(p["hit"], IN_GROUP, 2)[0])))
    free = F.filter(places(text, AUTHOR_YEAR), lambda m: ~F.exists(groups, lambda g: (m["at"] >= g["at"]) & (m["at"] < g["at"] + F.length(g["hit"]))))
    one = lambda m, of: F.coalesce(*[F.nullif(F.regexp_extract(m["hit"], AUTHOR_YEAR, i), F.lit("")) for i in of])
    alone = F.transform(free, lambda m: _cited(one(m, (1, 3, 5)), one(m, (2, 4, 6)), m["at"]))
    return F.array_sort(F.concat(listed, alone), lambda x, y: x["position"] - y["position"])


def author_year_citations(chunks: DataFrame, ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row for each author-year citation, with 50 characters of context on both sides."""
    rows = chunks.select(ident, text, F.explode(author_years(F.col(text))).alias("c")).select(ident, text, "c.*")
    return rows.select(ident, "author", "year", "position", tx.context(text, F.col("position"), F.length("author")).alias("context"))


def resolve_author_year(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ref_id: the author as cited, then its surname; of references that share a key the last wins.

    citations: paper_id, author, year; references: paper_id, ref_id, ref_authors, ref_year, ord."""
    base = references.withColumn("name", F.lower(surname_of("ref_authors"))).where("name is not null and ref_year is not null")
    keys = F.array(*[F.concat("name", F.lit(mid), F.col("ref_year").cast("string"), F.lit(s)) for mid in ("", " et al.") for s in ("", "a", "b")])
    table = base.select("paper_id", "ref_id", "ord", F.explode(keys).alias("key")).groupBy("paper_id", "key").agg(F.max_by("ref_id", "ord").alias("ref_id"))
    low = F.regexp_replace(F.lower(F.trim("author")), r"\s+et\s+al\.?$", " et al.")
    c = citations.withColumn("k1", F.concat(low, "year")).withColumn("k2", F.concat(F.lower(surname_of("author")), "year"))
    a, b = (table.select("paper_id", F.col("key").alias(k), F.col("ref_id").alias(f"r{k}")) for k in ("k1", "k2"))
    return c.join(a, ["paper_id", "k1"], "left").join(b, ["paper_id", "k2"], "left").withColumn("ref_id", F.coalesce("rk1", "rk2")).drop("k1", "k2", "rk1", "rk2")


def mentions(chunks: DataFrame, pattern: str | list[str], ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """Distinct numbers mentioned by a chunk, with the order of the first mention: number, first_seen."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ([pattern] if isinstance(pattern, str) else pattern)])
    rows = chunks.select(ident, F.posexplode(F.array_distinct(found)).alias("first_seen", "number"))
    return rows


def link_items(chunks: DataFrame, items: DataFrame, pattern: str | list[str], ident: str = "chunk_id") -> DataFrame:
    """Chunks joined to the paper's figures, tables or formulas they mention by number; nearer pages rank first.

    chunks: id, paper_id, text; items: paper_id, number, page, path. Returns id, number, path, page, n (1 is the chunk's own)."""
    m = mentions(chunks, pattern, ident).join(chunks.select(ident, "paper_id", tx.page_number("text").alias("chunk_page")), ident)
    hit = m.join(items, ["paper_id", "number"])
    near = F.when((F.col("chunk_page") > 0) & (F.abs(F.col("page") - F.col("chunk_page")) <= 2), 0).otherwise(1)
    w = Window.partitionBy(ident).orderBy(near, "first_seen", "page", "path")
    return hit.withColumn("n", F.row_number().over(w)).select(ident, "number", "path", "page", "n")


def caption_number(caption: Column | str, pattern: str = FIGURE) -> Column:
    return F.nullif(F.regexp_extract(caption, pattern, 1), F.lit(""))


def nth_caption(page_text: Column | str, index: Column, kind: str = "figure") -> Column:
    """The caption of the page's i-th (from 0) figure or table; a single caption serves all."""
    word = "(?:Figure|Fig\\.?|图)" if kind == "figure" else "(?:Table|表)"
    found = F.regexp_extract_all(page_text, F.lit(rf"(?im)^\s*({word}\s*\d+[.:：]?[^\n]*)"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.get(found, index))


def formulas(pages: DataFrame, text: str = "text", parity: bool = False) -> DataFrame:
    """Display ($$..$$), inline ($..$) and LaTeX formulas of pages (paper_id, page, text). parity: inline also takes [..]."""
    rest = F.regexp_replace(F.col(text), r"(?s)\$\$.+?\$\$", " ") if not parity else F.col(text)
    kinds = [("display", r"(?s)\$\$(.+?)\$\$", F.col(text)), ("inline", r"(?<!\$)\$([^$\n]+)\$(?!\$)" + (r"|\[([^\]\n]+)\]" if parity else ""), rest), ("latex", r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}", F.col(text))]
    out = None
    for kind, p, source in kinds:
        rows = pages.select("paper_id", "page", F.lit(kind).alias("type"), F.posexplode(F.regexp_extract_all(source, F.lit(p), F.lit(1))).alias("formula_index", "text")).withColumn("text", tx.strip("text")).where("text <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def nearest_caption(items: DataFrame, captions: DataFrame) -> DataFrame:
    """For each item (paper_id, item_id, page) the caption on the nearest page, the earlier on a tie."""
    j = items.join(captions.select("paper_id", F.col("page").alias("cpage"), "caption"), "paper_id")
    return j.groupBy("paper_id", "item_id").agg(F.min_by("caption", F.struct(F.abs(F.col("page") - F.col("cpage")), "cpage", "caption")).alias("caption"))


def reference_sections(docs: DataFrame, ident: str = "paper_id", text: str = "text") -> DataFrame:
    """All reference sections of texts: section_no, first and last line, content. A section ends at the next title, at
    acknowledgements or an appendix, or with the text; lines of only a margin number are dropped."""
    lines = docs.select(ident, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    low = F.lower(tx.strip("line"))
    stop = low.rlike(r"^(?:\d+[.)]\s+)?(?:acknowledge?ments?|appendix|appendices|supplementary materials?|author contributions)\b") & ~is_reference_title(F.col("line"))
    marked = lines.withColumn("kind", F.when(is_reference_title(F.col("line")), 1).when(stop, 2).otherwise(0))
    w = Window.partitionBy(ident).orderBy("line_no")
    last = F.last(F.when(F.col("kind") > 0, F.struct("line_no", "kind")), True).over(w)
    inside = marked.withColumn("open", last).where("open.kind = 1 and kind = 0").where(~F.col("line").rlike(r"^\s*\d{1,4}\s*$"))
    out = inside.groupBy(ident, F.col("open.line_no").alias("title_line")).agg(F.max("line_no").alias("last_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return out.withColumn("section_no", F.row_number().over(Window.partitionBy(ident).orderBy("title_line")))


def batch_references(section: str, most: int = 32768) -> list[str]:
    """Pieces of at most `most` characters, cut before a numbered line once a piece is full (or 90 % full)."""
    out, now, size = [], [], 0
    for line in section.split("\n"):
        begins = bool(re.match(r"\s*(?:\[\d+\]|\d+\.)\s", line))
        if now and (size + len(line) + 1 > most or begins and size >= 0.9 * most):
            out.append("\n".join(now))
            now, size = [], 0
        while len(line) > most:
            out.append(line[:most])
            line = line[most:]
        now.append(line)
        size += len(line) + 1
    return out + ["\n".join(now)] if now else out


def renumber(references: DataFrame, lexical: bool = False) -> DataFrame:
    """ref_id ref_1, ref_2, .. over all sections of a paper in order. lexical: section names order as text (10 before 2)."""
    order = F.col("section_no").cast("string") if lexical else F.col("section_no")
    return references.withColumn("ref_id", F.concat(F.lit("ref_"), F.row_number().over(Window.partitionBy("paper_id").orderBy(order, "pos"))))


def split_batches(sections: DataFrame, ident: str = "paper_id", most: int = 32768) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r[0], int(r[1]), i, piece) for r in pdf.itertuples(index=False) for i, piece in enumerate(batch_references(r[2], most))]
            yield pd.DataFrame(rows, columns=["key", "section_no", "batch", "content"])

    kind = sections.schema[ident].dataType.simpleString()
    return sections.select(ident, "section_no", "content").mapInPandas(run, f"key {kind}, section_no int, batch int, content string").withColumnRenamed("key", ident)
