"""Text functions as Column expressions. White space is Unicode white space unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]"
#: White space of DuckDB's patterns.
ASCII_WS = r"[\t\n\f\r ]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str, space: str = _WS) -> Column:
    # a run within the text is tried from its start only, not from each of its characters
    return F.regexp_replace(_c(x), rf"^{space}++|(?<!{space}){space}++\z", "")


def blank(x: Column | str) -> Column:
    """Whether strip() leaves nothing, by the first character that isn't white space."""
    return ~_c(x).rlike(f"(?!{_WS})(?s:.)")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(_c(x), f"{_WS}+", " "))


def normalize_answer(x: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(_c(x)), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def normalize_title(x: Column | str) -> Column:
    return collapse(F.lower(_c(x)))


def sanitize(x: Column | str) -> Column:
    """Without NUL and control characters, white space collapsed."""
    return collapse(F.regexp_replace(_c(x), r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]", ""))


def truncate(x: Column | str, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def ellipsis(x: Column | str, n: int, empty: str = "") -> Column:
    """The first n characters and "..." where there are more; empty for null or empty text."""
    x = F.coalesce(_c(x), F.lit(""))
    return F.when(x == "", empty).when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def parts(x: Column | str, pattern: str, space: str = _WS) -> Column:
    """Non-blank pieces between matches of the pattern, stripped."""
    return F.filter(F.transform(F.split(_c(x), pattern), lambda p: strip(p, space)), lambda p: p != "")


def paragraphs(x: Column | str) -> Column:
    return parts(x, "\n\n")


def sentences(x: Column | str) -> Column:
    """After any of 。！？.!? and the white space that follows."""
    return parts(x, r"(?<=[。！？.!?])\s*")


def clauses(x: Column | str, whole: bool = True, space: str = _WS) -> Column:
    """After any of ，,；; ; the whole text if there is none, as in blank text (whole=False: none then, and null for null)."""
    found = parts(x, f"(?<=[，,；;]){space}*", space)
    return F.when(F.size(found) > 0, found).otherwise(F.array(_c(x))) if whole else found


def plain_sentences(x: Column | str) -> Column:
    """After .!? where white space follows (the evaluator's rule)."""
    return parts(x, r"(?<=[.!?])\s+")


def bm25_tokens(x: Column | str, segment=None) -> Column:
    """Lower case; words joined by - or _ become one; runs of letters and digits. segment: another tokenizer of the
    prepared text (a Column -> array Column), for scripts without spaces."""
    joined = F.regexp_replace(F.lower(_c(x)), "([a-z])[-_]([a-z])", "$1$2")
    return segment(joined) if segment else F.regexp_extract_all(joined, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def keywords(x: Column | str) -> Column:
    """Distinct lower-case words of four and more ASCII letters."""
    return F.array_distinct(F.filter(_words(F.lower(_c(x))), lambda w: w.rlike("^[a-z]{4,}$")))


def numbers(x: Column | str) -> Column:
    return F.filter(_words(_c(x)), lambda w: w.rlike("^[0-9]+$"))


def page_number(x: Column | str) -> Column:
    """Of a "[Page n]" mark, else of 第n页, else 0."""
    mark = F.nullif(F.regexp_extract(_c(x), r"\[Page\s+(\d+)\]", 1), F.lit(""))
    zh = F.nullif(F.regexp_extract(_c(x), r"第\s*(\d+)\s*页", 1), F.lit(""))
    return F.coalesce(mark, zh, F.lit("0")).cast("int")


def github_url(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"(https?://github\.com/[\w.-]+/[\w.-]+)", 1), F.lit(""))


def arxiv_id(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"(\d{4}\.\d{4,5})(?:v\d+)?", 1), F.lit(""))


def best_url(urls: Column | str) -> Column:
    """The first arxiv.org/pdf URL, else the first of all."""
    return F.coalesce(F.get(F.filter(_c(urls), lambda u: u.contains("arxiv.org/pdf")), F.lit(0)), F.get(_c(urls), F.lit(0)))


def arxiv_filename(ident: Column | str, title: Column | str) -> Column:
    safe = F.substring(F.regexp_replace(_c(title), r"[^\w\s-]", ""), 1, 50)
    return F.concat(F.coalesce(F.nullif(_c(ident), F.lit("")), safe), F.lit(".pdf"))


def human_size(n: Column | str) -> Column:
    n = _c(n).cast("double")
    short = lambda x: F.bround(x, 1)
    return F.when(n < 1024, F.format_string("%.1fB", short(n))).when(n < 1024**2, F.format_string("%.1fKB", short(n / 1024))).when(n < 1024**3, F.format_string("%.1fMB", short(n / 1024**2))).otherwise(F.format_string("%.1fGB", short(n / 1024**3)))


def strip_model_output(x: Column | str) -> Column:
    """Without a thinking block and code fences."""
    bare = F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(bare, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def cache_key(query: Column | str, mode: Column | str, top_k: Column | str) -> Column:
    return F.concat_ws("|", _c(query), _c(mode), _c(top_k).cast("string"))


def contains_cjk(x: Column | str) -> Column:
    return _c(x).rlike(r"[\x{4E00}-\x{9FFF}]")


def context(x: Column | str, begin: Column, length: Column, around: int = 50) -> Column:
    """The text around a span that starts at begin (from 0)."""
    low = F.greatest(begin - around, F.lit(0))
    return F.substring(_c(x), low + 1, begin - low + length + around)


def context_window(x: Column | str, n: int = 200) -> tuple[Column, Column]:
    """First and last n characters of a page, marked where the page goes on."""
    x = _c(x)
    long = F.length(x) > n
    return F.when(long, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x), F.when(long, F.concat(F.lit("..."), F.substring(x, -n, n))).otherwise(x)


def enhanced(text: Column | str, formulas: Column | str) -> Column:
    """The text with a block of its display formulas; formulas: array<struct<text, type>>."""
    shown = F.filter(_c(formulas), lambda f: F.length(strip(f["text"])) > 0)
    block = F.concat(F.lit("\n\n=== Formulas ===\n"), F.array_join(F.transform(shown, lambda f: F.concat(F.lit("$$"), f["text"], F.lit("$$"))), "\n"))
    return F.when(F.size(shown) > 0, F.concat(_c(text), block)).otherwise(_c(text))


def version_parts(name: Column | str) -> tuple[Column, Column]:
    """arXiv id and version (1 if not given) of a file name, null for other names."""
    base = F.nullif(F.regexp_extract(_c(name), r"^(\d{4}\.\d+)(?:v(\d+))?\.pdf$", 1), F.lit(""))
    version = F.coalesce(F.nullif(F.regexp_extract(_c(name), r"^(\d{4}\.\d+)(?:v(\d+))?\.pdf$", 2), F.lit("")).cast("int"), F.lit(1))
    return base, F.when(base.isNotNull(), version)


def year_suffix(x: Column | str) -> tuple[Column, Column]:
    """The year and the letter after it of "2023a"."""
    return F.nullif(F.regexp_extract(_c(x), r"(\d{4})([a-z]?)", 1), F.lit("")).cast("int"), F.regexp_extract(_c(x), r"(\d{4})([a-z]?)", 2)


def table_markdown(rows: Column | str) -> Column:
    """rows: array<array<string>>, the first the header. Pipes and line ends in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    lines = F.transform(_c(rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(_c(rows), F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", F.get(lines, F.lit(0)), rule, F.slice(lines, 2, 1 << 30))


def table_html(rows: Column | str) -> Column:
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.transform(_c(rows), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))


def table_csv(rows: Column | str) -> Column:
    """Cells with a comma, a quote or a line end are quoted."""
    cell = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.array_join(F.transform(_c(rows), lambda r: F.array_join(F.transform(r, cell), ",")), "\n")


def stamp(at: Column | None = None, compact: bool = False) -> Column:
    """A time as text, now by default; compact for file names."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss" if compact else "yyyy-MM-dd HH:mm:ss")
