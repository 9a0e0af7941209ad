"""Tables, figures and reference lists inside documents, as array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table's method column, and how a figure is cut out of its page.
METHOD_WORDS = r"(?i)\b(method|model)s?\b"
CROP, PAD = 0.60, 20.0


def grid_score(grid: Column) -> Column:
    """How much an array of rows looks like a table: cells, filled cells, a method column, numbers; line breaks count against it."""
    cells = F.flatten(grid)
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    method = F.when(F.exists(F.flatten(F.slice(grid, 1, 1)), lambda c: F.coalesce(c.rlike(METHOD_WORDS), F.lit(False))), 80).otherwise(0)
    numeric = F.size(F.filter(cells, lambda c: F.coalesce(c.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*%?\s*$"), F.lit(False))))
    broken = F.size(F.filter(cells, lambda c: F.coalesce(F.contains(c, F.lit("\n")), F.lit(False))))
    return (F.size(grid) * width * 2 + filled + method + 3 * numeric - 5 * broken).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled_columns(grid: Column) -> Column:
    """The grid without columns that are empty in every row."""
    return bound(grid, _filled_columns)


def _filled_columns(grid: Column) -> Column:
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
    used = F.filter(places, lambda i: F.exists(grid, lambda r: F.trim(F.coalesce(F.get(r, i - 1), F.lit(""))) != ""))
    return F.transform(grid, lambda r: F.transform(used, lambda i: F.coalesce(F.get(r, i - 1), F.lit(""))))


def one_header(grid: Column) -> Column:
    """Two header rows as one: where the first two rows have a digit in one cell at most, cells that differ are joined by ``/``."""
    return bound(grid, _one_header)


def _one_header(grid: Column) -> Column:
    digits = lambda r: F.size(F.filter(r, lambda c: F.coalesce(c, F.lit("")).rlike("[0-9]")))
    first, second = F.get(grid, F.lit(0)), F.get(grid, F.lit(1))
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    both = F.zip_with(first, second, lambda a, b: F.when((plain(a) != "") & (plain(b) != "") & (plain(a) != plain(b)), F.concat(plain(a), F.lit("/"), plain(b))).when(plain(a) != "", plain(a)).otherwise(plain(b)))
    stacked = (F.size(grid) >= 2) & (digits(first) <= 1) & (digits(second) <= 1)
    return F.when(stacked, F.concat(F.array(both), F.slice(grid, 3, 1 << 30))).otherwise(grid)


def table_block(grid: Column, table_id: Column, page: Column) -> Column:
    """The marked block that stands for a table in a paper's text; null for an empty grid."""
    block = F.concat(F.lit("[TABLE_HTML: "), table_id, F.lit(" | Page "), page.cast("string"), F.lit("]\n"), grid_html(one_header(filled_columns(grid))), F.lit("\n[/TABLE_HTML]"))
    return F.when(F.size(grid) > 0, block)


def block_metadata(block: Column, expected: Column) -> Column:
    """struct(is_table, table_id, table_page) of a block's first line; the expected id where the block names none or another."""
    head = F.substring_index(block, "\n", 1)
    found = F.nullif(F.regexp_extract(head, r"(?i)Table_([0-9]+)", 1), F.lit(""))
    named = F.when(found.isNotNull(), F.concat(F.lit("Table_"), found))
    return F.struct(F.contains(head, F.lit("[TABLE_HTML:")).alias("is_table"), F.when(named == expected, named).otherwise(expected).alias("table_id"), F.regexp_extract(head, r"Page ([0-9]+)", 1).alias("table_page"))


def plausible_table(grid: Column, least_rows: int = 2, least_columns: int = 2) -> Column:
    """Whether a grid can be a table: rows and columns enough, half of its cells filled."""
    cells = F.flatten(grid)
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    return (F.size(grid) >= least_rows) & (width >= least_columns) & (2 * filled >= F.size(cells))


def split_lines(row: Column) -> Column:
    """A row whose cells hold several lines as that many rows; cells with fewer lines end in empty ones."""
    parts = F.transform(row, lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1))
    most = F.greatest(F.array_max(F.transform(parts, lambda p: F.size(p))), F.lit(1))
    return F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.transform(parts, lambda p: F.trim(F.coalesce(F.get(p, i), F.lit("")))))


def caption_of(page: Column, number: Column) -> Column:
    """The line of a page that captions table ``number`` (Arabic, or Roman up to X), of 8 characters at least; else empty."""
    roman = F.coalesce(F.get(F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"])), number.cast("int") - 1), F.lit("-"))
    pattern = F.concat(F.lit(r"(?:(?:Table|TABLE)\s+|表\s*)(?:"), number.cast("string"), F.lit("|"), roman, F.lit(r")[.:\s][^\n]{0,100}"))
    found = F.trim(F.regexp_substr(page, pattern))
    return F.when(F.char_length(found) >= 8, found).otherwise("")


def text_of_characters(characters: DataFrame, gap: float = 3.0) -> DataFrame:
    """``page, text`` of placed characters (``page, top, x0, text``) in reading order; a new line where the top moves by more than ``gap``."""
    order = Window.partitionBy("page").orderBy(F.round("top"), "x0")
    line = F.coalesce((F.abs(F.round("top") - F.lag(F.round("top")).over(order)) > gap).cast("int"), F.lit(0))
    rows = characters.withColumn("nth", F.row_number().over(order)).withColumn("line", F.sum(line).over(order))
    lines = rows.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda c: c["text"]), "").alias("text"))
    return lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def grid_html(grid: Column, caption: Column | None = None) -> Column:
    """An HTML table; the first row is the head; line breaks inside a cell become spaces."""

    def row(r: Column, tag: str) -> Column:
        cells = F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(f"</{tag}>")))
        return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))

    named = F.lit("") if caption is None else F.coalesce(F.concat(F.lit("<caption>"), caption, F.lit("</caption>")), F.lit(""))

    def made(clean: Column) -> Column:
        head = F.coalesce(F.try_element_at(clean, F.lit(1)), F.array().cast("array<string>"))
        body = F.array_join(F.transform(F.slice(clean, 2, 1 << 30), lambda r: row(r, "td")), "")
        return F.concat(F.lit("<table>"), named, row(head, "th"), body, F.lit("</table>"))

    return bound(filled_columns(grid), made)


def grid_markdown(grid: Column) -> Column:
    return bound(filled_columns(grid), _markdown)


def _markdown(clean: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.transform(F.slice(clean, 1, 1), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.lit("---")), " | "), F.lit(" |")))
    return F.array_join(F.concat(F.transform(F.slice(clean, 1, 1), line), rule, F.transform(F.slice(clean, 2, 1 << 30), line)), "\n")


def table_text(html: Column, rows: int = 3, keys: int = 5) -> Column:
    """A table for the embedder: caption, columns, the first rows, the first column's values."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    tr = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    grid = F.transform(tr, cells)
    caption = plain(F.regexp_extract(html, r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    head = F.array_join(F.coalesce(F.try_element_at(grid, F.lit(1)), F.array().cast("array<string>")), ", ")
    body = F.slice(grid, 2, 1 << 30)
    sample = F.array_join(F.transform(F.slice(body, 1, rows), lambda r: F.array_join(r, ", ")), "; ")
    first = F.array_join(F.slice(F.filter(F.transform(body, lambda r: F.coalesce(F.get(r, 0), F.lit(""))), lambda c: c != ""), 1, keys), ", ")
    parts = [F.when(caption != "", caption), F.when(head != "", F.concat(F.lit("Columns: "), head)), F.when(sample != "", F.concat(F.lit("Rows: "), sample)), F.when(first != "", F.concat(F.lit("Keys: "), first))]
    return F.concat_ws(" | ", *parts)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, structs of x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def best_boxes(boxes: DataFrame, group: list[str], most: float = 0.72) -> DataFrame:
    """Of boxes that overlap by more than ``most`` the best by score; a fold over each page's boxes, best first.

    ``boxes``: ``group``, id, score, box.
    """
    listed = boxes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("score", (-F.col("id")).alias("nid"), "box")), asc=False).alias("all"))
    none = F.expr("cast(array() as array<struct<score:double,nid:bigint,box:struct<x0:double,y0:double,x1:double,y1:double>>>)")
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: overlap(k["box"], b["box"]) > most), acc).otherwise(F.concat(acc, F.array(b))))
    return listed.select(*group, F.explode(kept).alias("b")).select(*group, (-F.col("b.nid")).alias("id"), F.col("b.score").alias("score"))


def crop(kind: Column, box: Column, height: Column, width: Column) -> Column:
    """The page region of a captioned table (below its caption) or figure (above it)."""
    table = kind == "table"
    top = F.when(table, F.greatest(F.lit(0.0), box["y1"])).otherwise(F.greatest(F.lit(0.0), box["y0"] - height * CROP))
    bottom = F.when(table, F.least(height, box["y0"] + height * CROP)).otherwise(F.least(height, box["y1"] + PAD))
    return F.struct(F.greatest(F.lit(0.0), box["x0"] - PAD).alias("x0"), top.alias("y0"), F.least(width, box["x1"] + PAD).alias("x1"), bottom.alias("y1"))


def abstract_of(text: Column, limit: int = 2000) -> Column:
    """What stands between the abstract's heading and the introduction."""
    found = F.regexp_extract(text, r"(?is)\babstract\b[\s:.\-]*(.*?)\s*(?:\n\s*(?:[0-9IVX]+\.?\s*)?introduction\b)", 1)
    return F.substring(F.trim(found), 1, limit)


def reference_items(text: Column, least: int = 20) -> Column:
    """Entries of the reference list, split at [n]."""
    tail = F.regexp_extract(text, r"(?is)\n\s*(?:references|bibliography)\s*\n(.*)$", 1)
    items = F.transform(F.split(tail, r"\[[0-9]+\]", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(items, lambda x: F.char_length(x) > least)
