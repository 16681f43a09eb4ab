"""Tables to text: header and cell filling, separator rows, Markdown, prompts. All in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def filled_header(header: Column) -> Column:
    """Blank, ``nan`` and ``none`` headers become Unnamed: i, i counted from 0 over all cells."""
    return F.transform(header, lambda c, i: F.when(F.lower(_trimmed(c)).isin("", "nan", "none"), F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(_trimmed(c)))


def filled_row(row: Column) -> Column:
    """Null, blank and ``none`` cells become nan."""
    return F.transform(row, lambda c: F.when(F.lower(_trimmed(c)).isin("", "none"), F.lit("nan")).otherwise(_trimmed(c)))


def all_unnamed(header: Column) -> Column:
    return (F.size(header) > 0) & F.forall(header, lambda c: c.startswith("Unnamed: "))


def separator_row(header: Column, separator: str = " | ") -> Column:
    """At least three dashes a column, two more than the header's length with the usual separator."""
    pad = 2 if separator == " | " else 0
    return F.concat(F.lit("|"), F.array_join(F.transform(header, lambda c: F.repeat(F.lit("-"), F.greatest(F.lit(3), F.char_length(c) + pad))), "|"), F.lit("|"))


def _line(cells: Column, separator: str) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, separator), F.lit(" |"))


def header_lines(header: Column) -> Column:
    """A header given as a list of texts, as header rows: if any of them holds a comma, each is a row, cut at commas; else they are the cells of one row."""
    cut = F.transform(header, lambda line: F.transform(F.split(line, ","), _trimmed))
    return F.when(F.exists(header, lambda c: F.coalesce(F.contains(c, F.lit(",")), F.lit(False))), cut).otherwise(F.array(header))


def table_text(headers: Column, rows: Column, file_name: Column | None = None, sheet_name: Column | None = None, separator: str = " | ", max_length: int = -1) -> Column:
    """A table as Markdown text. headers: array of header rows; several are joined, with all lines, by spaces."""
    filled = F.transform(headers, filled_header)
    several = F.size(filled) > 1
    head = F.transform(filled, lambda h: _line(h, separator))
    lines = F.concat(
        F.when(several, F.array(F.array_join(head, " "))).otherwise(head),
        F.when(F.size(filled) > 0, F.array(separator_row(F.element_at(filled, F.greatest(F.size(filled), F.lit(1))), separator))).otherwise(F.array().cast("array<string>")),
        F.transform(rows, lambda r: _line(filled_row(r), separator)),
    )
    body = F.when(F.size(lines) > 0, F.concat(F.lit("Table:\n"), F.when(several, F.array_join(lines, " ")).otherwise(F.array_join(lines, "\n"))))
    named = [F.when(_trimmed(c) != "", F.concat(F.lit(label), c)) for c, label in ((file_name, "File name: "), (sheet_name, "Sheet name: ")) if c is not None]
    text = F.concat_ws("\n", *named, body)
    return F.when(F.char_length(text) > max_length, F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))).otherwise(text) if max_length > 0 else text


def prompt_tables(representations: Column, max_chars: int | None = None) -> Column:
    """Numbered blocks of representations."""
    blocks = F.transform(representations, lambda r, i: F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), r))
    text = F.array_join(blocks, "\n\n")
    return F.substring(text, 1, max_chars) if max_chars else text


def raw_table_block(number: Column, header: Column, rows: Column) -> Column:
    """A numbered block of a raw table: its columns and its first five rows."""
    return F.concat(F.lit("Table "), number.cast("string"), F.lit(" (columns: "), F.array_join(header, ", "), F.lit("):\n"), F.array_join(F.transform(F.slice(rows, 1, 5), lambda r: F.array_join(r, " | ")), "\n"))


def user_prompt(question: Column, tables: Column) -> Column:
    """A zero-shot prompt; without tables the question alone."""
    some = F.format_string("Answer the following question about the given table(s).\n\nQuestion: %s\n\nTables:\n%s\n\nAnswer:", question, tables)
    return F.when(F.trim(tables) != "", some).otherwise(F.format_string("Answer the following question.\n\nQuestion: %s\n\nAnswer:", question))
