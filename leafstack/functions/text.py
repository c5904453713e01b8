"""Text expressions. All are built-in column functions: no Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..defaults import TABLE_RULE

_BLANKS = " \t\n\r\f\x0b"
_MARK = "\x01"
_ESCAPE = "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A computed column that is used in a lambda would be computed again for
    each element; binding it as a lambda argument avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.replace(file_name(path), F.lit(".pdf"), F.lit(""))


def strip(text: Column) -> Column:
    """Drop blanks and line ends on both sides."""
    return F.btrim(text, F.lit(_BLANKS))


def clean_text(text: Column) -> Column:
    """Remove horizontal rules and surrounding blanks."""
    return strip(F.replace(text, F.lit(TABLE_RULE), F.lit("")))


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sections(text: Column, strip_marks: bool = False) -> Column:
    """Split markdown at its headings; headings in fenced code do not count.

    The text is cut at fence lines into pieces that are outside and inside a
    fence in turn. Outside, the line end before a heading becomes a mark; the
    pieces are glued again and split at the marks. So a page never leaves its
    row and needs no shuffle. Marks in the input are escaped.
    """
    fence = r"(?md)^(?=[^\S\n]*```)"
    heading = r"\n(?=#+[^\S\n])"

    def glue(pieces: Column) -> Column:
        shift = F.when(F.element_at(pieces, 1).rlike(r"\A[^\S\n]*```"), 1).otherwise(0)
        return F.array_join(
            F.transform(
                pieces,
                lambda p, i: F.when(
                    (i + shift) % 2 == 0, F.regexp_replace(p, heading, _MARK)
                ).otherwise(p),
            ),
            "",
        )

    escaped = F.replace(
        F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_MARK), F.lit(_ESCAPE + "m")
    )
    marked = let(F.split(escaped, fence), glue)
    parts = F.transform(
        F.split(marked, _MARK),
        lambda s: F.replace(
            F.replace(s, F.lit(_ESCAPE + "m"), F.lit(_MARK)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE)
        ),
    )
    if strip_marks:
        parts = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"\A#+[^\S\n]", "")))
    return F.filter(parts, lambda s: strip(s) != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` words, each starting ``overlap`` before the last one's end."""
    step = size - overlap

    def cut(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - overlap - 1, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " "),
        )

    return F.filter(let(words(text), cut), lambda c: c != "")


def is_table_line(line: Column) -> Column:
    return line.rlike(r"^\s*\|")


def prose(text: Column) -> Column:
    """The text without the lines of its markdown tables."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~is_table_line(s)), "\n")


def tables(text: Column) -> Column:
    """The markdown tables of a text: each run of table lines is one."""

    def runs(lines: Column) -> Column:
        flags = F.transform(lines, is_table_line)
        return let(flags, lambda flag: spans(lines, flag))

    def spans(lines: Column, flag: Column) -> Column:
        position = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(
            position, lambda i: F.get(flag, i) & ~F.coalesce(F.get(flag, i - 1), F.lit(False))
        )
        ends = F.filter(
            position, lambda i: F.get(flag, i) & ~F.coalesce(F.get(flag, i + 1), F.lit(False))
        )
        return F.zip_with(
            starts, ends, lambda s, e: F.array_join(F.slice(lines, s + 1, e - s + 1), "\n")
        )

    return let(F.split(text, "\n"), runs)


def has_heading(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^#+\s.*$", 0) != ""


# The break after a sentence, and the white space that Python's str.split() cuts at.
SENTENCE_BREAK = r"(?<=[.!?])[ \t\n\r\f\x0b]+"
WORD_SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SPAN = "array<struct<a:int,b:int>>"


def _places(values: Column, queries: Column, ties_first: bool) -> Column:
    """For each query (ascending), its place in the sorted union with ``values`` (ascending, distinct)."""
    value_kind, query_kind = (1, 0) if ties_first else (0, 1)
    merged = F.array_sort(F.concat(
        F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(value_kind).alias("kind"))),
        F.transform(queries, lambda q: F.struct(q.alias("v"), F.lit(query_kind).alias("kind"))),
    ))
    placed = F.transform(merged, lambda x, p: F.struct(x["kind"].alias("kind"), p.alias("p")))
    return F.transform(F.filter(placed, lambda x: x["kind"] == query_kind), lambda x: x["p"])


def sentence_chunks(text: Column, size: int, overlap: int) -> Column:
    """Sentences packed greedily into chunks of at most ``size`` words, as a fold in the JVM.

    A new chunk starts with the closing sentences of the one before, as many
    as fit into ``overlap`` words, unless the next sentence would then no
    longer fit. Sentences above ``size`` words are cut first. NULL has no
    chunks. Word counts are summed once; the end of a chunk from any start,
    and the start of the overlap before any end, come from one sort of the
    sums with their shifted copies, so no search runs per step.
    """
    empty_units = F.array().cast("array<array<string>>")

    def cut(sentence: Column) -> Column:
        return let(F.filter(F.split(sentence, WORD_SPACE, -1), lambda w: w != ""), lambda words: F.when(
            F.size(words) > 0,
            F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / size).cast("int") - 1),
                        lambda i: F.slice(words, i * size + 1, F.lit(size))),
        ).otherwise(empty_units))

    units = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK, -1), cut))

    def packed(units: Column) -> Column:
        n = F.size(units)
        total = F.aggregate(units, F.array(F.lit(0)), lambda acc, u: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(u))))
        return let(total, lambda total: let(
            F.transform(_places(total, F.transform(total, lambda t: t + size), False), lambda p, s: p - s - 1),
            lambda fwd: let(
                F.transform(_places(total, F.transform(total, lambda t: t - overlap), True), lambda p, e: p - e),
                lambda back: F.aggregate(
                    F.sequence(F.lit(1), n),
                    F.struct(F.lit(0).alias("s"), F.lit(0).alias("f"), F.array().cast(_SPAN).alias("out")),
                    lambda st, _: F.when(st["f"] >= n, st).otherwise(let(
                        F.when(F.get(total, st["f"] + 1) - F.get(total, st["s"]) > size, st["f"]).otherwise(st["s"]),
                        lambda s: let(F.get(fwd, s), lambda e: F.struct(
                            F.get(back, e).alias("s"), e.alias("f"),
                            F.concat(st["out"], F.array(F.struct(s.alias("a"), e.alias("b")))).alias("out"),
                        )),
                    )),
                )["out"],
            ),
        ))

    return let(units, lambda us: F.transform(
        F.when(F.size(us) == 0, F.array().cast(_SPAN)).otherwise(packed(us)),
        lambda c: F.concat_ws(" ", F.flatten(F.slice(us, c["a"] + 1, c["b"] - c["a"]))),
    ))
