"""Text of source files as columns: lines, patterns, positions, snippets, fingerprints, entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, as in text editors and most scripting languages.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def java(pattern: str, many_lines: bool = True) -> str:
    """The pattern for Spark: case ignored, Unicode classes, and only a newline ends a line."""
    return ("(?imUd)" if many_lines else "(?iUd)") + pattern


def split_lines(content: Column) -> Column:
    """The lines of a text; a line end at the very end doesn't begin another line."""
    parts = F.split(content, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(content: Column) -> Column:
    """Newlines and one: a file that ends in a newline counts one more than it has lines."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    # get() would work out its type, and so that of the whole body, again for each row
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches are summed up by blocks of so many, so that n matches take n times this plus the square of the number of blocks.
BLOCK = 128


def _after(a: Column, b: Column) -> Column:
    """What two texts one after the other have: newlines, and characters after the last one. Each is given as such a struct."""
    return F.struct((a["lines"] + b["lines"]).alias("lines"), F.when(b["lines"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"))


def _extent(text: Column) -> Column:
    return F.struct(newlines(text).alias("lines"), F.length(F.substring_index(text, "\n", -1)).alias("tail"))


def _total(extents: Column) -> Column:
    return F.aggregate(extents, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("tail")), _after)


def positions(found: Column, gaps: Column) -> Column:
    """array<struct<k, line_start, line_end, col_start, text>> of a pattern's matches and of the texts between them.

    The text before match k is made of the gaps up to k and the matches before it, so its newlines and the length of its
    last line follow from those of its parts, and no offset function is needed: the parts are summed up by blocks, and
    for each match only its own block is gone through. The pattern must not match the empty string.
    """

    def before(parts: Column, blocks: Column, k: Column) -> Column:
        at = F.floor(k / BLOCK).cast("int")
        return _after(F.get(blocks, at), _total(F.slice(parts, at * BLOCK + 1, k - at * BLOCK)))

    def placed(found: Column, gaps: Column, parts: Column, blocks: Column) -> Column:
        def one(text: Column, k: Column) -> Column:
            here = _after(before(parts, blocks, k), _extent(F.get(gaps, k)))
            return let(
                here,
                lambda h: F.struct(k.alias("k"), (h["lines"] + 1).alias("line_start"), (h["lines"] + 1 + newlines(text)).alias("line_end"), h["tail"].alias("col_start"), text.alias("text")),
            )

        return F.transform(found, one)

    def summed(found: Column, gaps: Column, parts: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / BLOCK).cast("int")), lambda b: _total(F.slice(parts, b * BLOCK + 1, BLOCK)))
        sums = lambda blocks: F.transform(blocks, lambda _, b: _total(F.slice(blocks, F.lit(1), b)))
        return let(let(each, sums), lambda blocks: placed(found, gaps, parts, blocks))

    def part(found: Column, gaps: Column) -> Column:
        return let(F.transform(found, lambda text, k: _after(_extent(F.get(gaps, k)), _extent(text))), lambda parts: summed(found, gaps, parts))

    return let(found, lambda f: let(gaps, lambda g: part(f, g)))


def matches(content: Column, pattern: str) -> Column:
    """``positions`` of all matches of a literal pattern."""
    return positions(F.regexp_extract_all(content, F.lit(java(pattern)), F.lit(0)), F.split(content, java(pattern), -1))


def snippet(lines: Column, first: Column, last: Column, around: int = 2) -> Column:
    """Numbered lines from ``around`` before ``first`` to ``around`` after ``last``, those inside marked."""
    begin = F.greatest(first - around, F.lit(1))
    stop = F.least(last + around, F.size(lines))

    def one(text: Column, k: Column) -> Column:
        n = begin + k
        mark = F.when((n >= first) & (n <= last), ">>> ").otherwise("    ")
        said = n.cast("int").cast("string")
        return F.concat(mark, F.when(n < 1000, F.lpad(said, 4, " ")).otherwise(said), F.lit(" | "), text)

    return F.when(stop >= begin, F.array_join(F.transform(F.slice(lines, begin, stop - begin + 1), one), "\n")).otherwise("")


def fingerprint(rule_id: Column, path: Column, line: Column) -> Column:
    return F.md5(F.concat_ws(":", rule_id, path, line.cast("string")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base``; unchanged where it isn't below it."""
    prefix = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
