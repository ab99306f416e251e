"""Path predicates and finding paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A leading slash, a drive letter followed by a separator, or two leading separators.
ABSOLUTE = r"\A(?:/|[A-Za-z]:[\\/]|[\\/]{2})"


def absolute_sql(path: str) -> str:
    return f"rlike({path}, r'{ABSOLUTE}')"


def parent_segment_sql(path: str) -> str:
    return f"array_contains(split(translate({path}, r'\\', '/'), '/'), '..')"


def resolved_sql(path: str) -> str:
    """Segments of an absolute path as an array: empty and `.` ones dropped, `..` resolved."""
    return (f"aggregate(split({path}, '/'), cast(array() as array<string>), (a, s) -> CASE WHEN s IN ('', '.') THEN a "
            "WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 0)) ELSE array_append(a, s) END)")


def segments_sql(path: str) -> str:
    """The resolved path without slashes at its ends, so that equal locations compare equal."""
    return f"array_join({resolved_sql(path)}, '/')"


def lies_under_sql(path: str, root: str) -> str:
    """Segment-wise prefix test on absolute paths: neither `/a/bc` nor `/a/b/../c` is under `/a/b`."""
    inner, outer = segments_sql(path), segments_sql(root)
    return f"({outer} = '' OR startswith({inner} || '/', {outer} || '/'))"


def is_absolute(path: str) -> Column:
    return F.expr(absolute_sql(path))


def escapes_base(path: str) -> Column:
    """True when a path that must be relative is absolute or climbs out of its base."""
    return F.expr(f"{absolute_sql(path)} OR {parent_segment_sql(path)}")


def is_traversal_entry(name: str) -> Column:
    """Archive entry names: any drive prefix counts, with or without a separator."""
    return F.expr(rf"rlike({name}, r'\A(?:/|[A-Za-z]:)') OR {parent_segment_sql(name)}")


def normalize_segments(path: str) -> Column:
    return F.expr(segments_sql(path))


def sheet_path(sheet: Column) -> Column:
    return F.concat(F.lit("$.sheets."), sheet.cast("string"))


def row_path(sheet: Column, row: Column) -> Column:
    return F.concat(sheet_path(sheet), F.lit(".rows."), row.cast("string"))


def cell_path(sheet: Column, row: Column, column: Column) -> Column:
    return F.concat(row_path(sheet, row), F.lit(".columns."), column.cast("string"))


def sheet_ordinal_from_path(path: Column) -> Column:
    digits = F.regexp_extract(path, r"\$\.sheets\.(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def loc_to_path(loc: Column) -> Column:
    """An error location (array of keys and indices as strings) as `$.a.0.b`; empty is `$`."""
    return F.array_join(F.concat(F.array(F.lit("$")), loc), ".")
