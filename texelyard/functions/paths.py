"""Path and name expressions, free of regular expressions on the hot path."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from texelyard.functions.lookups import as_col


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so non-ASCII letters can never fold into a rule."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Text before the last ``/``; empty when there is none."""
    return F.left(path, F.greatest(F.char_length(path) - F.char_length(file_name(path)) - 1, F.lit(0)))


def _ext_length(name: Column) -> Column:
    """Characters of the extension with its dot, 0 when the name has none.

    A leading dot starts no extension, and ``..`` has none.
    """
    tail = F.char_length(F.substring_index(name, ".", -1))
    has_ext = (tail < F.char_length(name) - 1) & (name != "..")
    return F.when(has_ext, tail + 1).otherwise(0)


def raw_stem(path: Column) -> Column:
    """File name without its extension, in its own case."""
    name = file_name(path)
    return F.left(name, F.char_length(name) - _ext_length(name))


def raw_ext(path: Column) -> Column:
    name = file_name(path)
    return F.right(name, _ext_length(name))


def stem(path: Column) -> Column:
    return ascii_lower(raw_stem(path))


def ext(path: Column) -> Column:
    return ascii_lower(raw_ext(path))


def replace_ext(path: Column, new_ext: Column) -> Column:
    return F.concat(F.left(path, F.char_length(path) - _ext_length(file_name(path))), new_ext)


def entry_ext(name: Column) -> Column:
    """Archive rule: everything from the last dot of the whole entry name."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), ascii_lower(F.substring_index(name, ".", -1)))).otherwise("")


def base_name(path: Column) -> Column:
    r"""Text after the last of ``\``, ``/`` and ``:``."""
    return F.substring_index(F.translate(path, "\\:", "//"), "/", -1)


def replace_meta(path: Column, segment) -> Column:
    """First ``meta`` in the text replaced by ``segment``; empty when there is none."""
    at = F.instr(path, "meta")
    swapped = F.concat(F.left(path, at - 1), as_col(segment), F.substring(path, at + 4, F.char_length(path)))
    return F.when(at > 0, swapped).otherwise("")


def relative_parent(path: Column, root: str) -> Column:
    """Folder of ``path`` below ``root``; empty for files directly in it."""
    return F.ltrim(F.substring(parent(path), F.lit(len(root.rstrip("/")) + 1), F.char_length(path)), F.lit("/"))


def join_path(folder, sub: Column, name: Column) -> Column:
    folder = as_col(folder)
    return F.when(sub == "", F.concat_ws("/", folder, name)).otherwise(F.concat_ws("/", folder, sub, name))
