"""Identifier normalisation.

A segment may be written with white space around it, in other letter case, with a directory or an audio
extension; ``seg_id`` is the bare lower-case form. Null and blank ids name nothing and become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space stripped from ids, audio extensions.
WHITESPACE = " \t\n\r\f\v  　"
EXTENSIONS = ("sph", "wav", "flac")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare(c: Column | str) -> Column:
    """The value without white space around it; null if nothing is left."""
    return F.nullif(F.btrim(_col(c), F.lit(WHITESPACE)), F.lit(""))


def is_named(c: Column | str) -> Column:
    """True unless the id is null or blank."""
    return bare(c).isNotNull()


def seg_id(c: Column | str) -> Column:
    """Bare lower-case segment id, null where nothing is named (also for a bare directory or extension)."""
    name = F.lower(F.substring_index(F.btrim(_col(c), F.lit(WHITESPACE)), "/", -1))
    return bare(F.regexp_replace(name, rf"\.({'|'.join(EXTENSIONS)})$", ""))


def sql_seg_id(c: str) -> str:
    """The same in DuckDB SQL, for oracles."""
    ws = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(8195) || chr(12288)"
    name = rf"regexp_replace(trim({c}, {ws}), '^.*/', '', 's')"
    return rf"nullif(trim(regexp_replace(lower({name}), '\.({'|'.join(EXTENSIONS)})$', ''), {ws}), '')"


def sql_is_named(c: str) -> str:
    return f"(trim({c}, ' ' || chr(9) || chr(10) || chr(13)) <> '')"
