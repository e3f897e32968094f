"""Which files are looked at: extensions, ignore patterns, empty files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import EXTENSIONS, langs
from ..functions.text import is_blank, trim

# Names that are skipped by default, and path parts the commit rule skips.
DEFAULT_IGNORED = [
    "node_modules", ".git", "dist", "build", "out",
    ".next", ".nuxt", ".svelte-kit",
    "venv", "env", ".venv",
    ".vscode", ".idea", "coverage",
    "tests", "__tests__", "fixtures",
]
COMMIT_IGNORED = ["node_modules/", "tests/", "__tests__/", "fixtures/"]


def extension_of(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot does not begin one."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"\A.+(\.[^.]*)\z", 1))


def with_ext(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", extension_of(F.col("path")))


def accepted_files(files: DataFrame) -> DataFrame:
    """Keeps files in an accepted language (semi join with the 22-row dimension)."""
    dim = F.broadcast(langs(files.sparkSession).select("ext"))
    return with_ext(files).join(dim, "ext", "left_semi")


def ignore_patterns(spark: SparkSession, user_lines: DataFrame | None = None) -> DataFrame:
    """ignore(pattern): the defaults and the user's lines, without blanks and # lines."""
    defaults = spark.createDataFrame([(p,) for p in DEFAULT_IGNORED], "pattern string")
    if user_lines is None:
        return defaults
    line = trim(F.col("value"))
    user = user_lines.select(line.alias("pattern")).where(
        (F.col("pattern") != "") & ~F.col("pattern").startswith("#")
    )
    return defaults.unionByName(user)


#: So many patterns are compared with each path in its row; more meet the paths in joins.
MAX_IN_ROW = 10_000


def drop_ignored(files: DataFrame, ignore: DataFrame, root: str = "", max_in_row: int = MAX_IN_ROW) -> DataFrame:
    """Drops files with a path component, at or below ``root``, that a pattern names.

    A pattern matches a component it equals (one trailing slash, then one trailing
    backslash left out) or, when it starts with ``*``, one that ends with its rest. A NULL path is kept.

    Up to ``max_in_row`` patterns are looked up, as sets, in the row of the file, so that nothing is
    shuffled. More meet the distinct components of the paths in equality joins, which move paths and, in the end,
    the rows of ``files``: give those without their contents (see ``files.scan_source_tree``).
    """
    known = [r["pattern"] for r in ignore.where("pattern IS NOT NULL").limit(max_in_row + 1).collect()]  # bounded
    if len(known) > max_in_row:
        return _drop_by_joins(files, ignore, root)
    names = sorted({re.sub(r"\\\Z", "", re.sub(r"/\Z", "", p)) for p in known} - {""})
    tails = sorted({p[1:] for p in known if p.startswith("*")})
    parts = F.split(_below(F.col("path"), root), "/")
    hit = F.exists(parts, lambda part: part.isin(names)) if names else F.lit(False)
    if tails:
        hit = hit | F.exists(parts, lambda part: F.exists(_endings(part), lambda tail: tail.isin(tails)))
    return files.where(~F.coalesce(hit, F.lit(False)))


def _endings(part: Column) -> Column:
    """All endings of a path component, itself and the empty one among them."""
    return F.transform(F.sequence(F.lit(1), F.length(part) + 1), lambda i: F.substr(part, i, F.length(part)))


def _drop_by_joins(files: DataFrame, ignore: DataFrame, root: str) -> DataFrame:
    """The same for any number of patterns: joins on the distinct components, which are few beside the paths; every
    ending of a component is a candidate for a pattern with ``*``."""
    parts = files.select("path", F.explode(F.split(_below(F.col("path"), root), "/")).alias("part"))
    known = parts.select("part").distinct()
    bare = F.regexp_replace(F.regexp_replace("pattern", r"/\z", ""), r"\\\z", "")
    names = ignore.select(bare.alias("part")).where(F.col("part") != "")
    rest = F.substr("pattern", F.lit(2), F.length("pattern"))
    suffixes = ignore.where(F.col("pattern").startswith("*")).select(rest.alias("tail"))
    by_suffix = known.select("part", F.explode(_endings(F.col("part"))).alias("tail")).join(suffixes, "tail", "left_semi")
    ignored = known.join(names, "part", "left_semi").union(by_suffix.select("part")).distinct()
    hit = parts.join(ignored, "part", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def _below(path: Column, root: str) -> Column:
    """Path from the last component of ``root`` on."""
    parent = root.rstrip("/").rpartition("/")[0]
    if not parent:
        return path
    prefix = parent + "/"
    below = F.substr(path, F.lit(len(prefix) + 1), F.length(path))
    return F.when(path.startswith(prefix), below).otherwise(path)


def drop_ignored_commit(files: DataFrame) -> DataFrame:
    """The commit rule: drops paths that contain one of the ignored directory names."""
    hit = F.lit(False)
    for part in COMMIT_IGNORED:
        hit = hit | F.contains(F.col("path"), F.lit(part))
    return files.where(~hit)


def drop_empty(files: DataFrame) -> DataFrame:
    """Drops files that hold nothing but blanks."""
    return files.where(~is_blank(F.col("content")))
