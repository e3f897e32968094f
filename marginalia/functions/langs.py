"""The language dimension: one row per accepted file extension.

The table is fixed by the 22 languages the engine accepts, so it can always be
broadcast: its size does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions, the lexical family of each, and the comment
# token offered to the annotator. They must stay as they are for results to match.
LANGUAGES = [
    # ext,      family,   prompt token
    (".js", "js", "//"),
    (".jsx", "js", "//"),
    (".ts", "js", "//"),
    (".tsx", "js", "//"),
    (".html", "html", "<!--"),
    (".css", "css", "//"),
    (".scss", "css", "//"),
    (".vue", "html", "<!--"),
    (".svelte", "html", "<!--"),
    (".py", "python", "#"),
    (".java", "cstyle", "//"),
    (".c", "c", "//"),
    (".cpp", "c", "//"),
    (".cs", "cstyle", "//"),
    (".go", "cstyle", "//"),
    (".rb", "hash", "#"),
    (".php", "php", "#"),
    (".rs", "rust", "//"),
    (".swift", "swift", "//"),
    (".kt", "cstyle", "//"),
    (".dart", "cstyle", "//"),
    (".sh", "hash", "#"),
]

EXTENSIONS = [ext for ext, _, _ in LANGUAGES]
RESET_FAMILIES = ("js", "cstyle", "c", "swift")  # quotes end with the line
NESTED_FAMILIES = ("rust", "swift")  # block comments nest
DEFAULT_FAMILY = "css"  # a file without a known extension is read like this

LANGS_SCHEMA = (
    "ext string, family string, reset_at_eol boolean, nested_block boolean, prompt_token string"
)


def langs(spark: SparkSession) -> DataFrame:
    """The language dimension as a DataFrame (22 rows, one per extension)."""
    rows = [
        (ext, family, family in RESET_FAMILIES, family in NESTED_FAMILIES, token)
        for ext, family, token in LANGUAGES
    ]
    return spark.createDataFrame(rows, LANGS_SCHEMA)


def family_of(ext: Column) -> Column:
    """Lexical family of an extension, as a foldable CASE (no join)."""
    ext = F.lower(F.coalesce(ext, F.lit("")))
    families = {}
    for name, family, _ in LANGUAGES:
        families.setdefault(family, []).append(name)
    out = None
    for family, names in families.items():
        test = ext.isin(*names)
        out = F.when(test, F.lit(family)) if out is None else out.when(test, F.lit(family))
    return out.otherwise(F.lit(DEFAULT_FAMILY))
