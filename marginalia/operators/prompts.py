"""Prompts for the annotator, one per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import numbered, trim

# Comment token by file name suffix; anything else gets "//".
_TOKENS = {
    "#": (".py", ".rb", ".sh", ".php"),
    "<!--": (".html", ".vue", ".svelte"),
    "--": (".sql",),
}

INSTRUCTIONS = {
    "light": "Comment functions only, with one block comment above each.",
    "default": "Put a block comment above each function and a short comment where logic is hard to follow.",
    "full": "Put a detailed block comment above each function and explain every branch, loop and assignment inside it.",
}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def comment_token(name: Column) -> Column:
    """Comment token for a file name, by its last alphanumeric suffix."""
    ext = F.lower(F.regexp_extract(name, r"\.[0-9A-Za-z]+\z", 0))
    out = None
    for token, suffixes in _TOKENS.items():
        test = ext.isin(*suffixes)
        out = F.when(test, F.lit(token)) if out is None else out.when(test, F.lit(token))
    return out.otherwise(F.lit("//"))


def comment_examples(token: Column) -> tuple[Column, Column]:
    """(block example, inline example) in the form the token asks for."""
    block, inline = "Adds up the order lines", "Skip empty lines"
    closing = F.when(token == "<!--", F.lit(" -->")).otherwise(F.lit(""))
    block_form = F.when(token == "//", F.lit(f"/** {block} */")).otherwise(
        F.concat(token, F.lit(f" {block}"), closing)
    )
    return block_form, F.concat(token, F.lit(f" {inline}"), closing)


def build_prompts(
    files: DataFrame, mode: str = "default", keep_columns: list[str] | None = None
) -> DataFrame:
    """prompts(path, mode, comment_token, prompt), and ``keep_columns`` of the files."""
    if mode not in INSTRUCTIONS:
        raise ValueError(f"mode {mode!r} takes no prompt")
    name = file_name(F.col("path"))
    token = comment_token(name)
    block, inline = comment_examples(token)
    text = F.concat(
        F.lit("Suggest comments for the source file "),
        name,
        F.lit(f". Its lines are numbered.\n{INSTRUCTIONS[mode]}\n"),
        F.lit("Answer with one JSON array and nothing around it. Each element is an object with\n"),
        F.lit('"line", the number of the line to comment above, and "comment", the comment text.\n'),
        F.lit("Answer [] when nothing needs a comment. Never repeat code. Begin comments with "),
        token,
        F.lit(" and never use string literals as comments.\nExample: "),
        F.lit('[{"line": 3, "comment": "'),
        block,
        F.lit('"}, {"line": 9, "comment": "'),
        inline,
        F.lit('"}]\n\n'),
        numbered(F.col("content")),
    )
    return files.select(
        "path",
        *(keep_columns or []),
        F.lit(mode).alias("mode"),
        token.alias("comment_token"),
        let(text, trim).alias("prompt"),
    )
