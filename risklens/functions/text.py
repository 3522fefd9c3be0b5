"""Column functions over paths, repository names and reply text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII characters Python's str.strip() removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_path(c: Column) -> Column:
    """Backslash to slash."""
    return F.translate(c, "\\", "/")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(c), r"(.)\.[^.]+$", "$1")


def parent_dir(c: Column) -> Column:
    """Directory of a relative path, '' at the root."""
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def _replace_first(c: Column, literal: str) -> Column:
    quoted = "".join("\\" + ch if ch in ".[]()*+?{}|^$\\" else ch for ch in literal)
    return F.regexp_replace(c, f"^(.*?){quoted}", "$1")


def repo_slug(c: Column, mode: str = "search") -> Column:
    """URL or shorthand to ``owner/repo``.

    ``search`` takes the tail of a hosting URL or a bare ``owner/repo`` and
    leaves anything else alone.  ``rstrip`` first drops trailing characters of
    the set ``.git`` and takes two segments.  ``ui`` takes the first two
    segments after the host or gives null.  ``change`` keeps everything after
    the host without ``.git``.
    """
    if mode == "search":
        url = none_if_empty(F.regexp_extract(c, r"github\.com[:/]([^/]+/[^/\s]+?)(?:\.git)?$", 1))
        short = none_if_empty(F.regexp_extract(c, r"^([^/]+/[^/\s]+)$", 1))
        return F.coalesce(F.btrim(url, F.lit("/")), F.btrim(short, F.lit("/")), c)
    if mode == "rstrip":
        cut = F.regexp_replace(c, r"[.git]+$", "")
        parts = F.split(F.substring_index(cut, "github.com/", -1), "/")
        two = F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))
        return F.when(F.contains(cut, F.lit("github.com")) & (F.size(parts) >= 2), two).otherwise(cut)
    if mode == "ui":
        clean = c
        for prefix in ("https://", "http://", "github.com/"):
            clean = _replace_first(clean, prefix)
        owner = F.regexp_extract(clean, r"^([^/]+)/([^/]+)", 1)
        repo = _replace_first(F.regexp_extract(clean, r"^([^/]+)/([^/]+)", 2), ".git")
        return F.when(owner != "", F.concat(owner, F.lit("/"), repo))
    if mode == "change":
        return F.replace(F.substring_index(c, "github.com/", -1), F.lit(".git"), F.lit(""))
    raise ValueError(f"unknown mode: {mode}")


def session_key(c: Column) -> Column:
    """``owner/repo`` to ``owner_repo``."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def doc_id(project: Column, path: Column) -> Column:
    """Deterministic document key."""
    return F.sha2(F.concat_ws(":", project, path), 256)


def truncated(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip_fences(c: Column, variant: str = "regex") -> Column:
    """Drop a markdown code fence around a reply.

    ``regex`` removes an opening and a closing fence; ``split`` cuts at the
    fence only when the text starts or ends with it, and keeps just the part up
    to a second opening fence of the same kind.
    """
    text = strip(c)
    if variant == "regex":
        for pattern in (r"^```json\s*", r"^```\s*", r"\s*```$"):
            text = F.regexp_replace(text, pattern, "")
        return strip(text)
    if variant.startswith("split"):
        tag = "```python" if variant == "split_python" else "```json"
        text = F.when(F.startswith(text, F.lit(tag)), F.get(F.split(text, tag), F.lit(1))).otherwise(text)
        text = F.when(F.startswith(text, F.lit("```")), F.substr(text, F.lit(4))).otherwise(text)
        text = F.when(F.endswith(text, F.lit("```")), F.left(text, F.length(text) - 3)).otherwise(text)
        return strip(text)
    raise ValueError(f"unknown variant: {variant}")


def valid_payload(c: Column, n: int = 10) -> Column:
    """Generated text counts only from ``n`` characters on, fences removed."""
    return F.coalesce(F.length(strip_fences(c, "split_python")) >= n, F.lit(False))


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
