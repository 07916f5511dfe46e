"""The project registry: a small, configured list of (name, root)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(projects: list[tuple[str, str]], name: str) -> tuple[str, str] | None:
    """By exact name, else the first whose name holds it, case ignored."""
    low = name.lower()
    return next((p for p in projects if p[0] == name), None) or next((p for p in projects if low in p[0].lower()), None)


def is_under(path, root):
    """``path`` is ``root`` or below it (columns or strings of whole segments)."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def find_by_path(rows: DataFrame, projects: list[tuple[str, str]], column: str = "path") -> DataFrame:
    """Rows with the deepest registered root above them, ``name`` and ``root``; others go.  The list is a literal, no join."""
    options = F.array(*[F.struct(F.lit(len(r)).alias("depth"), F.lit(n).alias("name"), F.lit(r.rstrip("/")).alias("root")) for n, r in projects])
    hits = F.filter(options, lambda p: (F.col(column) == p["root"]) | F.startswith(F.col(column), F.concat(p["root"], F.lit("/"))))
    best = rows.withColumn("_p", F.array_max(hits)).where("_p is not null")
    return best.select(*rows.columns, "_p.name", "_p.root")


def members(projects: DataFrame, anchor: str, name: str = "") -> DataFrame:
    """``projects`` (``name, path``) at or below the path ``anchor``: the anchor first, then by name.

    ``name``: one member alone (none if it isn't there), ``__root__`` the anchor alone.
    """
    path = F.regexp_replace("path", "/+$", "")
    root = F.lit(anchor.rstrip("/"))
    found = projects.where(is_under(path, root)).withColumn("is_anchor", path == root)
    if name:
        found = found.where(F.col("is_anchor") if name == "__root__" else F.col("name") == name)
    return found.orderBy(F.col("is_anchor").desc(), "name")
