"""Path expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """The plainest spelling relative to the root: ``/`` only, no empty, ``.`` or ``..`` parts.

    A ``..`` above the root stays at the root. Null stays null.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.when(path.rlike(r"\\|//|^/|/$|(?:^|/)\.\.?(?:/|$)"), F.array_join(folded, "/")).otherwise(path)
