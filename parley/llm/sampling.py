"""Bounded training samples, drawn by a hash of the id so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


#: The most labels that are learned.
LABELS = 1000


def draw(rows: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """About `most` rows at most, as many of each label as there are, shared out evenly, none held out, none with a
    null label. Of more than LABELS labels the most frequent count, so what comes to the driver is bounded."""
    rows = rows.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), label_col).limit(LABELS).collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, most // len(counts))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(1.0, each / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(97)), F.lit(1 << 30)) < share * (1 << 30))
