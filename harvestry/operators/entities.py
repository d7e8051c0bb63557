"""Detail documents merged into entity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions import documents as docs
from harvestry.functions.text import clean_number
from harvestry.operators.scans import join_on
from harvestry.rules import OVERWRITTEN


def merge_detail(entities: DataFrame, details: DataFrame, key: str = "journal_id", doc: str = "detail_data") -> DataFrame:
    """Fresh documents merged over the stored ones and spread into the typed columns.

    ``details`` holds key and ``fresh_doc``, one row per entity.  The code and the main
    score keep their old value when the document has none; the other columns do not.
    """
    rows = join_on(entities, details.select(key, F.col("fresh_doc").alias("_fresh")), [key])
    had = F.col("_fresh").isNotNull()
    rows = rows.withColumn("_doc", F.when(had, docs.merge_docs(F.col(doc), F.col("_fresh"))))
    rows = rows.withColumn("_map", docs.doc_map("_doc"))

    def number(name: str) -> F.Column:
        return clean_number(F.col("_map")[name]).cast("decimal(10,4)")

    has_code = F.coalesce(F.map_contains_key("_map", "issn"), F.lit(False))
    values = {
        "issn": F.when(has_code, F.col("_map")["issn"]).otherwise(F.col("issn")),
        "impact_factor": F.coalesce(number("impact_factor"), F.col("impact_factor")),
        "impact_factor_realtime": number("impact_factor_realtime"),
        **{c: F.col("_map")[f] for c, f in OVERWRITTEN.items()},
        doc: F.col("_doc"),
        "detail_crawled": F.lit(True),
    }
    return rows.select(*[
        F.when(had, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in entities.columns
    ])
