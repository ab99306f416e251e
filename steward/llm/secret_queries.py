"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from steward.llm import secret_grammar as sg
from steward.llm.common import query, table


@query()
def op6_secret_grammar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text")
    counted = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return sg.scan(docs).select(
        F.col("row").alias("doc_id"), counted(0).alias("n_assign"), counted(1).alias("n_access"), counted(2).alias("n_hex"),
        F.sha2(sg.digest_text(F.col("spans"), 3), 256).alias("base_sha256"), sg.digest_text(F.col("spans"), 4).alias("spans"))
