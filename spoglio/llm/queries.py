"""Queries of the training-data operators and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoglio.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.lang_id import identify_languages, mislabelled

    return mislabelled(identify_languages(table(spark, sf_dir, "documents"))).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.pii import find_personal_information

    judges = table(spark, sf_dir, "judgment_analyses").select("analysis_id", "judge.value", "judge.source")
    every = [("markdown", find_personal_information(table(spark, sf_dir, "sanitize_results"), "job_id", "markdown"))]
    every += [(f"judge.{c}", find_personal_information(judges, "analysis_id", c, loose_names=True, lexicon=frozenset())) for c in ("value", "source")]
    first, *rest = [found.select(F.lit(field).alias("field"), "rec_id", "kind", "value") for field, found in every]
    for other in rest:
        first = first.unionByName(other)
    return first


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders in place of what was found."""
    from spoglio.llm.pii import name_words, redact_column

    texts = table(spark, sf_dir, "sanitize_results").select("job_id", "markdown").distinct()
    words = name_words(texts, "markdown")
    texts = redact_column(texts, "markdown", words=words).select(F.lit("markdown").alias("field"), F.col("job_id").alias("rec_id"), F.col("markdown").alias("text"))
    for c in ("value", "source"):
        judge = table(spark, sf_dir, "judgment_analyses").select(F.lit(f"judge.{c}").alias("field"), F.col("analysis_id").alias("rec_id"), F.col(f"judge.{c}").alias("text")).distinct()
        texts = texts.unionByName(redact_column(judge, "text", loose_names=True))
    return texts


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.canonical import canonicalize

    listed = table(spark, sf_dir, "canonical_values")
    courts = table(spark, sf_dir, "judgment_analyses").select("analysis_id", F.col("authority.value").alias("value"))
    courts = canonicalize(courts, "analysis_id", "value", listed.where("list_name = 'authority'")).withColumn("field", F.lit("authority"))
    acts = canonicalize(table(spark, sf_dir, "casefile_units"), "unit_key", "act_title", listed.where("list_name = 'act_title'")).withColumn("field", F.lit("act_title"))
    return courts.unionByName(acts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "canonical_values").select(F.col("list_name").alias("field"), F.col("canonical").alias("value"))
    return _canonical(spark, sf_dir).join(F.broadcast(entries), ["field", "value"], "left_anti").select("field", "rec_id", "canon_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values no entry was found for, with how often they occur."""
    missing = _canonical(spark, sf_dir).where("canon_id = 0")
    return missing.groupBy("field", "value").agg(F.count("*").alias("n_records"), F.max("n_candidates").alias("n_candidates"))


def _near(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """Different word triples and one half, as the problem's cases are defined; the bands find that with few misses."""
    from spoglio.llm.near_dup import near_duplicates

    how = {"k": 3, "threshold": 0.5, "bands": 80, "rows": 2, "min_hits": 2, "counted": False}
    notes = near_duplicates(table(spark, sf_dir, "merge_plan_items"), "item_id", "exclude_reason", min_words=12, **how)
    texts = near_duplicates(table(spark, sf_dir, "sanitize_results"), "job_id", "markdown", **how)
    return [("exclude_reason", *notes), ("markdown", *texts)]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.near_dup import record_pairs

    a, b = (record_pairs(links, members).select(F.lit(field).alias("field"), "id_a", "id_b") for field, links, members in _near(spark, sf_dir))
    return a.unionByName(b)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.near_dup import components

    a, b = (components(links, members).select(F.lit(field).alias("field"), "*") for field, links, members in _near(spark, sf_dir))
    return a.unionByName(b)


def _noise(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from spoglio.llm.ocr_repair import find_noise

    a, b = (table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "job_id", "markdown") for t in ("sanitize_results", "structure_results"))
    texts = a.unionByName(b)
    return texts, find_noise(texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir)[1].select("table_name", "job_id", "kind", "line_no", "word").distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as continuous paragraphs."""
    from spoglio.llm.ocr_repair import repair

    return repair(*_noise(spark, sf_dir))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.linkage import link_entries

    acts = table(spark, sf_dir, "canonical_values").where("list_name = 'act_title'")
    return link_entries(table(spark, sf_dir, "index_entries"), table(spark, sf_dir, "casefile_documents"), acts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_links(spark, sf_dir).select("entry_id", "case_doc_id")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoglio.llm.packing import fill_report

    return fill_report(p6_pack(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from spoglio.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_links": p5_links, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}


_TRIPLES = """WITH t AS (SELECT 'markdown' AS field, job_id AS id, max(markdown) AS text FROM sanitize_results GROUP BY ALL UNION ALL SELECT 'exclude_reason', item_id, max(exclude_reason) FROM merge_plan_items GROUP BY ALL),
  w AS (SELECT field, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM t WHERE text IS NOT NULL), g AS (SELECT DISTINCT field, id, unnest([hash(ws[i], ws[i + 1], ws[i + 2]) FOR i IN range(1, len(ws) - 1)]) AS g FROM w WHERE len(ws) >= CASE field WHEN 'exclude_reason' THEN 12 ELSE 3 END),
  n AS (SELECT field, id, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT a.field, a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.field = b.field AND a.g = b.g AND a.id < b.id GROUP BY ALL),
  pairs AS (SELECT p.field, id_a, id_b FROM p JOIN n x ON x.field = p.field AND x.id = id_a JOIN n y ON y.field = p.field AND y.id = id_b WHERE 2 * k >= x.n + y.n - k)"""


def oracle_sql() -> dict[str, str]:
    """All pairs of texts by their word triples, without signatures. The other queries fit models, read token vocabularies or follow rules that SQL can't say."""
    return {"p3_found": _TRIPLES + " SELECT * FROM pairs"}
