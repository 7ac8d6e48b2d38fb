import pytest
from pyspark.sql import functions as F

from spoglio.operators import casefile as C

DOC = "case_doc_id long, casefile_id string, relative_path string, filename string, extension string, document_type string, size_bytes long, sha256 string, scan_ord long"


def docs(spark, paths, case="c"):
    rows = [(i, case, p, p.split("/")[-1], "." + p.rsplit(".", 1)[-1].lower() if "." in p else "", "marker_tecnico" if p.endswith("COMPLETE") else "x", 10, h, i) for i, (p, h) in enumerate(paths, 1)]
    return spark.createDataFrame(rows, DOC)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_duplicates_markers_and_null_hashes(spark):
    d = docs(spark, [("1/COMPLETE", "e"), ("2/COMPLETE", "e"), ("2/empty.pdf", "e"), ("a.pdf", "h"), ("b.pdf", "h"), ("c.pdf", None), ("d.pdf", None)])
    assert rows(C.duplicate_files(d).select("relative_path", "first_path"), "relative_path") == [("2/empty.pdf", "1/COMPLETE"), ("b.pdf", "a.pdf")]
    assert C.duplicate_files(d.limit(0)).count() == 0


def test_units(spark):
    d = docs(spark, [("999001/999001.pdf", "a"), ("999001/COMPLETE", "b"), ("999001/ListaAllegati.html", "c"), ("999001/x/y.PDF", "d"), ("7/only.txt", "e"), ("loose.pdf", "f")])
    got = C.build_units(d).collect()
    assert [(r.unit_id, r.total_files, r.total_pdf_files, r.main_pdf_path, r.complete_marker_path) for r in got] == [("999001", 4, 2, "999001/999001.pdf", "999001/COMPLETE")]


def test_cascade(spark):
    d = docs(spark, [("atti/001_sentenza.pdf", "a"), ("x/dup.pdf", "b"), ("y/dup.pdf", "c"), ("atti/001-séntenza_finale.pdf", "d")])
    refs = ["atti/001_sentenza.pdf", "001_SENTENZA.pdf", "dup.pdf", "missing.pdf", "001 sèntenza finale.pdf", None, "..\\atti\\001_sentenza.pdf"]
    e = spark.createDataFrame([(i, "c", r) for i, r in enumerate(refs)], "entry_id long, casefile_id string, referenced_path string")
    got = rows(C.match_entries(e, d).select("entry_id", "strategy", "confidence"), "entry_id")
    assert [g[1] for g in got] == ["relative_path_exact", "basename_exact", "ambiguous", "unmatched", "normalized_basename", "no_reference", "basename_exact"]
    assert got[4][2] == "medium"


def test_order_of_units(spark):
    u = spark.createDataFrame([(1, "c", "100", 2, "01/01/2024", None), (2, "c", "200", 1, "15/06/2024", None), (3, "c", "300", 1, "01/01/2024", None), (4, "c", "x", None, None, None), (5, "c", "5", None, "08/11/5202", 3)], "unit_key long, casefile_id string, unit_id string, faldone_number int, index_date string, pg_progressive int")
    got = {r.unit_key: r for r in C.unit_order(u).collect()}
    assert [got[k].suggested_order for k in (5, 4, 3, 2, 1)] == [1, 2, 3, 4, 5]
    assert got[5].anomalous_date and got[5].order_confidence == "low" and got[4].order_source == "unit_id"


@pytest.fixture()
def plan(spark):
    schema = "item_id long, casefile_id string, final_order int, unit_id string, source_pdf string, include_in_merged_pdf boolean, exclude_reason string, bookmark_title string, act_title string, total_pages int, warnings array<struct<code:string,message:string,path:string>>"
    return spark.createDataFrame([
        (1, "c", 2, "a", "a.pdf", True, None, "t", "12 - Verbale.", 2, []), (2, "c", 1, "b", "b.pdf", True, None, " ", None, 1, [("w", "m", "/abs/p.pdf")]),
        (3, "c", None, "x", "x.pdf", False, "duplicato", "t", "X", None, None), (4, "d", 1, "q", "../q.pdf", True, None, "t", "Q", None, []),
    ], schema)


def test_plan(spark, plan):
    assert rows(C.renumber_plan(plan), "item_id") == [(1, "c", 2, "Verbale", "002 - Verbale"), (2, "c", 1, "Unità b", "001 - Unità b"), (3, "c", None, "X", None), (4, "d", 1, "Q", "001 - Q")]
    assert rows(C.page_offsets(plan), "item_id") == [(1, "c", 1, 2), (2, "c", 0, 0)]
    assert rows(C.plan_totals(plan).select("casefile_id", "known_pages", "estimated_pages", "n_excluded"), "casefile_id") == [("c", 3, 3, 1), ("d", None, None, 0)]
    assert rows(C.unsafe_paths(plan), "item_id") == [(4, "d", "q.pdf")]
    assert rows(C.plan_warnings(plan).select("item_id", "code", "path"), "item_id") == [(2, "w", "p.pdf")]
    assert [r.position for r in C.move_item(plan, "c", 1, 3).orderBy("item_id").collect()] == [1, 3, 2, 1]
    changed = C.set_included(plan, ["a"], False, "irrilevante")
    assert changed.where("unit_id = 'a'").select("include_in_merged_pdf", "exclude_reason").first() == (False, "irrilevante")
    assert C.set_title(plan, "a", "Z").where("unit_id = 'a'").first().act_title == "Z"


def test_validation(spark, plan):
    from spoglio.operators import audit as A

    plan = plan.withColumn("bookmark_label", F.lit(None).cast("string")) if "bookmark_label" not in plan.columns else plan
    d = docs(spark, [("a.pdf", "h"), ("b.pdf", "i")]).withColumn("size_bytes", F.when(F.col("relative_path") == "b.pdf", 0).otherwise(5).cast("long"))
    twice = plan.withColumn("final_order", F.when(F.col("casefile_id") == "c", F.lit(1)).otherwise(F.col("final_order")))
    found = {(r.casefile_id, r.severity, r.message.split(": ")[0].split(" ", 2)[-1]) for r in A.validate_plan(twice, d).collect()}
    assert ("c", "error", "tra item inclusi") in found and any(r[:2] == ("d", "error") for r in found)
    excluded = A.validate_plan(plan.withColumn("include_in_merged_pdf", F.lit(False)), d)
    assert {r.message for r in excluded.where("severity = 'error'").collect()} == {"Il merge plan non contiene PDF inclusi: Nessun item incluso nel PDF unico."}
    assert A.validate_plan(plan.limit(0), d).count() == 0 and A.estimate_totals(A.estimate_items(plan.limit(0), d)).count() == 0


def test_running_sums_of_a_hot_group(spark):
    import random

    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else f"c{i % 7}" if i % 2 else None, rng.choice([None, *range(40)]), rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(data, "item_id long, casefile_id string, final_order int, v int")
    got = {r.item_id: r.n for r in C.running(df, ["casefile_id"], [F.asc_nulls_last("final_order"), F.asc("item_id")], F.col("v"), "n", F.coalesce(F.floor(F.col("final_order") / 4), F.lit(1000) + F.floor(F.col("item_id") / 16))).collect()}
    want, total = {}, {}
    for i, c, o, v in sorted(data, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        total[c] = total.get(c, 0) + v
        want[i] = total[c]
    assert got == want


def test_indexes_in_markdown(spark):
    from spoglio.operators import audit as A
    from spoglio.operators import markdown as M

    texts = spark.createDataFrame([(1, "<!-- Blocco 1: pagine originali 3-4 -->\n# Verbale a|b\n# Querela"), (2, "niente")], "k int, markdown string")
    acts = {r.k: r.markdown for r in A.act_index(texts, M.act_outline(texts, "k"), "k", F.concat(F.col("k").cast("string"), F.lit(".md"))).collect()}
    assert acts[1].startswith("# Indice atti sperimentale\n\n- Markdown sorgente: `1.md`\n") and acts[1].endswith("|---|---:|---:|\n| Verbale ab | 3 | 1 |\n| Querela | 3 | 1 |\n") and acts[2].endswith("|---|---:|---:|\n")
    marks = {r.k: r.markdown for r in A.bookmark_index(texts, M.bookmarks(texts.withColumn("n", F.lit(20)), "k", "n"), "k", F.lit("x.md")).collect()}
    assert "`markdown_headings`\n- Fallback tecnico: no" in marks[1] and marks[2].endswith("| Pagine 1-15 | 1 |\n| Pagine 16-20 | 16 |\n") and "tecnico: sì" in marks[2]


def test_profiles(spark):
    many = docs(spark, [(f"{i}.tiff", str(i)) for i in range(8)] + [("a.txt", "x"), ("b.jpg", "y")], "img").unionByName(docs(spark, [(f"{i}.pdf", str(i)) for i in range(5)], "pdf")).unionByName(docs(spark, [("a.pdf", "1"), ("b.tiff", "2")], "mix"))
    got = {r.casefile_id: r.profile for r in C.case_profile(many, C.build_units(many)).collect()}
    assert got == {"img": "immagini_scansioni", "pdf": "pdf_sciolti", "mix": "misto"}


def test_tiles(spark):
    df = spark.createDataFrame([(1, 31), (2, 0), (3, None)], "k int, pages int")
    assert rows(C.tile_pages(df, "k", "pages", 15), "k", "block_no") == [(1, 1, 1, 15), (1, 2, 16, 30), (1, 3, 31, 31)]
