from pyspark.sql import functions as F

from quillmark.operators import cover, sections


def pages(spark, *texts, doc="D"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(texts, 1)], "doc_id string, page_num int, text string")


def chunks(spark, *texts, **kw):
    return sections.with_labels(sections.chunk_documents(pages(spark, *texts), **kw)).orderBy("chunk_id").collect()


def test_numbered_sections(spark):
    out = chunks(spark, "preface\n1 Introduction\nBody one.\n2 Scope\nBody two.", "2.1 Sub Part\nmore text here.")
    assert [(c["section_no"], c["heading_trail"], c["text"], c["cite_label"]) for c in out] == [
        ("1", ["Introduction"], "Body one.", "D §1 (p. 1)"), ("2", ["Scope"], "Body two.", "D §2 (pp. 1-2)"), ("2.1", ["Scope", "Sub Part"], "more text here.", "D §2.1 (p. 2)")]


def test_numbered_child_of_an_empty_parent_opens_its_own(spark):
    out = chunks(spark, "4 KEYS AND LOCKS\n4.1 Spare Key Register\nTwo keys hang here.")
    assert [c["heading_trail"] for c in out] == [["KEYS AND LOCKS", "Spare Key Register"]]


def test_unnumbered_headings_fold_into_an_empty_one(spark):
    out = chunks(spark, "10.1 ANNEX B\nWHEN A KEY IS LOST\nFIRST STEPS\nsome body text follows here.")
    assert out[0]["heading_trail"] == ["ANNEX B: WHEN A KEY IS LOST: FIRST STEPS"]


def test_same_page_child_precedes_its_parents_text(spark):
    out = chunks(spark, "1 Parent\nown text of parent.\n1.1 Child\nchild text here.")
    assert [c["section_no"] for c in out] == ["1.1", "1"]


def test_plain_headings_only_without_dotted_numbers(spark):
    text = "1. Summary\nbody text a.\n2. What it costs\nbody text b.\n3. Opening\nbody text c.\n4. Where to park\nbody text d."
    assert [c["heading_trail"] for c in chunks(spark, text)] == [["Summary"], ["What it costs"], ["Opening"], ["Where to park"]]
    assert len(chunks(spark, text + "\n5.1 Extra\nbody text e.")) == 3  # two of the headings are body now


def test_contents_pages_and_boilerplate_go(spark):
    out = chunks(spark, "Contents\n1 Nothing", "Trust Policy 1\n1 Scope\nkept line.\n12", "Trust Policy 2\nlast line.\nhttps://x.example/p 1/9")
    assert [c["text"] for c in out] == ["kept line.\nlast line."]


def test_blank_lines_and_order_stay(spark):
    out = {r["page_num"]: r["text"] for r in sections.strip_boilerplate(pages(spark, "a\n\n b\nc", "x")).collect()}
    assert out == {1: "a\n\n b\nc", 2: "x"}


def test_merging_short_sections(spark):
    text = "1 One\nshort text.\n2 Two\nthis one is long enough for itself.\n3 Three\ntail."
    out = chunks(spark, text, min_tokens=4)
    assert [(c["chunk_id"], c["text"]) for c in out] == [("D-0001", "short text.\nthis one is long enough for itself.\ntail.")]


def test_documents_do_not_mix(spark):
    both = pages(spark, "1 One\nbody of one.").unionByName(pages(spark, "1 Two\nbody of two.", doc="E"))
    assert {(c["doc_id"], c["text"]) for c in sections.chunk_documents(both).collect()} == {("D", "body of one."), ("E", "body of two.")}


def test_no_pages(spark):
    assert sections.chunk_documents(pages(spark, "x").limit(0)).count() == 0


TABLE = [
    ["Policy Title:", None, "Spare Keys"], ["Document Reference:", "KEY-24", "KEY-24", "KEY"], ["Version Number:", "3", " "],
    ["Supersedes:", "XY - Key Policy\nand more", "Expired", "March 2018"], ["Author", "Someone Else Here"],
]


def sheet(spark, table, page_text=None):
    df = spark.createDataFrame([("f", table, page_text)], "doc_id string, table array<array<string>>, page_text string")
    return cover.cover_sheets(df).first().asDict(recursive=True)


def test_cover_sheet(spark):
    got = sheet(spark, TABLE)
    assert (got["doc_ref"], got["title"], got["version"], got["author"]) == ("KEY-24", "Spare Keys", "3", "Someone Else Here")
    assert got["supersedes"] == [{"name": "XY - Key Policy and more", "status": "Expired", "date": "March 2018"}]
    assert got["fields_not_found"] == ["approval_date", "review_date", "expiry_date", "issued_by"]


def test_cells_that_repeat_the_last_kept_one_go(spark):
    # the second cell repeats the first; the third starts like the second, but not like the first
    got = sheet(spark, [["Issued by:", "a long name", "A", "a short name", "A SHORT NAME and more"]])
    assert got["issued_by"] == "a long name a short name"
    assert sheet(spark, [["loose cell", "Version Number::", "2", "Author", "Withdrawn", "x"]])["author"] == "Withdrawn x"


def test_cover_reference_outside_the_table(spark):
    assert sheet(spark, [], "x Document Reference Number: AB-1\ny")["doc_ref"] == "AB-1"
    blank = sheet(spark, None, "Document Reference Number:\nVersion Number")
    assert blank["doc_ref"] is None and "doc_ref" in blank["fields_not_found"]
    assert sheet(spark, [["Document Reference", "x:", "Document Reference:", "T-1"]], "Document Reference Number: AB-1")["doc_ref"] == "T-1"


def test_superseded_entries(spark):
    def entries(*cells):
        df = spark.createDataFrame([(list(cells),)], "c array<string>")
        return df.select(cover.superseded_entries(F.col("c")).alias("e")).first().asDict(recursive=True)["e"]

    assert [e["name"] for e in entries("AB - One Policy\nCD - Two Policy")] == ["AB - One Policy", "CD - Two Policy"]
    assert [e["name"] for e in entries("AB - One\nCD - ALL CAPS")] == ["AB - One CD - ALL CAPS"]
    assert entries("Expired") == [] and entries() == []
    assert entries("2001\nlower first", "Retired\n1st May 2002\nArchived", "EF – Next\n2003") == [
        {"name": "lower first", "status": "Archived", "date": "1st May 2002"}, {"name": "EF – Next", "status": None, "date": "2003"}]


def test_looks_controlled(spark):
    df = spark.createDataFrame([("f", [["Document Reference:", "K-1"], ["Approval Date", "x"], ["Approval Date:", "May 2020"]], None), ("g", [], None)],
                               "doc_id string, table array<array<string>>, page_text string")
    assert [r["doc_id"] for r in cover.looks_controlled(cover.cover_sheets(df)).collect()] == ["f"]


def test_filters_of_sheets_repeat_no_work(spark):
    df = spark.createDataFrame([("f", TABLE + [["Approval Date:", "May 2020"]], None), ("g", None, "Document Reference Number: AB-1")],
                               "doc_id string, table array<array<string>>, page_text string").repartition(2)
    controlled = cover.looks_controlled(cover.cover_sheets(df)).select("doc_id", "doc_ref")
    assert [tuple(r) for r in controlled.collect()] == [("f", "KEY-24")]
    # the cells are walked once, however many columns the filter and the result name
    assert controlled._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
