"""Blocks, chunks with spans, files of all formats, OCR and speech shaping, evaluation texts."""
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sparquill.operators import blocks as B
from sparquill.operators import evaluation as E
from sparquill.plans.files import made_file
from sparquill.plans.lifecycle import locator_kind, suffix, upload_problem
from sparquill.sources import files as X

DOC = "# One\n\nIntro *text*\nmore\n\n- item a\nName: value\n## Two\n| a | b |\n| 1 | 2 |\n\n```py\n# x\n```\nend"


def test_blocks_have_ranges():
    b = B.parsed(DOC)
    text = B.plain(b)
    assert [x["kind"] for x in b] == ["heading", "text", "text", "text", "heading", "table", "code", "text"] and [x["role"] for x in b][2:4] == ["list_item", "field"]
    assert all(text[x["start"] : x["end"]] == x["text"] for x in b) and b[-1]["path"] == ["One", "Two"] and b[6]["language"] == "py"
    assert B.rendered(b).startswith("# One\n\nIntro text more") and "[Table]\n| a | b |" in B.rendered(b) and "```py\n# x\n```" in B.rendered(b)
    assert B.structured(DOC) and not B.structured("# a\n# b") and not B.structured("plain") and B.parsed("") == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "- item one", "k: v", "word " * 40, "x" * 700, "", "| a | b |", "```", "tail"]), max_size=30))
def test_chunks_say_where_they_come_from(lines):
    blocks = B.parsed("\n".join(lines))
    text = B.plain(blocks)
    chunks = B.chunked(blocks, target=300, most=400, least=30, table=200, overlap=40)
    for c in chunks:
        assert c["spans"] and all(c["text"][a:b] == text[s:e] for a, b, s, e in c["spans"])
    covered = {i for c in chunks for i in c["orders"]}
    assert covered == {b["order"] for b in blocks if b["kind"] != "heading"}


def test_short_tails_join_their_section():
    got = B.chunked(B.parsed("# A\n" + "\n\n".join(["p " * 200, "q " * 200, "tiny"])), target=420, most=900, least=120)
    assert len(got) == 2 and got[1]["text"].endswith("tiny")


def test_low_value_sentences():
    assert B.low_value("--") and B.low_value("a.") and B.low_value("Setup", title="Setup") and B.low_value("well then...") and not B.low_value("A full sentence.")


def test_citations_stay_in_groups():
    got = B.cited(B.parsed("# Setup\n\nSetup\n\n- Short item one. And more of it here, it is.\nMode: fast. Value 3.14 of a.b.\n\nOne short. Two is also short. Three. Four.\n\n" + "clause of some length, " * 30 + "end."))
    assert [c["text"] for c in got[:4]] == ["Short item one. And more of it here, it is.", "Mode: fast. Value 3.14 of a.b.", "One short. Two is also short. Three.", "Four."] and [c["role"] for c in got[:3]] == ["list_item", "field", None]
    assert all(len(c["text"]) <= 300 and c["text"].startswith("clause") and c["text"].endswith((",", "end.")) for c in got[4:]) and len(got) == 7 and {c["locator"] for c in got} == {"heading:Setup"}
    assert B.groups("a\nb\n\nc\nk: v\nd", None) == [(0, 3, None), (5, 6, None), (7, 11, "field"), (12, 13, None)] and B.groups(" k: v ", "field") == [(1, 5, "field")] and B.groups("", None) == []
    assert B.cited(B.parsed("")) == [] and B.cited(B.parsed("plain text only."))[0]["locator"] == "chars:0-16"
    assert B.low_value("综上。") and len(B.cited(B.parsed("x" * 5000 + "."))) == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# A", "- item one. two", "k: v", "word, " * 70 + "x.", "Some sentence is here. Is it? ", "", "| a | b |", "```", "3.14 a.b"]), max_size=30))
def test_citations_are_slices_of_their_source(lines):
    blocks = B.parsed("\n".join(lines))
    text = B.plain(blocks)
    for c in B.cited(blocks):
        assert " ".join(text[c["start"] : c["end"]].split()) == c["text"] and len(c["text"]) <= 300
        assert any(b["start"] <= c["start"] and c["end"] <= b["end"] and b["kind"] == c["kind"] for b in blocks)


def test_citations_of_a_table(spark):
    df = spark.createDataFrame([(1, "A whole sentence here. Again.", "x"), (2, None, "y"), (3, "", "z"), (1, "A whole sentence here. Again.", "x")], "doc_id long, text string, start string")
    assert sorted((r["doc_id"], r["part_no"], r["text"]) for r in B.citations_of(df).collect()) == [(1, 0, "A whole sentence here. Again.")] * 2
    assert B.citations_of(df.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    sections = [("Head one", ["first line", "second (2) line"]), ("Head two", ["third"])]
    for e in ("txt", "md", "docx"):
        (tmp_path / f"a.{e}").write_bytes(made_file(e, sections))
    (tmp_path / "a.pdf").write_bytes(made_file("pdf", [("Head one", ["first line"]), ("Head two", ["third"])]))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "bad.docx").write_bytes(b"PK")
    (tmp_path / "g.txt").write_bytes("中文文本".encode("gb18030"))
    (tmp_path / "x.exe").write_bytes(b"x")
    got = {r["path"].rpartition("/")[2]: r for r in X.read_files(spark, str(tmp_path)).collect()}
    assert [s["text"] for s in got["a.md"]["segments"]] == ["Head one", "first line", "second (2) line", "Head two", "third"] == [s["text"] for s in got["a.docx"]["segments"]]
    assert {s["section"] for s in got["a.docx"]["segments"]} == {"Head one", "Head two"} and [s["locator"] for s in got["a.pdf"]["segments"]] == ["page:1", "page:2"]
    assert got["a.pdf"]["segments"][0]["text"] == "Head one\nfirst line" and got["g.txt"]["segments"][0]["text"] == "中文文本" and got["g.txt"]["encoding"] == "gb18030"
    assert all(got[n]["error"] and not got[n]["segments"] for n in ("bad.pdf", "bad.docx", "x.exe"))


def test_empty_and_null_contents(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"")), ("b.md", None)], "path string, content binary")
    assert [r["error"] for r in X.extracted(df).collect()] == ["empty", "empty"] and X.extracted(df.limit(0)).count() == 0


def test_pdf_strings():
    assert X.pdf_string(rb"(a\(b\)\n\101\\)") == "a(b)\nA\\"
    assert X.pdf_stream_text(b"BT [(He) 20 (llo)] TJ ET BT <776f> Tj ET BT (x) ' ET") == "He llo\nwo\nx"
    body = b"%PDF 1 0 obj /Type /Page /Contents [2 0 R 3 0 R] endobj 2 0 obj stream\nBT (a) Tj ET\nendstream endobj 3 0 obj /FlateDecode stream\n" + zlib.compress(b"BT (b) Tj ET") + b"\nendstream endobj 4 0 obj /Type /Pages endobj"
    assert X.pdf_segments(body) == [{"text": "a\nb", "page": 1, "locator": "page:1"}]
    assert X.needs_ocr(["a b"]) and not X.needs_ocr(["four short words here"]) and X.heading_style(None, "Heading 2") and not X.heading_style("Body")


def test_speech(spark):
    rows = ['{"text": " a  b ", "result": [{"start": 1, "end": 2, "word": "a"}, {"start": 3, "end": 4.5, "word": "b"}]}', '{"text": " "}', "nope", '{"text": "x"}', None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "p string").select(X.speech_segment(F.col("p"))).collect()]
    assert tuple(got[0]) == ("a b", 1.0, 4.5) and got[1] is None and got[2] is None and tuple(got[3]) == ("x", None, None) and got[4] is None


@pytest.mark.parametrize("name,mime,size,problem", [("a.pdf", "application/pdf", 5, None), ("a.PDF", None, 5, None), ("a/b.md", "text/plain", 5, "VALIDATION_ERROR:name"), (None, "text/plain", 5, "VALIDATION_ERROR:name"), ("a.exe", None, 5, "UNSUPPORTED_FILE_TYPE:extension"), ("a.txt", "text/plain; charset=x", 0, "VALIDATION_ERROR:empty"), ("a.txt", "image/png", 5, "UNSUPPORTED_FILE_TYPE:mime"), ("a.md", "text/markdown", 9 << 20, "UPLOAD_TOO_LARGE")])
def test_uploads(spark, name, mime, size, problem):
    df = spark.createDataFrame([(name, mime, size)], "n string, m string, s long")
    assert df.select(upload_problem(F.col("n"), F.col("m"), F.col("s"))).first()[0] == problem


def test_suffix_and_locator_kind(spark):
    assert spark.createDataFrame([("a.b.MD",), (".hidden",), ("x",)], "n string").select(suffix(F.col("n"))).collect() == [(".md",), ("",), ("",)]
    df = spark.createDataFrame([("audio", None, None, None, 1.0, 2.0, None, None, "t"), ("pdf", 0, 3, 2, None, None, None, None, "t"), ("other", None, None, None, None, None, None, None, "t"), ("other", None, None, None, None, None, None, None, None)], "k string, a int, b int, p int, x double, y double, s string, h array<string>, t string")
    assert [r[0] for r in df.select(locator_kind(*(F.col(c) for c in df.columns))).collect()] == ["time_range", "pdf_page", "unknown", None]


def test_eval_text(spark):
    rows = [("The `max` is **3**，“ok”。", "the max is 3,ok"), ("a *b* c*d", "a b c*d"), (None, ""), ("ＡＢＣ！", "abc")]
    got = spark.createDataFrame(rows, "t string, w string").select(E.eval_text(F.col("t")), "w").collect()
    assert all(a == b for a, b in got)


def test_pdf_stream_that_ends_in_a_carriage_return():
    import zlib

    from sparquill.plans.files import made_file
    from sparquill.sources import files

    head = next(h for i in range(10_000) if zlib.compress(f"BT ({(h := 'z' * (i % 50) + str(i))}) Tj ET\nBT (unit) Tj ET".encode()).endswith(b"\r"))
    assert [p["text"] for p in files.pdf_segments(made_file("pdf", [(head, ["unit"]), ("b", ["c"])]))] == [f"{head}\nunit", "b\nc"]


def test_parts_leave_before_the_next_text_is_read(spark):
    from sparquill.operators import blocks as B

    texts = [(1, "# A\n\n" + "\n\n".join(f"Sentence number {i} of a long book that goes on and on for some time." for i in range(B.HELD + 5))), (2, None), (3, "One line of text that is long enough to cite.")]
    rows = B.blocks_of(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).select("doc_id", "part_no").collect()
    assert [(r["doc_id"], r["part_no"]) for r in rows] == [(1, i) for i in range(B.HELD + 6)] + [(3, 0)]
