"""Legacy text, MathML, recognition and reports on small inputs."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import legacy
from lectern.operators import checks, chunks
from lectern.sources import ocr


@pytest.mark.parametrize("raw,want", [("†_‡K †gvU", "থেকে মোট"), ("me©ev‡g", "সর্ববামে"), ("e¨vj", "ব্যাল"), ("‡Ý", "ন্সে"), ("K¡", "ক্ষ"), ("KrK", "ক্ক"), ("", ""), ("মোট", "মোট")])
def test_legacy_text(raw, want):
    got = legacy.LegacyDecoder().decode(raw)
    assert got["text"] == want and got["unmapped"] == []
    assert legacy.LegacyDecoder().decode(got["text"])["text"] == want


def test_unmapped_are_reported(spark):
    df = spark.createDataFrame([("K½½",), ("K",), (None,)], "raw string").withColumn("decoded", legacy.decode_legacy("raw"))
    assert [(r.glyph, r.n) for r in checks.unmapped_glyphs(df).collect()] == [("½", 2)]
    assert checks.decode_report(df.where("raw is not null")).first().clean_rate == 0.5


@pytest.mark.parametrize("xml,want", [
    ("<math><msub><mi>C</mi><mn>6</mn></msub><msub><mi>H</mi><mn>14</mn></msub></math>", "C_{6}H_{14}"),
    ("<math><mfrac><mn>1</mn><mrow><mi>x</mi><mo>+</mo><mn>2</mn></mrow></mfrac></math>", r"\frac{1}{x+2}"),
    ("<math><msqrt><mi>a</mi><mi>b</mi></msqrt></math>", r"\sqrt{ab}"),
    ("<math><mfenced><mi>a</mi><mi>b</mi></mfenced><mtext>if x</mtext></math>", r"(a,b)\text{if x}"),
    ("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>", r"\sqrt[{3}]{x}"),
    ("<math>", None),
])
def test_mathml(xml, want):
    assert legacy.mathml_to_latex(xml) == want


def test_recognition(spark):
    files = spark.createDataFrame([("a", bytearray(b"p1|p2")), ("b", bytearray(b"!"))], "path string, content binary")

    def pages(raw, dpi):
        if raw == b"!":
            raise ValueError
        return raw.split(b"|")

    def engine():
        return lambda png: [(png.decode(), 0.9), ("noise", 0.1)]

    got = ocr.recognise(ocr.page_images(files, pages), engine).orderBy("page_num").collect()
    assert [(r.path, r.page_num, r.text, r.avg_confidence, r.block_count) for r in got] == [("a", 1, "p1", 0.9, 1), ("a", 2, "p2", 0.9, 1)]
    assert [ocr.pick_device(x) for x in (["xpu", "cuda"], ["xpu"], [])] == ["cuda", "xpu", "cpu"]


def test_reports(spark):
    q = spark.createDataFrame([(1, "x½y", ["a"]), (2, "no", ["½"]), (3, "no", [])], "qid int, raw string, option_math array<string>")
    assert [(r.code_point, r.qid) for r in checks.glyph_search(q, ["½", "z"], 5).orderBy("qid").collect()] == [("U+00BD", 1), ("U+00BD", 2)]
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "concept_id string, parent string")
    assert {(r.concept_id, r.ancestor, r.level) for r in checks.ancestors(tree).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    files = spark.createDataFrame([("d\\f.json", [("Unknown", " t ", None), ("Known", "t", 1), ("Unknown", " ", 2)])], "path string, questions array<struct<topic: string, text: string, q_index: int>>")
    assert [tuple(r) for r in checks.unknown_topics(files).collect()] == [("f.json", 0, " t ")]
    sections = spark.createDataFrame([("b", 1, 3, 10), ("b", 3, 4, 10), ("b", 6, 9, 30_000)], "book string, page_start int, page_end int, char_count int")
    r = chunks.check_sections(sections).first()
    assert (r.gaps, r.overlaps, r.oversize, r.ok) == (1, 1, 1, False)


def test_diverse(spark):
    rows = [(i, [float(i % 2), 1.0], float(i)) for i in range(8)]
    got = checks.diverse(spark.createDataFrame(rows, "qid int, embedding array<double>, score double"), 2)
    assert sorted(r.qid for r in got.collect()) == [6, 7]


def test_outcomes(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", 2, "m"), (1, "b", 1, "m")], "week int, concept_id string, n_questions int, subject string")
    checks.log_outcomes(log, str(tmp_path / "log"))
    checks.log_outcomes(log, str(tmp_path / "log"))
    stored = spark.read.schema(log.schema).json(str(tmp_path / "log"))
    ranks = spark.createDataFrame([(1, "a", 1), (1, "z", 2)], "week int, concept_id string, rank int")
    assert stored.count() == 2 and checks.rescore(stored, ranks, 2).first().weighted_recall == pytest.approx(2 / 3)


def test_native_chunks_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(chunks.chunk_column(F.col("t"))).first()[0] is None
