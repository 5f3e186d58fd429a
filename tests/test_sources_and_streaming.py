import zipfile

import pytest

from lodestone.operators import evaluate, registry
from lodestone.operators.store import SCHEMAS, SUMS, DocumentStore
from lodestone.sources import files
from lodestone.streaming import ingest


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"  \n")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    got = {r.document_name: r for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "café �" and got["a.txt"].page_number is None
    assert got["d.docx"].text == "Hello\na | b"
    assert (got["b.pdf"].error, got["e.txt"].error) == ("unsupported file type .pdf", "no text found")


def test_golden_and_runs(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('# note\n\n{"id": "q1", "question": "What?", "expected_behavior": "answer", "expected_facts": ["3,000"], "expected_pages": [1]}\n')
    cases = files.read_golden(spark, str(path))
    assert [(r.id, r.expected_pages) for r in cases.collect()] == [("q1", [1])]
    path.write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_golden(spark, str(path)).collect()
    run = cases.sparkSession.createDataFrame([("q1", 1.0)], "id string, behavior_correct double")
    name = files.write_run(run, str(tmp_path / "runs"), "my run/..", "20260101")
    assert name == "20260101_my_run_"
    assert [(r.run, r.n) for r in files.list_runs(spark, str(tmp_path / "runs"), "id string, behavior_correct double").collect()] == [(name, 1)]
    assert evaluate.summarize(run, ["behavior_correct"]).first().mean == 1.0


def test_register_skips_known_content(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in registry.register(new).collect()) == [1, 3, 4]
    stored = registry.register(new.where("doc_id = 3"))
    assert sorted(r.doc_id for r in registry.register(new, stored).collect()) == [1, 4]


WORDS = "The scheme pays a pension of three thousand rupees to every farmer who has asked for it. "


def test_a_stream_ends_where_one_ingest_ends(spark, tmp_path):
    """Two runs of a stream, with files in between that are copies, garbled, unreadable
    or of a kind that nobody can read, leave the tables of one ingest of all files."""
    source = tmp_path / "in"
    source.mkdir()
    for name, text in {"a.txt": WORDS * 30, "b.txt": WORDS * 3 + "b", "c.pdf": "x", "d.txt": " ", "e.txt": "zxqv kkjh wwrt ppsd ffgh jjkl zzxc vvbn " * 20}.items():
        (source / name).write_text(text)
    stream_store, told = DocumentStore(spark, f"file://{tmp_path}/streamed"), {}

    def run():
        pages = files.stream_pages(spark, str(source), files_per_batch=2)
        found = lambda number, outcomes: told.update({number: sorted(r.outcome for r in outcomes.collect())})
        ingest.ingest_stream(pages, stream_store, str(tmp_path / "cp"), found).awaitTermination()

    run()
    assert sum(map(len, told.values())) == 5 and "unreadable" in sum(told.values(), [])
    before = stream_store.snapshot().version
    run()  # nothing new
    assert stream_store.snapshot().version == before
    (source / "f.txt").write_text(WORDS * 30)  # as a.txt
    (source / "g.md").write_text(WORDS * 12 + "g")
    run()
    assert sum(map(len, told.values())) == 6  # the copy was known to the state
    whole = DocumentStore(spark, f"file://{tmp_path}/whole")
    whole.ingest(files.read_pages(spark, str(source)))
    got, want = stream_store.tables(), whole.tables()
    assert got["registry"].count() >= 3
    for name in SCHEMAS | SUMS:
        rows = lambda df: sorted(map(repr, df.drop("uploaded_at", "idf").collect()))
        assert rows(got[name]) == rows(want[name]), name


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """The commit of the stream's own log is lost, as if the driver had died before it."""
    source, checkpoint = tmp_path / "in", tmp_path / "cp"
    source.mkdir()
    (source / "a.txt").write_text(WORDS * 3)
    store, told = DocumentStore(spark, f"file://{tmp_path}/store"), []
    for _ in range(2):
        outcome = lambda _, rows: told.append([r.outcome for r in rows.collect()])
        ingest.ingest_stream(files.stream_pages(spark, str(source)), store, str(checkpoint), outcome).awaitTermination()
        for name in ("0", ".0.crc"):
            (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert told == [["registered"], ["duplicate"]] and store.read("chunks").count() == 1
