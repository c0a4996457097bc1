"""Workers take and send stretches of a batch, not whole batches."""

import pyarrow as pa
from palimpsest.operators import blocks, engine, formats, layout, packages
from palimpsest.operators.engine import SLICE, SLICE_BYTES, sent_in_slices, sliced


def test_stretches_are_bounded_by_rows_and_bytes_and_lose_nothing():
    rows = ["x"] * 1000 + [None, "é" * SLICE_BYTES, ""] + ["y" * (SLICE_BYTES // 4)] * 9
    batch = pa.array(rows, pa.string())
    found = [texts for (texts,) in sliced(batch)]
    assert [t for texts in found for t in texts] == rows
    assert all(len(t) <= SLICE and (len(t) == 1 or sum(len((x or "").encode()) for x in t) <= SLICE_BYTES) for t in found)
    assert list(sliced(batch.slice(0, 0))) == [] and [len(t) for (t,) in sliced(batch.slice(990, 12))] == [11, 1]


def test_results_are_sent_before_the_next_stretch_is_made():
    made = []
    sent = sent_in_slices(iter([(pa.array(["a"] * 3 * SLICE), pa.array([1] * 3 * SLICE))]), lambda t, n: made.append(t) or n, pa.int64())
    assert len(next(sent)) == SLICE == len(made)
    assert sum(len(a) for a in sent) == 2 * SLICE


def test_functions_over_texts_keep_rows_in_batches_of_several_stretches(spark):
    rows = [(i, None if i % 50 == 3 else f"“{i}” <p>a</p>", "html") for i in range(1500)]
    files = spark.createDataFrame(rows, "id long, text string, format string").coalesce(1)
    at = {i: t for i, t, _ in rows}
    for r in engine.cleaned(files, "standard").collect():
        assert r.report is None if at[r.id] is None else str(r.id) in r.report.cleaned
    for r in formats.clean_files(files).collect():
        assert r.report is None if at[r.id] is None else str(r.id) in r.report.cleaned
    for r in blocks.converted(files, "html", "markdown").collect():
        assert r.converted.text is None if at[r.id] is None else str(r.id) in r.converted.text
    found = engine.findings(files, "standard", id_col="id").groupBy("id").count().collect()
    assert {r.id for r in found} == {i for i, t in at.items() if t is not None}
    pdfs = packages.rendered_packages(files.limit(600), target="pdf")
    assert {r.id for r in packages.pdf_pages(pdfs, "id").collect() if str(r.id) in (r.text or "")} == {i for i in range(600) if at[i] is not None}
    assert {r.id for r in layout.words(pdfs, "id").select("id").collect()} == {i for i in range(600) if at[i] is not None}
