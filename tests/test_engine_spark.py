"""Plans, sources, streams and conversions on a session."""

from collections import Counter

from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.functions.text import byte_offset, newline_kind, spans
from palimpsest.operators import blocks, engine, formats, lexicon, ngrams, stylometry
from palimpsest.operators import rules as R
from palimpsest.plans.injection import SNIPPETS
from palimpsest.sources.files import decoded, read_files
from palimpsest.sources.markup import html_spans, markdown_spans
from palimpsest.streaming.clean import cleaned_stream, rule_counts, write_cleaned


def docs(spark):
    rows = [(i, t + " x") for i, t in enumerate(SNIPPETS)] + [(900, None), (901, ""), (902, "plain " * 20_000), (0, SNIPPETS[0] + " x"), (None, "“null id”")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_findings_and_reports_agree(spark):
    frame = docs(spark)
    found = engine.findings(frame, "aggressive").collect()
    made = {(r.doc_id, r.text): r.report for r in engine.cleaned(frame, "aggressive").collect()}
    assert made[900, None] is None and made[901, ""].cleaned == "" and not made[902, "plain " * 20_000].changed
    applied = Counter(r.rule_id for r in found if r.applied)
    flagged = Counter(r.rule_id for r in found if r.replacement is None)
    reports = [r.report for r in engine.cleaned(frame, "aggressive").collect() if r.report]
    assert applied == sum((Counter(r.applied) for r in reports), Counter()) and flagged == sum((Counter(r.flagged) for r in reports), Counter())
    table = {r.rule_id: (r.applied, r.flagged) for r in engine.report(engine.findings(frame, "aggressive")).collect()}
    assert table == {k: (applied[k], flagged[k]) for k in {*applied, *flagged, *(r.rule_id for r in found)}}
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in found:
        t = texts[r.doc_id]
        assert (r.byte_start, r.byte_end) == (len(t[: r.start].encode()), len(t[: r.end].encode()))


def test_native_counts_and_spans_equal_the_engine(spark):
    frame = docs(spark).filter("text is not null and doc_id < 900")
    rules = [r for r in R.builtin() if r.pattern and not r.scan]
    columns = [engine.native_count(r, F.col("text")).alias(f"n{k}") for k, r in enumerate(rules)]
    for row in frame.select("text", *columns).collect():
        for k, r in enumerate(rules):
            assert row[f"n{k}"] == len(list(r.find(row.text, row.text.translate(R.ASCII_LOWER), 2))), (r.id, row.text)
    some = [r for r in rules if r.id in ("typo.quotes.straighten", "unicode.ansi.strip", "markers.chat-tokens", "style.punctuation.repeated")]
    for row in frame.select("text", *[engine.native_spans(r, F.col("text")).alias(f"s{k}") for k, r in enumerate(some)]).collect():
        for k, r in enumerate(some):
            assert [(x.s, x.e) for x in row[f"s{k}"]] == [f[:2] for f in r.find(row.text, row.text.translate(R.ASCII_LOWER), 2)]


def test_native_cleaning_equals_the_engine(spark):
    frame = docs(spark).filter("text is not null and doc_id < 900")
    for r in R.builtin():
        if r.pattern and not r.scan and isinstance(r.replace, (str, dict)):
            detector = engine.Detector("aggressive", [r])
            for row in frame.select("text", engine.native_clean(r, F.col("text")).alias("c")).collect():
                assert row.c == engine.clean_text(row.text, detector)["cleaned"], r.id


def test_native_lexicon_equals_the_engine(spark):
    specs = lexicon.builtin_specs()
    frame = docs(spark).filter("doc_id < 900")
    got = Counter({(r.doc_id, r.rule_id): r.n for r in engine.lexical_counts(frame.dropDuplicates(), specs[:12]).collect()})
    want = Counter((r.doc_id, r.rule_id) for r in engine.findings(frame.dropDuplicates(), "aggressive", rules=lexicon.rules_of(specs[:12])).collect())
    assert got == want and got


def test_spans_and_offsets(spark):
    row = spark.createDataFrame([("aé𝐀b!!x??", "a\r\nb\rc")], "t string, n string").select(spans(F.col("t"), "[!?]{2,}").alias("s"), byte_offset(F.col("t"), F.lit(3)).alias("b"), newline_kind(F.col("n")).alias("k")).first()
    assert [(x.s, x.e, x.m) for x in row.s] == [(4, 6, "!!"), (7, 9, "??")] and row.b == 7 and row.k == "mixed"


def test_paths(spark):
    names = ["a/report", "report.cleaned", ".hidden", "report.", "Report.PDF", "x.htm", "r.docx", "r.v1", "d/", "r.v1.txt"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    rows = frame.select("p", paths.format_of(F.col("p")).alias("f"), paths.with_extension(F.col("p"), "md").alias("m"), paths.cleaned_path(F.col("p"), "txt").alias("c")).collect()
    assert [r.m for r in rows] == ["a/report.md", "report.cleaned.md", ".hidden.md", "report.md", "Report.md", "x.md", "r.md", "r.v1.md", "d/cleaned.md", "r.v1.md"]
    assert [r.f for r in rows] == [None, None, None, None, "pdf", "html", "docx", None, None, "text"]
    assert rows[4].c == "Report.cleaned.txt" and rows[1].c == "report.cleaned.txt" and rows[8].c == "d/cleaned.cleaned.txt"
    media = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nxx"),), (bytearray(b"\xff\xd8\xffx"),), (bytearray(b"RIFF0000WEBPVP8 "),), (bytearray(b'<?xml version="1.0"?><SVG>'),), (bytearray(b"text"),)], "c binary")
    assert [r[0] for r in media.select(paths.media_of(F.col("c"))).collect()] == ["png", "jpeg", "webp", "svg", None]


def test_files_with_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿héllo\r\nx".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.xyz").write_bytes(b"x")
    (tmp_path / "d.html").write_bytes(b"<p>\xe2\x80\x9cq\xe2\x80\x9d</p>")
    rows = {r.path[-5:]: r for r in decoded(read_files(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "héllo\r\nx" and rows["a.txt"].had_bom and rows["a.txt"].newline == "crlf" and rows["a.txt"].error is None
    assert rows["/b.md"].error.kind == "Encoding" and rows["c.xyz"].error.kind == "UnsupportedFormat"
    made = {r.path[-5:]: r.report for r in formats.clean_files(decoded(read_files(spark, str(tmp_path)))).collect()}
    assert made[".html"].cleaned == '<p>"q"</p>' and made["/b.md"] is None


def test_formats_protect_structure():
    detector = engine.Detector("aggressive")
    html = '<h1 title="“t”">a…</h1><pre>“c”</pre><script>“s”</script><p>x &#8220;y&#8221; &amp; “z” <b>sp</b>lit</p><!-- “c” -->'
    got = formats.clean_source(html, "html", detector)
    assert got["cleaned"] == '<h1 title="“t”">a...</h1><pre>“c”</pre><script>“s”</script><p>x "y" &amp; "z" <b>sp</b>lit</p><!-- “c” -->' and got["error"] is None
    md = "---\ntitle: “t”\n---\n# “H” `“c”`\n\n```\n“code”\n```\n[“l”](http://“u”) *e…*\n"
    got = formats.clean_source(md, "markdown", detector)
    assert got["cleaned"] == '---\ntitle: “t”\n---\n# "H" `“c”`\n\n```\n“code”\n```\n["l"](http://“u”) *e...*\n'
    assert [s.text for s in html_spans("<p>a<b>b</b></p>c")] == ["ab", "c"] and [s.text for s in markdown_spans("- **x** y\n")] == ["x", " y"]


def test_containers():
    rows = lambda s, k: [r["rule_id"] for r in formats.containers(s, k)]
    assert rows("---\nai_generated: true\nauthor: Jane\ntool: ChatGPT\nai_model: no\n---\nx <!-- Generated by Claude -->", "markdown") == ["container.markdown-frontmatter"] * 2 + ["container.html-ai-metadata"]
    assert rows('<link rel="c2pa-manifest" href="x"><meta name="generator" content="WordPress"><meta property="x" content="TrainedAlgorithmicMedia">', "html") == ["container.c2pa-manifest", "container.html-ai-metadata"]
    assert rows("-----BEGIN C2PA MANIFEST-----\nhttps://x\n-----END C2PA MANIFEST-----", "text") == ["container.c2pa-manifest"]


def test_blocks_and_conversion(spark):
    md = "# Head\n\nOne *two*\nthree.\n\n- a\n  - b\n1. c\n\n```py\nx = `1`\n```\n\n| A | B |\n|---|---|\n| 1 | 2\\|3 |\n\n> quoted\n> more\n\n---\n"
    got = blocks.read_markdown(md)
    assert [b.kind for b in got] == ["heading", "paragraph", "item", "item", "item", "code", "row", "row", "quote", "divider"]
    assert blocks.read_markdown(blocks.render_markdown(got)) == got
    html = "<h2>T</h2><p>a<br>b</p><ol><li>x<li>y</ol><table><tr><th>A<th>B</tr><tr><td>1</td><td></td></tr></table><pre>c\n d</pre><script>no</script><blockquote>q</blockquote>"
    assert [(b.kind, b.text) for b in blocks.read_html(html)] == [("heading", "T"), ("paragraph", "a b"), ("item", "x"), ("item", "y"), ("row", "A B"), ("row", "1 "), ("code", "c\n d"), ("quote", "q")]
    assert [b.kind for b in blocks.read_text("Para\nline\n\n    code\n\n- item\n2) two\n")] == ["paragraph", "code", "item", "item"]
    text = "Certainly! The report covers sales in all regions. I hope this helps!\n\nAs an AI language model, I cannot.\n\nThe “kept” quotes, the the the end."
    frame = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "As an AI language model, I cannot.")], "id long, text string")
    rows = {r.id: r.converted for r in blocks.converted(frame, "text", "markdown").collect()}
    assert rows[1].text == "The report covers sales in all regions.\n\nThe “kept” quotes, the end.\n" and rows[1].removed == 1
    assert rows[2].text is None and rows[3].text == "" and rows[4].error == "empty output"
    assert blocks.converted(frame, "text", "text").filter("id = 1").first().converted.text == text
    assert blocks.render_text(blocks.read_markdown("# H\n\n" + "word " * 40)).split("\n")[0:2] == ["H", "="]
    assert blocks.blocks(frame, "id", kind="text").filter("id = 1").count() == 3


def test_stylometry_gap(spark):
    even = " ".join(f"The system moreover provides a robust way to manage the data in part {i}." for i in range(12))
    bursty = "No. " + "It rained for three days and the cellar filled with brown water that nobody wanted to touch, so we waited. " * 2 + "Then it stopped! Who knew? " + "My uncle came by with a pump he had borrowed from the brewery down the road where he once worked as a boy. " * 2
    rows = {r.doc_id: r for r in stylometry.profile(spark.createDataFrame([(1, even), (2, bursty), (3, "Too short."), (4, None)], "doc_id long, text string")).collect()}
    assert rows[1].score - rows[2].score > 0.3 and rows[3].score is None and rows[4].n_words == 0


def test_ngram_disruption(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f a b c d e", "a b c d e x"), (2, "a", "a"), (3, None, "b")], "id long, before string, after string")
    rows = {r.id: r for r in ngrams.disruption(pairs, "id").collect()}
    assert (rows[1].windows, rows[1].lost) == (7, 6) and rows[2].windows == 0 and rows[3].tokens_before == 0


def test_streams(spark, tmp_path):
    frame = spark.createDataFrame([(i, "a “b” …", f"2026-01-01 00:0{i}:00") for i in range(4)], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    write_cleaned(cleaned_stream(stream).select("doc_id", "report.cleaned"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.cleaned for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {'a "b" ...'}
    query = rule_counts(stream, "at", "2 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.rule_id, r.n) for r in spark.table("counts").collect()} == {("typo.quotes.straighten", 4), ("typo.ellipsis.expand", 2)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["rules"](spark, "").count() == 103


def package(body, **more):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        for name, text in more.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_word_packages(spark):
    from palimpsest.operators import packages
    from palimpsest.sources import docx

    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T…</w:t></w:r></w:p><w:p><w:r><w:t>“a &amp; b</w:t></w:r><w:r><w:t xml:space="preserve"> c”</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    core = "<cp:coreProperties><dc:creator>python-docx</dc:creator><dcterms:created>2013-12-23T23:15:00Z</dcterms:created></cp:coreProperties>"
    raw = package(body, docProps__core_DOT_xml=core, word__header1_DOT_xml="<w:hdr><w:p><w:t>h…</w:t></w:p></w:hdr>")
    files = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"PK bad")), ("c", None), ("d", bytearray(package("<w:p><w:t>plain</w:t></w:p>")))], "path string, content binary")
    rows = {r.path: r.report for r in packages.clean_packages(files).collect()}
    parts = docx.parts(rows["a"].cleaned)
    assert '<w:t>T...</w:t>' in parts["word/document.xml"] and '<w:t>"a &amp; b</w:t></w:r><w:r><w:t xml:space="preserve"> c"</w:t>' in parts["word/document.xml"]
    assert parts["word/header1.xml"] == "<w:hdr><w:p><w:t>h...</w:t></w:p></w:hdr>" and rows["a"].edits_applied == 4
    assert rows["b"].error and rows["c"].error and not rows["d"].changed
    assert [r.rule_id for r in packages.metadata_findings(files).collect()] == ["container.docx-generator-metadata"] * 2
    text = {r.path: r.converted for r in packages.converted_packages(files).collect()}
    assert text["a"].text == "## T…\n\n“a & b c”\n\n  - item\n\n| A | B |\n| --- | --- |\n" and text["b"].error
    found = blocks.read_markdown("# H\n\ntext <&>\n\n- x\n\n| A | B |\n|---|---|\n| 1 | 2 |\n")
    assert docx.blocks(docx.render(found)) == found and docx.render(found) == docx.render(found)


def test_pictures_survive_damage():
    from palimpsest.plans.queries import _PICTURES
    from palimpsest.sources import media

    whole = [bytes.fromhex(p) for p in _PICTURES]
    assert [[f["rule_id"] for f in media.findings(p)] for p in whole] == [["container.image-ai-metadata"], ["container.c2pa-manifest"], ["container.image-ai-metadata"], []]
    for p in whole:
        for n in range(0, len(p), 7):
            media.findings(p[:n])
            media.findings(p[:n] + bytes([p[n] ^ 0x55]) + p[n + 1 :])
    assert [f["rule_id"] for f in media.findings(b"<svg ><metadata><x>c2pa:manifest</x></metadata></svg>")][0] == "container.c2pa-manifest"


def test_coverage_names_known_rules(spark):
    from palimpsest.operators import literals as lit
    from palimpsest.plans.queries import coverage

    ids = {r.id for r in R.builtin()} | {"watermark.ngram-disrupt"}
    named = {rule for _, _, rules in lit.FAMILIES for rule in rules}
    assert {r for r in named if not r.startswith("container.")} - ids - {r for r in named if r.endswith(".container") or r == "unicode.whitespace-stego"} == set()
    assert coverage(spark, "OPENAI").count() > 5


def test_pdf_files(spark):
    import zlib

    import pytest

    from palimpsest.operators import packages
    from palimpsest.sources import pdf

    made = pdf.render(blocks.read_markdown("# Héad (x) \\\\ y\n\n" + "word — “q” " * 300))
    pages = pdf.text_of(made)
    assert len(pages) == 1 and pages[0].startswith("Héad (x) \\ y\n") and pages[0].count("“q”") == 300
    cmap = b"begincmap 1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange endcmap"
    code = zlib.compress(b"BT /F1 12 Tf 10 700 Td [<0001> -300 <0002>] TJ 0 -14 Td <00030004> Tj ET")
    odd = (
        b"%%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]/Count 1>> endobj 3 0 obj <</Type/Page/Parent 2 0 R/Contents[5 0 R]/Resources<</Font<</F1 4 0 R>>>>>> endobj\n"
        b"4 0 obj <</Subtype/Type0/ToUnicode 6 0 R>> endobj 5 0 obj <</Length %d/Filter/FlateDecode>> stream\n%s\nendstream endobj 6 0 obj <<>> stream\n%s\nendstream endobj\n"
        b"7 0 obj <</Producer(ChatGPT export)/Author(Jane)>> endobj trailer <</Root 1 0 R/Info 7 0 R>>" % (len(code), code, cmap)
    )
    assert pdf.text_of(odd) == ["Hi a\nbc"]
    assert [f["rule_id"] for f in pdf.metadata(odd)] == ["container.pdf-info-metadata"]
    for bad in (b"", b"no", made.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")):
        with pytest.raises(pdf.BadPdf):
            pdf.text_of(bad)
    for n in range(0, len(made), 61):
        for damaged in (made[:n], made[:n] + bytes([made[n] ^ 0x2A]) + made[n + 1 :]):
            try:
                pdf.text_of(damaged)
                pdf.metadata(damaged)
            except pdf.BadPdf:
                pass
    files = spark.createDataFrame([("a", bytearray(made)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    rows = {r.path: r for r in packages.pdf_pages(files).collect()}
    assert rows["a"].page == 1 and rows["b"].error and rows["c"].error
    assert packages.converted_packages(files).filter("path = 'a'").first().converted.text.startswith("Héad")
