"""Folders of mixed files: what is read, what is set aside, pictures and their summaries; pages as Markdown."""

import zipfile

import pytest

from lodestrata.functions.markup import html_markdown
from lodestrata.sources import files
from lodestrata.sources.store import staged

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml"'


def paragraph(text, style=None, inner=""):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:t>{text}</w:t>{inner}</w:r></w:p>"


def picture(rid):
    return f'<w:drawing><a:blip r:embed="{rid}"/></w:drawing>'


def docx(path, body, pictures=(), styles=""):
    rels = "".join(f'<Relationship Id="{rid}" Target="{target}"/>' for rid, target, _ in pictures)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        for target, data in {t: d for _, t, d in pictures}.items():
            z.writestr(f"word/{target}", data)


def test_word_documents_with_pictures(spark, tmp_path):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    body = paragraph("Guide", "Title") + paragraph("One", "H1x") + paragraph("Two", "Heading2") + paragraph("item", "ListBullet") + paragraph("See", inner=picture("r1") + picture("r2")) + paragraph("", inner=picture("r3"))
    body += f'<w:p><w:r><v:imagedata r:id="r1"/></w:r></w:p><w:tbl><w:tr>{cell("a|b")}{cell("c")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl>' + paragraph("end")
    docx(tmp_path / "g.docx", body, [("r1", "media/x.png", b"PNG1"), ("r2", "media/y.JPG", b"JPG2"), ("r3", "media/z.emf", b"EMF")], f'<w:style w:styleId="H1x"><w:name w:val="heading 1"/></w:style>')
    docx(tmp_path / "h.docx", paragraph("Other", inner=picture("r9")), [("r9", "media/same.png", b"PNG1")])
    read = staged(files.parsed(files.binary(spark, str(tmp_path))), "read")
    text = {r["path"][-6:]: r["text"] for r in files.documents(read).collect()}
    assert text["g.docx"] == "# g\n\n## Guide\n## One\n### Two\n- item\nSee\n![图0](images/img_0.png)\n![图1](images/img_1.JPG)\n\n![图0](images/img_0.png)\n| a\\|b | c |\n|---|---|\n| 1 | 2 |\n\nend"
    found = staged(files.pictures(read), "pictures")
    rows = {(r["path"][-6:], r["name"]): r for r in found.collect()}
    assert set(rows) == {("g.docx", "img_0.png"), ("g.docx", "img_1.JPG"), ("h.docx", "img_0.png")}
    first = rows["g.docx", "img_0.png"]
    assert text["g.docx"][first["place"] :].startswith("![图0]") and first["before"].endswith("See\n") and first["after"].startswith("\n![图1]") and bytes(first["content"]) == b"PNG1"
    once = files.distinct_pictures(found)
    assert sorted((bytes(r["content"]), r["uses"]) for r in once.collect()) == [(b"JPG2", 1), (b"PNG1", 2)]
    summaries = once.where("uses = 2").selectExpr("sha256", "'http://store/one.png' AS url", "'a wall' AS summary")
    new = {r["path"][-6:]: r["text"] for r in files.with_summaries(files.documents(read), found, summaries).collect()}
    assert new["h.docx"] == "# h\n\nOther\n![a wall](http://store/one.png)" and new["g.docx"].count("![a wall](http://store/one.png)") == 2 and "![图1](images/img_1.JPG)" in new["g.docx"]


def test_mixed_encodings_and_broken_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("云南".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("名称,级别\n长城,5A\n , \n\"故,宫\",\n".encode("gbk"))
    (tmp_path / "c.csv").write_text("名称,级别\n西湖,5A\n", encoding="utf-8")
    (tmp_path / "d.json").write_text('[{"k": {"x": [1]}, "n": null}, "free"]')
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "g.xlsx").write_bytes(b"no book")
    (tmp_path / "h.docx").write_bytes(b"no book")
    (tmp_path / "i.html").write_text("<title>T</title><p>x")
    (tmp_path / "j.exe").write_bytes(b"x")
    (tmp_path / "k.md").write_text("# own\n")
    (tmp_path / "l.csv").write_bytes(b"")
    read = staged(files.parsed(files.binary(spark, str(tmp_path)), rows_most=1), "read")
    text = {r["path"].rpartition("/")[2]: r["text"] for r in files.documents(read).collect()}
    nested = '# d\n\n## 记录 1\n- k: {\n    "x": [\n      1\n    ]\n  }\n- n: None\n\n## 记录 2\nfree\n'
    assert text == {"a.txt": "# a\n\n云南", "d.json": nested, "e.json": "", "f.txt": "", "h.docx": "", "i.html": "# T\n\nT\n\nx", "j.exe": "", "k.md": "# own\n"}
    assert sorted((r["path"][-5:], r["title"], r["content"]) for r in files.table_rows(read).collect()) == [("b.csv", "sheet1-第2行", "名称: 长城\n级别: 5A"), ("c.csv", "sheet1-第2行", "名称: 西湖\n级别: 5A")]
    assert {(r["path"].rpartition("/")[2], r["stage"]) for r in files.quarantine(read).collect()} == {("e.json", "parse"), ("f.txt", "decode"), ("g.xlsx", "parse"), ("h.docx", "parse"), ("j.exe", "route")}
    every = files.parsed(files.binary(spark, str(tmp_path)).where("kind = 'csv'"))
    assert files.table_rows(every).where("path LIKE '%b.csv'").select("title", "content").collect()[-1] == ("sheet1-第4行", "名称: 故,宫")


@pytest.mark.parametrize("html,want", [
    ("<h1>A</h1><h2>B</h2><h6>C</h6>", "# A\n\n## B\n\n###### C"),
    ("<p>x <b>bold</b>, <strong> s </strong><em>e</em> <del>d</del></p>", "# n\n\nx **bold**, **s** *e* ~~d~~"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>", "# n\n\n- a\n- b\n  - c\n\n3. x\n4. y"),
    ('<a href="/x" title="t">link</a> <a>bare</a> <a href="/y"></a>', '# n\n\n[link](/x "t") bare'),
    ("<table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table>", "# n\n\n| h | i |\n| --- | --- |\n| 1\\|2 |  |"),
    ("<pre>a  *b*\n c</pre><p><code>x_y</code> x_y *", "# n\n\n```\na  *b*\n c\n```\n\n`x_y` x\\_y \\*"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "# n\n\n> q\n>\n> r"),
    ("one<br>two<hr>three", "# n\n\none  \ntwo\n\n---\n\nthree"),
    ('<img src="a.png" alt="A"><script>x</script><nav>y</nav><!-- z -->', "# n\n\n![A](a.png)"),
    ("&lt;a&gt; &copy; &#20013; &nbsp;x", "# n\n\n<a> © 中 x"),
    ("<title>T</title><main>in</main>out", "# T\n\nin"), ("<title> </title><h1>H</h1><article>in</article>", "# H\n\nin"), ("", "# n\n\n"), (None, "# n\n\n"), ("<p>a<p>b</div></p>c", "# n\n\na\n\nb\n\nc"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "# n\n\ndeep"),
])
def test_pages_as_markdown(html, want):
    assert html_markdown(html, "n") == want


def test_references_that_were_cut_off(spark):
    page = "<html><body><article><h1>a &amp;&amp</h1><p>b &lt c &lt; d&#38; e & f</p></article></body></html>"
    assert html_markdown(page, "n") == "# a &&\n\nb < c < d& e & f"
    assert html_markdown(page, "n", closed=True) == "# a &&amp\n\nb &lt c < d& e & f"
    got = files.pages_as_markdown(spark.createDataFrame([("u", page)], "url string, html string"), closed=True)
    assert got.first()["markdown"] == "# a &&amp\n\nb &lt c < d& e & f"
