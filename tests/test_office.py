import io
import zipfile

import pytest

from corpusloom.operators import blocks, office


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w"'


def test_docx():
    para = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Guide", "H1") + para(" ") + para("text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + para("Deep", "heading 9")
    data = packed(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>'})
    title, found = office.parse_docx(data)
    assert title == "Guide"
    assert [(b["type"], b["level"], b["text"]) for b in found] == [("heading", 1, "Guide"), ("paragraph", 0, "text"), ("table", 0, "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("heading", 6, "Deep")]


def test_pptx():
    A = 'xmlns:p="p" xmlns:a="a"'
    shape = lambda text, kind="": f'<p:sp><p:nvPr>{kind}</p:nvPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda k: f'<p:sld {A}>{shape(f"body {k}")}{shape(f"Slide {k}", chr(60) + "p:ph type=" + chr(34) + "title" + chr(34) + "/>")}</p:sld>'
    title, found = office.parse_pptx(packed(**{f"ppt/slides/slide{k}.xml": slide(k) for k in (10, 2)}))
    assert title == "Slide 2"
    assert [b["text"] for b in found] == ["Slide 2", "body 2", "Slide 10", "body 10"]


def test_xlsx():
    book = '<workbook xmlns:r="r"><sheets><sheet name="Data" r:id="x1"/><sheet name="None" r:id="x2"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    data = packed(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<R><r Id="x1" Target="worksheets/s1.xml"/><r Id="x2" Target="/xl/none.xml"/></R>', "xl/worksheets/s1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>"})
    title, found = office.parse_xlsx(data)
    assert title == "" and found[0]["text"] == "Data" and found[0]["level"] == 2
    assert found[1]["rows"] == [["name", "", "k"], ["1.5", "True"]] and len(found) == 2


def test_registered_and_refused():
    office.register_all()
    assert blocks.parse(office.TYPES["docx"], b"PK no")["error"]
    bomb = packed(**{"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    with pytest.raises(ValueError):
        office.parse_docx(bomb)
