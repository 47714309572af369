"""Word files for tests."""

import io
import zipfile

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>'


def p(text, style=""):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def tc(inner, pr=""):
    return f"<w:tc>{f'<w:tcPr>{pr}</w:tcPr>' if pr else ''}{inner}</w:tc>"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
    return out.getvalue()
