"""Answers that the command line keeps for the next call."""

import io
import zipfile

from quern import __main__ as cli
from quern.sources.store import Store


def test_answers_are_kept(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{p("The library is open through all of the night.")}{p("Readers may stay until the first lesson begins.")}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    args = ["--best", "-k", "2", str(tmp_path), str(tmp_path / "store"), "How long is the library open?"]
    first = cli.run(spark, cli.arguments(args))
    store = Store(spark, str(tmp_path / "store"))
    assert "(cached)" not in first[0][1] and store.count("answers") == 1
    again = cli.run(spark, cli.arguments([*args, args[-1]]))
    assert all("(cached)" in display for _, display in again) and len(again) == 2 and store.count("answers") == 1
    assert "(cached)" not in cli.run(spark, cli.arguments(["--no-cache", *args]))[0][1]
