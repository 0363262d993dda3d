"""Line rules on small texts."""

from quillmark.functions import cleaning as C


def test_page_furniture():
    text = "\n".join(f"HEADER\n{i}\n\nbody {i}" for i in range(1, 5))
    assert C.strip_page_furniture(text).split("\n") == ["", "body 1", "", "body 2", "", "body 3", "", "body 4"]


def test_notice_title_and_paragraph():
    assert C.strip_notice("words " * 20 + "\n\nCopyright 1999 someone") == ("words " * 20).rstrip()
    assert C.extract_title("THE TITLE\nSECOND LINE\nThen text") == ("THE TITLE SECOND LINE", 2)
    assert C.extract_title("plain text") == ("Untitled", 0)
    assert C.strip_title_leaks("a\nThe Title 12\n3 THE TITLE\nb", "THE TITLE") == "a\nb"
    assert C.clean_paragraph("¶12 some  text , here") == "some text, here"


def test_clean_documents(spark):
    df = spark.createDataFrame([("63-0801", "A TITLE\nFirst line\nA TITLE 2\nlast"), ("odd", None), ("47-0412M", "x")], "date_id string, text string")
    out = {r["date_id"]: (r["title"], r["text"]) for r in C.clean_documents(df).collect()}
    assert out["63-0801"] == ("A TITLE", "First line\nlast") and out["odd"] == ("Untitled", "")
    assert [r["date_id"] for r in C.chronological(df).collect()] == ["47-0412M", "63-0801", "odd"]
