"""The whole reader of pages, weights from the shared folder included, on a small table of odd pages."""

from lattica.llm import html_blocks


def test_extract_odd_pages(spark):
    article = "<html><body><nav class='menu'><a href='/'>Home</a></nav><article>" + "".join(f"<p>Sentence {i} of the story tells &amp; shows what came of it in the end.</p>" for i in range(6)) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", article), (2, "u", None), (3, None, ""), (1, "u", article)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_blocks.extract(pages).collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1:] == got[3][1:] == ("", 0)
    assert got[0][1].startswith("Sentence 0 of the story tells & shows") and got[0][2] == len(got[0][1])
