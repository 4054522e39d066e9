from geograph.sources import readers


def test_references_need_their_semicolon(spark):
    """A heading that was cut inside a reference keeps what is left of it, as the SQL of html_blocks has it."""
    cut = "<h1>the&amp;&amp;&amp</h1><h1>the&amp&lt;&#39;&#x41;&nosuch;&eacute;</h1>"
    pages = spark.createDataFrame([(1, cut)], "page_id long, html string")
    got = [r.text for r in readers.elements(pages, ["h1"]).orderBy("pos").collect()]
    assert got == ["the&&&amp", "the&amp<'A&nosuch;é"]
