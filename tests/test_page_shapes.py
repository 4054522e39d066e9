import random

from geograph.sources import html_tree, readers


def test_a_page_is_read_once(spark):
    """Rows get the headers of their own page without a join, also where two pages have one id."""
    table = lambda *names: "<table><tr><th> Name </th><th>At</th></tr>" + "".join(f"<tr><td> {n} &amp; co </td><td><b>x</b></td><td>more</td></tr>" for n in names) + "</table>"
    pages = spark.createDataFrame([(1, table("a", "b")), (1, table("c").replace("At", "Where")), (2, table("d") + table("e")), (3, "<table></table>"), (4, None)], "page_id long, html string")
    df = readers.extract_table_rows(pages, "Name")
    want = [(1, 0, {"Name": "a & co", "At": "x"}), (1, 0, {"Name": "c & co", "Where": "x"}), (1, 1, {"Name": "b & co", "At": "x"}), (2, 0, {"Name": "d & co", "At": "x"})]
    assert sorted(((r.page_id, r.pos, r["values"]) for r in df.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_layouts_kept_by_shape_are_those_of_the_pages(monkeypatch):
    """Tables of odd pages, each read by itself and with what was kept of pages of the same tags."""
    monkeypatch.setattr(html_tree, "SHAPES", 50)
    rng = random.Random(8)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<TD class='a>b'>", "</td >", "<td/>", "<br>", "<tbody>", "<", "</", ">", '"', "<!--", "-->", "<!x>", "<!", "<?", "<script>", "</script>", "<template>", "</template>", "&amp;", "&am", "p;", " ", " x\n", "y", "<b>", "</b>"]
    layout = lambda page: [[c for c in e.children if c.tag == "td"] for e in page.inside(None, frozenset(["tr", "table"]))]
    known, kept = {}, 0
    for _ in range(6000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        page, found = html_tree._laid(html, layout, known)
        whole = html_tree.Page.of(html)
        kept += page.html == html and not page.elements and bool(whole.elements)
        assert [page.stripped(cells) for cells in found] == [[whole.text(c).strip() for c in cells] for cells in layout(whole)], html
    assert kept > 500 and len(known) <= 50
