"""Wrappers are learned from all pages of a host, however many layouts it has."""

from sextant.llm import wrapper


def test_more_layouts_than_any_draw_holds(spark):
    def page(k, n):
        body = "".join(f"<p>Story {k} {n} paragraph {j}.</p>" for j in range(3 + n))
        return f"<body><div class=a{k}><div class=top{k}>Daily {k} News since 1900</div><div class=b{k}><div class=story{k}><p>Read all of {k} here</p>{body}</div></div></div></body>"

    rows = [(10 * k + n, f"http://h.example/{k}/{n}", page(k, n)) for k in range(30) for n in range(3)]
    found = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i, _, _ in rows if found[i].split("\n") != [f"Story {i // 10} {i % 10} paragraph {j}." for j in range(3 + i % 10)]]
    assert not wrong, (len(wrong), found[wrong[0]])
