"""Whole pages against a walk with a stack of open lists."""

import base64
import random
from html import escape

from docloom.operators import rendering as R

ROWS = "doc_id long, pos long, kind string, text string, style string, num_id long, ilvl long"


def esc(t):
    return escape(t.strip(), quote=False).replace('"', "&quot;")


def page(rows, ordered, cells, images):
    out, stack, sections, dash = [], [], 0, False

    def close(depth=0):
        while len(stack) > depth:
            out.append(f"</li></{stack.pop()}>")

    def end_dash():
        nonlocal dash
        if dash:
            out.append("</ul>")
        dash = False

    for r in rows:
        picture = "".join(f'<img src="data:image/png;base64,{base64.b64encode(d).decode()}" />' for d in images.get(r["pos"], []))
        text, style = r["text"] or "", r["style"] or ""
        if r["kind"] != "table" and not text.strip() and not picture:
            continue
        if r["kind"] == "table":
            close()
            end_dash()
            if r["pos"] not in cells:
                out.append(f"<table><tr><td>{f'<p>{esc(text)}</p>' if text.strip() else ''}</td></tr></table>")
                continue
            places = cells[r["pos"]]
            out.append("<table>")
            for n in range(max(a for a, _ in places) + 1):
                out.append("<tr>")
                for (a, b), (cell, said) in sorted(places.items()):
                    own = [p for p, (c, _) in places.items() if c == cell]
                    if a == n and (a, b) == min(own):
                        wide, high = len({y for _, y in own}), len({x for x, _ in own})
                        out.append("<td" + (f' colspan="{wide}"' if wide > 1 else "") + (f' rowspan="{high}"' if high > 1 else "") + ">" + "".join(f"<p>{esc(p)}</p>" for p in said.split("\n") if p.strip()) + "</td>")
                out.append("</tr>")
            out.append("</table>")
        elif style.startswith("Heading "):
            close()
            end_dash()
            sections += 1
            out.append(f'<h{style[-1]} data-section-id="docx-sec-{sections}">{esc(text)}{picture}</h{style[-1]}>')
        elif r["num_id"] is not None or style.startswith("List "):
            end_dash()
            level = min(max(r["ilvl"] or 0, 0), 8) if r["num_id"] is not None else 0
            kind = ("ol" if (r["num_id"], level) in ordered else "ul") if r["num_id"] is not None else "ol" if style.startswith("List Number") else "ul"
            close(level + 1)
            if len(stack) == level + 1:
                if stack[-1] == kind:
                    out.append("</li><li>")
                else:
                    out.append(f"</li></{stack.pop()}><{kind}><li>")
                    stack.append(kind)
            else:
                while len(stack) < level:
                    stack.append("ul")
                    out.append("<ul><li>")
                stack.append(kind)
                out.append(f"<{kind}><li>")
            out.append(esc(text) + picture)
        else:
            close()
            first = text.strip()[:1]
            if first and first in "-–—−" and text.strip()[1:]:
                out.append(("" if dash else '<ul class="dash-list">') + f"<li>{esc(text.strip()[1:])}{picture}</li>")
                dash = True
            else:
                end_dash()
                out.append(f"<p>{esc(text)}{picture}</p>")
    close()
    end_dash()
    return f'<div class="docx-content">{"".join(out)}</div>'


def grid(r):
    """Cells that take rectangles of a small table."""
    high, wide = r.randint(1, 4), r.randint(1, 4)
    places, n = {}, 0
    for a in range(high):
        for b in range(wide):
            if (a, b) not in places:
                h, w = r.randint(1, high - a), r.randint(1, wide - b)
                while any((a, b + k) in places for k in range(w)):
                    w -= 1
                for x in range(a, a + h):
                    for y in range(b, b + w):
                        places[x, y] = (n, ["one & two", "", "a\nb\n \nc"][n % 3])
                n += 1
    return places


def test_pages_equal_a_walk(spark):
    r = random.Random(12)
    texts, styles = ["word <b>", "- dashed", "– second", "-", "", "  ", 'say "x" & y', "−minus"], [None, "Normal", "Normal", "Heading 1", "Heading 3", "List Bullet", "List Number", "List Paragraph"]
    docs, ordered, cells, images = {}, {}, {}, {}
    for d in range(400):
        rows = []
        for pos in range(r.randint(0, 14)):
            listed = r.random() < 0.5
            rows.append({"doc_id": d, "pos": pos, "kind": "table" if r.random() < 0.1 else "p", "text": r.choice(texts), "style": r.choice(styles), "num_id": r.choice([1, 2]) if listed else None, "ilvl": r.choice([None, 0, 0, 1, 1, 2, 3, 8, 11, -1])})
        docs[d] = rows
        ordered[d] = {(n, i) for n in (1, 2) for i in range(9) if r.random() < 0.5}
        cells[d] = {x["pos"]: grid(r) for x in rows if x["kind"] == "table" and r.random() < 0.8}
        images[d] = {x["pos"]: [bytes([x["pos"]] * 70)] * r.randint(1, 2) for x in rows if x["kind"] == "p" and r.random() < 0.1}
    df = spark.createDataFrame([tuple(x.values()) for rows in docs.values() for x in rows], ROWS)
    table = spark.createDataFrame([(d, p, c, a, b, t) for d, own in cells.items() for p, places in own.items() for (a, b), (c, t) in places.items()], "doc_id long, pos long, cell long, row_no long, col_no long, text string")
    numbers = spark.createDataFrame([(d, n, i, True) for d, own in ordered.items() for n, i in own], "doc_id long, num_id long, ilvl long, ordered boolean")
    drawn = spark.createDataFrame([(d, p, n, "image/png", x) for d, own in images.items() for p, xs in own.items() for n, x in enumerate(xs)], "doc_id long, pos long, no int, content_type string, data binary")
    got = {x.doc_id: x.html for x in R.rendered(df, table, numbers, drawn).collect()}
    for d, rows in docs.items():
        want = page(rows, ordered[d], cells[d], images[d])
        assert got.get(d, page([], {}, {}, {})) == want, (rows, ordered[d])


def test_pages_without_parts(spark):
    df = spark.createDataFrame([(1, 0, "table", "x\ny", None, None, None), (1, 1, "p", "- a", None, 7, None), (2, 0, "p", None, None, None, None)], ROWS)
    assert {r.doc_id: r.html for r in R.rendered(df).collect()} == {1: '<div class="docx-content"><table><tr><td><p>x\ny</p></td></tr></table><ul><li>- a</li></ul></div>'}
    assert R.rendered(spark.createDataFrame([], ROWS)).count() == 0
