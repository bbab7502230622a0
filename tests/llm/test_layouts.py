"""Pages with names and forms that the training pages don't have: words of main text found, and none beside them."""

import random

import pytest

#: (menu, head, side, notice, comments, foot, article) as (tag, attributes); none of the names is among those of the training pages.
NAMES = [
    [("div", 'class="navlinks"'), ("div", 'class="top-strip"'), ("div", 'class="rightcol"'), ("div", 'class="gdpr"'), ("section", 'id="disqus_thread"'), ("div", 'class="page-bottom"'), ("div", 'class="post-body"')],
    [("nav", ""), ("header", ""), ("aside", ""), ("div", 'class="toast"'), ("div", 'id="feedback"'), ("footer", ""), ("div", 'class="prose"')],
    [("ul", 'class="tabs"'), ("div", ""), ("div", 'class="also"'), ("div", ""), ("div", 'class="ugc"'), ("div", 'id="colophon"'), ("article", "")],
    [("div", 'id="x1"'), ("div", 'id="x2"'), ("div", 'id="x3"'), ("div", 'id="x4"'), ("div", 'id="x5"'), ("div", 'id="x6"'), ("div", 'id="x7"')],
    [("div", ""), ("div", ""), ("div", ""), ("div", ""), ("div", ""), ("div", ""), ("div", "")],
    [("nav", 'aria-label="site"'), ("div", 'class="brandbar"'), ("aside", 'class="rail"'), ("div", 'role="dialog"'), ("section", 'class="reader-reactions"'), ("footer", 'class="imprint"'), ("main", 'class="copy"')],
]


def prose(rng, n):
    return " ".join(" ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(6, 16))).capitalize() + "." for _ in range(n))


def layout(seed):
    rng = random.Random(seed)
    menu, head, side, notice, comments, foot, article = ((f"<{t} {a}>".replace(" >", ">"), f"</{t}>") for t, a in NAMES[seed % len(NAMES)])
    short = lambda n: " ".join(rng.choice(("Home", "News", "About", "Sport", "Shop", "Login", "Contact", "More")) for _ in range(n))
    main = [short(4) + " today", *(prose(rng, rng.randint(2, 6)) for _ in range(rng.randint(3, 8)))]
    links = lambda n: "".join(f'<li><a href="/{i}">{short(2)}</a></li>' for i in range(n))
    parts = [menu[0] + f"<ul>{links(5)}</ul>" + menu[1], head[0] + f"<p>{short(3)}</p>" + head[1]]
    body = article[0] + f"<h1>{main[0]}</h1>" + "".join(f"<p>{p}" + ("</p>" if rng.random() < 0.7 else "") for p in main[1:]) + article[1]
    rail = side[0] + f"<h4>{short(2)}</h4><ul>{links(4)}</ul>" + side[1]
    parts += [body, rail] if rng.random() < 0.6 else [rail, body]
    if rng.random() < 0.7:
        parts.append(comments[0] + f"<h3>{rng.randint(2, 9)} replies</h3>" + "".join(f"<div><b>{short(1)}</b><div>{rng.randint(1, 9)} days ago</div><p>{prose(rng, 1)}</p></div>" for _ in range(rng.randint(2, 5))) + comments[1])
    parts.append(foot[0] + f'<p>&copy; 2020 {short(2)}</p><a href="/p">{short(1)}</a>' + foot[1])
    return f"<html><head><title>t</title></head><body>{''.join(parts)}</body></html>", " ".join(main)


def test_unknown_layouts():
    """48 layouts: word precision and recall of 0.95, over all of them."""
    from bazaarlake.llm.html_main import _standard_field, block_features, must_hold, page_blocks

    field, found, right, wanted = _standard_field(), 0, 0, 0
    worst = []
    for seed in range(48):
        page, main = layout(seed)
        blocks = page_blocks(page)
        text = " ".join(b[2] for b, y in zip(blocks, field.decode(block_features(blocks), must_hold(blocks)), strict=True) if y)
        assert text
        a, b = text.split(), main.split()
        hits = sum(min(a.count(w), b.count(w)) for w in set(a))
        found, right, wanted = found + len(a), right + hits, wanted + len(b)
        worst.append((round(hits / len(a), 2), round(hits / len(b), 2), seed % len(NAMES)))
    assert right / found >= 0.95 and right / wanted >= 0.95, (right / found, right / wanted, sorted(worst)[:12])


@pytest.mark.parametrize("page", ["A plain text " + "of many words without any tag at all, " * 5, "<div class=q><div class=r>" + "Only unknown names stand around this long text. " * 6 + "</div></div>"])
def test_long_text_is_never_lost(spark, page):
    from bazaarlake.llm.html_main import extract_main_text

    rows = spark.createDataFrame([(1, "u", page), (2, "u", "<p>short</p>"), (3, "u", None)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extract_main_text(rows).collect()}
    assert len(found[1].split()) >= 30 and found[3] == ""


def test_forced_labels_are_the_best_of_all():
    """decode(): against all labellings that have a 1 at one of the places."""
    import itertools

    import numpy as np

    from bazaarlake.llm.html_main import Field

    rng = np.random.default_rng(3)
    for _ in range(20):
        field = Field({str(i): i for i in range(6)}, np.stack([rng.uniform(3, 6, 6), rng.uniform(-3, 0, 6)], 1), rng.normal(0, 1, (2, 2)))
        features = [[str(i)] for i in range(6)]
        places = sorted(rng.choice(6, 2, replace=False).tolist())
        score = lambda y: sum(field.emit[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        free = max(itertools.product((0, 1), repeat=6), key=score)
        want = free if any(free) else max((y for y in itertools.product((0, 1), repeat=6) if any(y[i] for i in places)), key=score)
        assert field.decode(features, places) == list(want)
