"""Operators of the llm subpackage against brute force on small fixtures, with odd rows in each."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, id string, n int, h long"


def words(text, pattern=SPACED):
    return pattern.findall((text or "").encode().translate(LOWER))


def made_up(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Odd texts, copies, near copies, a family of near copies, a passage that many share."""
    rng = random.Random(5)
    out = [None, "", " \t\n", "One", "one", "two words", "a b c", "É a É", "é a é", "x" * 5000 + " y"]
    base = [made_up(rng, 120) for _ in range(20)]
    out += base + [t.upper() for t in base[:5]] + [base[0]] * 40
    for t in base[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    family = made_up(rng, 200).split()
    for i in range(60):
        w = list(family)
        for j in rng.sample(range(200), 3):
            w[j] = f"edit{i % 7}"
        out.append(" ".join(w))
    passage = made_up(rng, 60)
    out += [f"{made_up(rng, 25, 5000)} {passage} {made_up(rng, 25, 5000)}" for _ in range(50)]
    out.append(made_up(rng, 30000, 9000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("a", "b", None, "ä")[i % 4], "clash", i, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(texts, width):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_jaccard(docs, texts, empty, width, percent):
    from bazaarlake.llm.ngram_jaccard import ngram_jaccard_join

    sets = shingle_sets(texts, width)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in ngram_jaccard_join(docs, width=width, percent=percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in range(len(sets))}
    if width == 4:
        assert ngram_jaccard_join(empty).count() == 0


def test_ngram_jaccard_odd_rows(spark):
    """Repeated rows, null ids, and shingles wider than the usual ones."""
    from bazaarlake.llm.ngram_jaccard import ngram_jaccard_join

    text = made_up(random.Random(4), 50)
    rows = [(5, text), (5, text), (2, text + " more"), (None, text), (None, "no copy of this text is there"), (9, "else"), (None, None)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=7, percent=90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(5, 44, 2), (5, 44, 2), (2, 45, 2), (None, 44, 2), (None, 1, None), (9, 1, 9), (None, 0, None)], key=str)


def test_ngram_jaccard_emits_few_counts(spark):
    """A shared passage and a family of near copies give partial counts in proportion to the documents."""
    from bazaarlake.llm import ngram_jaccard as J

    rng = random.Random(6)
    passage, family = made_up(rng, 40), made_up(rng, 150).split()

    def counts(n: int) -> int:
        texts = [f"{made_up(rng, 80, 9000)} {passage}" for _ in range(n)]
        for i in range(n):
            w = list(family)
            w[rng.randrange(150)] = f"edit{i}"
            texts.append(" ".join(w))
        frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        packed = frame.mapInArrow(J._sets(5), "id long, n long, k1 long, k2 long, low binary").select("id", "n", "low").mapInArrow(J._pack(4), "block int, rows binary, frequent binary")
        return packed.groupBy("block").applyInPandas(J._multiply(80), "a long, b long, shared long").count()

    assert counts(200) <= 200 and counts(1000) <= 1000


def test_exact_dedup(docs, texts, empty):
    from bazaarlake.llm.exact_dedup import exact_dedup

    norm = [(t or "").encode().translate(LOWER) for t in texts]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    for keep, best in (("max", max), ("min", min)):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs, keep=keep).collect()}
        assert got == {i: (best(groups[t]), len(groups[t]), best(groups[t]) == i, hashlib.sha256(t).hexdigest()) for i, t in enumerate(norm)}
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_of_one_group(spark):
    """All rows are equal, and rows without an id."""
    from bazaarlake.llm.exact_dedup import exact_dedup

    rows = spark.createDataFrame([(i if i % 10 else None, "Same") for i in range(1000)], "doc_id long, text string").repartition(7)
    got = exact_dedup(rows, keep="max").collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(999, 1000)} and [r["doc_id"] for r in got if r["kept"]] == [999]


def test_toxicity(spark):
    from bazaarlake.llm.toxicity import drop_toxic, toxicity_scores

    rng = random.Random(2)
    rows, labels = [(9000, None), (9001, ""), (None, "fine text")], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, made_up(rng, 40) + (" idiot moron trash" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*labels, (9000, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(600) if got[i]["held_out"]] == held
    assert sum(got[i]["predicted"] == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 520
    assert toxicity_scores(docs, labels, score=docs.limit(0)).count() == 0
    none = toxicity_scores(docs, labels.limit(0))
    assert none.agg(F.max("score")).first()[0] < 0.3
    few = toxicity_scores(docs, labels.filter("doc_id in (0, 6, 12) or toxic = 0"))
    assert few.select("score").distinct().count() == 1
    clash = drop_toxic(docs.withColumns({"_score": F.lit(1), "_score0": F.lit("x")}), labels)
    assert clash.columns == ["doc_id", "text", "score", "_score", "_score0"] and clash.count() == kept.count()
    long = docs.sparkSession.createDataFrame([(1, "word " * 300_000 + "idiot"), (1, "idiot " * 5), (1, "idiot " * 5)], "doc_id long, text string")
    assert toxicity_scores(docs, labels, score=long).count() == 3


def test_nnpu_risk():
    """The risk against a direct sum, its slope and the classifier's gradient against finite differences, and the fit against held-out labels."""
    import numpy as np

    from bazaarlake.llm.toxicity import fit_nnpu, nnpu_risk

    rng = np.random.default_rng(4)
    positive = np.arange(30) < 10
    for shift, prior in ((0.0, 0.2), (3.0, 0.2), (-4.0, 0.6)):
        g = rng.normal(size=30) + shift * np.where(positive, 1, -1)
        loss = lambda z: math.log(1 + math.exp(-z))
        p, u = g[positive], g[~positive]
        rest = sum(loss(-z) for z in u) / 20 - prior * sum(loss(-z) for z in p) / 10
        risk, slope = nnpu_risk(g, positive, prior)
        assert math.isclose(risk, prior * sum(loss(z) for z in p) / 10 + max(0.0, rest), rel_tol=1e-12)
        for i in (0, 7, 15, 29):
            up = g.copy()
            up[i] += 1e-6
            whole = lambda g: nnpu_risk(g, positive, prior)[0]
            if rest >= 0:
                assert math.isclose((whole(up) - risk) / 1e-6, slope[i], rel_tol=1e-4, abs_tol=1e-6)
            else:  # up the slope of the negative part
                part = lambda g: np.logaddexp(0, g[~positive]).sum() / 20 - prior * np.logaddexp(0, g[positive]).sum() / 10
                assert math.isclose(-(part(up) - part(g)) / 1e-6, slope[i], rel_tol=1e-4, abs_tol=1e-6)
    # two kinds of text, one in five of the unlabelled is of the kind of the positives
    kind = np.concatenate([np.ones(200, bool), rng.random(1000) < 0.2])
    features = [np.flatnonzero(rng.random(20) < np.where(np.arange(20) < 10, 0.5 if k else 0.05, 0.3)) for k in kind]
    w, constant = fit_nnpu(features, np.arange(1200) < 200, 20, 0.2)
    score = np.array([constant + w[f].sum() for f in features])[200:]
    assert ((score > 0) == kind[200:]).mean() > 0.93


def test_main_text(spark):
    from bazaarlake.llm.html_main import extract_main_text, labelled_examples, train_field
    from bazaarlake.llm.layouts import labelled_pages

    field = train_field(labelled_examples(labelled_pages(300)))
    held_out = labelled_examples(labelled_pages(100, seed=9))
    right = sum(a == b for x, y in held_out for a, b in zip(field.viterbi(x), y, strict=True))
    assert right >= 0.98 * sum(len(y) for _, y in held_out)
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A &amp; B</h1><p>First   line<br>goes on here, with words. And more of it.</p><script>x('</p>')</script><p>Caf&eacute; &#8364; text that is long enough to be read. Indeed.</p></article>"
        "<div class='comments'><p>I liked it.</p></div><form><label>Name</label></form><footer>&copy; 2024 someone</footer></body></html>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<article><p>cut off in the middle of a sentence, as it were"), (5, "u", "<nav>x</nav>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(rows).collect()}
    main = "A & B First line goes on here, with words. And more of it. Café € text that is long enough to be read. Indeed."
    assert got[1] == (main, len(main)) and got[2] == got[3] == ("", 0)
    assert got[None][0] == "cut off in the middle of a sentence, as it were"
    assert extract_main_text(rows.limit(0)).count() == 0
    assert extract_main_text(rows.union(rows).filter("page_id = 1")).count() == 2


def test_field_against_all_labellings():
    """Viterbi, the likelihood, the marginals and the gradients against the enumeration of all label sequences."""
    import itertools

    import numpy as np

    from bazaarlake.llm.html_main import Field, _Examples

    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "d", "e"]
    pages = [([list(rng.choice(names, rng.integers(1, 4), replace=False)) for _ in range(n)], [int(x) for x in rng.integers(0, 2, n)]) for n in (1, 2, 5, 3)]
    examples = _Examples(pages)
    emit, move = rng.normal(size=(len(examples.names), 2)), rng.normal(size=(2, 2))
    field = Field(examples.names, emit, move)

    def total(features, y):
        rows = field.scores(features)
        return sum(rows[t][k] for t, k in enumerate(y)) + sum(move[i, j] for i, j in itertools.pairwise(y))

    mean, of_emit, of_move, belief = examples.likelihood(emit, move)
    want = 0.0
    for p, (features, y) in enumerate(pages):
        every = list(itertools.product((0, 1), repeat=len(y)))
        scores = np.array([total(features, z) for z in every])
        assert field.viterbi(features) == list(every[int(scores.argmax())])
        share = np.exp(scores - scores.max())
        share /= share.sum()
        for t in range(len(y)):
            assert math.isclose(belief[p, t, 1], sum(x for x, z in zip(share, every, strict=True) if z[t]), rel_tol=1e-9)
        want += total(features, y) - scores.max() - math.log(np.exp(scores - scores.max()).sum())
    assert math.isclose(mean, want / len(pages), rel_tol=1e-9)
    for grad, w, place in ((of_emit, emit, (1, 1)), (of_emit, emit, (3, 0)), (of_move, move, (0, 1)), (of_move, move, (1, 1))):
        w[place] += 1e-6
        up = examples.likelihood(emit, move)[0]
        w[place] -= 1e-6
        assert math.isclose((up - mean) / 1e-6, grad[place], rel_tol=1e-3, abs_tol=1e-5)


def test_pages_with_labels_by_hand():
    """Pages written by hand, apart from the layouts that the field is trained on."""
    from bazaarlake.llm.html_main import _standard_field, block_features, page_blocks

    page = lambda top, main, end: f"<!doctype html><html lang=en><head><meta charset=utf-8><title>x</title></head><body>{top}{main}{end}</body></html>"
    text = "The river rose through the night, and by morning the lower road was gone. Nobody in the village was surprised."
    more = "Repairs will take until autumn, the council said on Tuesday. A ferry runs twice a day until then."
    pages = [
        page("<div id=navbar><a href=/>Home</a> <a href=/news>News</a></div>", f"<main><h1>The road</h1><p>{text}</p><p>{more}</p></main>", "<div class=footer><p>Copyright 2023 The Paper. All rights reserved.</p></div>"),
        page("<header><h2>Site</h2><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav></header>", f"<div class=content><p>{text}</p><ul><li>{more}</li></ul></div>", "<aside class=sidebar><h3>Related</h3><a href=c>Other stories</a></aside>"),
        page("", f"<article><p>{text}</p><blockquote>{more}</blockquote></article>", "<section class=comments><p>First! Great story, thanks for it.</p></section>"),
    ]
    for html in pages:
        blocks = page_blocks(html)
        got = " ".join(b[2] for b, y in zip(blocks, _standard_field().viterbi(block_features(blocks)), strict=True) if y)
        assert text in got and more in got and not any(x in got for x in ("News", "Copyright", "Related", "Other stories", "First!"))


def test_deep_and_long_pages():
    import time

    from bazaarlake.llm.html_main import page_blocks

    start = time.time()
    deep = page_blocks("".join(f"<div class=c{i % 7}>x{i} " for i in range(60_000)) + "</p>" * 60_000 + "</div>" * 60_000)
    assert len(deep) == 60_000 and deep[-1][0] == "div" and deep[-1][1][:3] == ("in:div", "like:c", "name:c") and deep[-1][2] == "x59999"
    assert len(page_blocks("<p>" + "word " * 400_000)[0][2]) == 2_000_000 - 1
    assert time.time() - start < 20


@pytest.mark.parametrize("split", [1, 37, 400, 1 << 20])
def test_warc_round_trip(spark, split):
    from bazaarlake.llm.warc import warc_round_trip

    rng = random.Random(3)
    noise = "".join(chr(rng.choice((31, 139, 8, 65, 8364))) for _ in range(3000))
    html = [None, "", "short", "short", noise, noise, noise + "é", "y" * 100_000, "\r\n\r\nWARC/1.1\r\n" * 90]
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"http://ü.example/{i} x", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r for r in warc_round_trip(rows, split=max(split, 20)).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        payload = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        if i == 4:
            assert (got[i]["record_type"], got[i]["refers_to"], got[i]["payload"]) == ("revisit", 5, None)
        else:
            assert (got[i]["record_type"], got[i]["refers_to"], bytes(got[i]["payload"])) == ("response", None, payload)
    assert warc_round_trip(rows.limit(0)).count() == 0


def test_warc_clashing_ids_and_cut_archives(spark, tmp_path):
    """One id with two payloads, null ids, repeated rows; an archive that breaks off is an error."""
    import io

    from bazaarlake.llm.warc import encode, records_of_range, warc_round_trip

    a, b = "a" * 2000, "b" * 2000
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (None, a), (None, b), (2, a)], "page_id long, html string").withColumn("url", F.lit("http://x/"))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]).decode()) for r in warc_round_trip(rows).collect()]
    want = [(1, "revisit", 2, None), (1, "response", None, b), (2, "response", None, a), (2, "response", None, a), (None, "response", None, a), (None, "response", None, b)]
    assert sorted(got, key=str) == sorted(want, key=str)
    record = encode(1, "http://x/", random.Random(1).randbytes(50_000), None)
    assert len(list(records_of_range(io.BytesIO(record * 3), 0, 3 * len(record)))) == 3
    with pytest.raises(ValueError, match="cut off"):
        list(records_of_range(io.BytesIO((record * 3)[:-100]), 0, 3 * len(record)))


@pytest.mark.parametrize("starts", [1000, 1, 3])
def test_url_rules(spark, monkeypatch, starts):
    monkeypatch.setattr("bazaarlake.llm.url_rules._RANGE", starts)  # one range, one of each start, some
    from bazaarlake.llm.url_rules import RULES, judge_urls, rule_table

    rules = [*RULES, ("block", "a.example.org", ""), ("allow", "a.example.org", "/en/"), ("block", "example.org", "/en/1"), ("allow", None, "/"), ("block", "Example.net", None)]
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "https://x.Example.ORG/en/12?q#f", "http://a.example.org/en/1", "http://b.a.example.org", "http://notexample.org/es/", "http://example.org/es/x",
            "ftp://example.com/fr/", "http://fr.com/de/fr/", "http://example.net", "http://www.example.net:80/x", "http://com/fr/" + "y" * 9000, "http://exa\u0001mple.org/", "a://b://c.org/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(6, urls[6])], "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit(1)})

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.encode().translate(LOWER).decode()
        fits = []
        for verdict, h, p in rules:
            h, p = (h or "").lower(), p or ""
            if h and (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((-len(h) - len(p), -len(h), h + p, verdict != "block", verdict))
        best = min(fits, default=None)
        return host, path, best[2] if best else None, best[4] if best else "allow"

    got = judge_urls(rows, rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: judge(u) for i, u in enumerate(urls)}
    assert judge_urls(rows.limit(0), rule_table(spark)).count() == 0


def test_mixing(docs, texts, empty):
    from bazaarlake.llm.mixing import mix_sources

    got = {r["doc_id"]: r for r in mix_sources(docs).collect()}
    size = {i: len(words(t)) for i, t in enumerate(texts)}
    source = {i: ("a", "b", None, "ä")[i % 4] for i in size}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = dict(zip(["a", "b", "ä", None], [3, 1, 2, 3], strict=True))
    target, free = {}, dict(total)
    left = 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            del free[s]
    taken = collections.Counter()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]]) and 0 <= r["taken"] <= 2 * size[i]
        assert math.isclose(r["target"], target[source[i]], rel_tol=1e-9)
        taken[source[i]] += r["taken"]
    assert len(got) == len(texts) and all(abs(taken[s] - target[s]) <= (0.05 if s == "b" else 0.01) * target[s] for s in target)  # b: one text is most of it
    assert {r["doc_id"]: r["taken"] for r in mix_sources(docs.repartition(3)).collect()} == {i: r["taken"] for i, r in got.items()}
    assert mix_sources(empty).count() == 0


def test_mixing_rates(spark):
    """The tilted rates against a bisection, and against other rates that meet the target."""
    import numpy as np

    from bazaarlake.llm.mixing import mix_sources

    rng = np.random.default_rng(3)
    size = np.concatenate([rng.integers(1, 400, 300), [5000, 0, 7, 7]])
    source = ["p"] * 100 + ["q"] * 100 + ["r"] * 104
    docs = spark.createDataFrame([(i, "w " * int(n), s) for i, (n, s) in enumerate(zip(size, source, strict=True))], "doc_id long, text string, source string").withColumn("key", F.lit("clash"))
    for share in (0.4, 1.5):  # fewer words than there are, and more
        got = {r["doc_id"]: r for r in mix_sources(docs, share=share).collect()}
        for name in "pqr":
            ids = [i for i, s in enumerate(source) if s == name]
            x, target = size[ids].astype(float), got[ids[0]]["target"]
            rate = np.array([got[i]["rate"] for i in ids])
            if target < 2 * x.sum() * (1 - 1e-9):
                low, high = -1e3, 1e3
                for _ in range(200):
                    t = (low + high) / 2
                    r = np.minimum(2, np.exp(np.minimum(t * x / x.mean(), 5)))
                    low, high = (t, high) if (r * x).sum() < target else (low, t)
                assert np.allclose(rate[x > 0], r[x > 0], rtol=1e-7, atol=1e-8) and len(set(rate[x > 0])) > 10
                entropy = lambda r: (r * np.log(r) - r + 1).sum()
                flat = np.full(len(x), target / x.sum())
                assert entropy(r[x > 0]) <= entropy(flat[x > 0]) + 1e-9
            else:
                assert (rate[x > 0] == 2).all()
            assert abs(sum(got[i]["taken"] for i in ids) - target) <= 0.02 * target + 5


def test_decontaminate(spark, docs, texts, empty):
    from bazaarlake.llm import decontaminate as D

    rng = random.Random(8)
    long = texts[-1].split()
    items = [(1, " ".join(long[100:140])), (2, texts[12].title()), (3, made_up(rng, 30, 10**6)), (4, "É a!"), (5, None), (6, ""), (20, "two, WORDS."), (None, texts[13]), (2, texts[12])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        for j in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    sizes = {len(w) for w in windows}

    def expected(t):
        w, hit, found = words(t, ALNUM), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = {i: expected(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in D.decontaminate(docs, benchmark).collect()} == want
    whole, D.BLOCK_WINDOWS = D.BLOCK_WINDOWS, 7  # several blocks of windows
    try:
        assert {r["doc_id"]: tuple(r[c] for c in columns) for r in D.decontaminate(docs, benchmark).collect()} == want
    finally:
        D.BLOCK_WINDOWS = whole
    odd = spark.createDataFrame([(None, texts[12]), (None, "none"), (3, texts[12]), (3, texts[13]), (3, texts[12])], "doc_id long, text string")
    for D.BLOCK_WINDOWS in (whole, 3):  # rows with null and repeated ids, whatever the number of blocks
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in D.decontaminate(odd, benchmark).collect())
        assert got == [("3", 120, 0), ("3", 120, 120), ("3", 120, 120), ("None", 1, 0), ("None", 120, 120)]
    D.BLOCK_WINDOWS = whole
    near = {r["doc_id"] for r in D.decontaminate(spark.createDataFrame([(1, "x d z c b a y"), (2, "a b c"), (3, "a q q q b q q q c q d")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), width=4, slop=1).filter("contaminated").collect()}
    assert near == {1}
    assert D.decontaminate(empty, benchmark).count() == 0 and not D.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count()


def test_lm_scores(docs, texts, empty):
    from bazaarlake.llm.common import fold
    from bazaarlake.llm.lm_score import Lattice, lm_scores, load_vocabulary

    flagged = docs.withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
    got = {r["doc_id"]: r for r in lm_scores(flagged, "held_out").collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, floor = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10(c[w] + 0.1) - floor for w in ws), rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert lm_scores(empty).count() == 0
    # the recursion against the sum over all segmentations
    import numpy as np

    pieces, spare, weight = load_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    lattice = Lattice(pieces, spare, np.log(weight))
    known = collections.defaultdict(float)
    for p, w in zip(pieces, weight, strict=True):
        if p:
            known[p] += w
    for b in range(256):
        known[bytes([b])] += weight[spare[b]]

    def total_of(word):
        return 1.0 if not word else sum(known[word[:n]] * total_of(word[n:]) for n in range(1, len(word) + 1) if word[:n] in known)

    for word in ("▁the".encode(), "▁then".encode(), b"\xff\xfea", "▁日é".encode()):
        assert math.isclose(float(lattice.forward(np.frombuffer(word, np.uint8)[None])[0]), math.log(total_of(word)), rel_tol=1e-9)
    # the scores themselves: nothing is learnt, so the vocabulary's own weights hold, and each word and the end have a half
    some = [("the then", 1), ("É the", 2), (None, 3)]
    rows = docs.sparkSession.createDataFrame(some, "text string, doc_id long").withColumns({"unseen": F.lit(True), "score": F.lit("clash")})
    for r in lm_scores(rows, "unseen").collect():
        ws = words(some[r["doc_id"] - 1][0])
        want = sum(math.log10(total_of("▁".encode() + w) / 2) for w in ws) + math.log10(0.5)
        assert math.isclose(r["score"], want, rel_tol=1e-9), r


def test_lattice_paths():
    """Many words at once and word by word, forward and expected uses; expected uses against finite differences; a very long word."""
    import time

    import numpy as np

    from bazaarlake.llm import lm_score as L

    rng = np.random.default_rng(5)
    pieces = [b"a", b"ab", b"b", b"ba", b"abab", b"c" * 40, *[b""] * 256]
    weight = rng.uniform(0.5, 1.0, len(pieces))
    log_p = np.log(weight / weight.sum())
    lattice = L.Lattice(pieces, np.arange(6, 262), log_p)
    words = rng.integers(97, 100, (200, 45)).astype(np.uint8)
    words[0] = 99
    counts = rng.uniform(0, 3, 200)
    one_by_one = np.array([lattice.word_alpha(w)[-1] for w in words])
    assert np.allclose(lattice.forward(words), one_by_one, rtol=1e-12)
    uses = sum(lattice.expected(words[i : i + 20], counts[i : i + 20]) for i in range(0, 200, 20))
    assert np.allclose(lattice.expected(words, counts), uses, rtol=1e-9, atol=1e-12)
    for piece in (0, 3, 4, 5, 6 + 97):
        up = log_p.copy()
        up[piece] += 1e-6
        slope = ((L.Lattice(pieces, np.arange(6, 262), up).forward(words) - lattice.forward(words)) * counts).sum() / 1e-6
        assert math.isclose(slope, uses[piece], rel_tol=1e-4, abs_tol=1e-4)
    long = rng.integers(97, 99, 200_000).astype(np.uint8)
    start = time.time()
    assert math.isfinite(lattice.forward(long[None])[0]) and time.time() - start < 20


def test_license_scan(spark, empty):
    import textwrap

    from bazaarlake.llm.license_scan import PHRASES, TEMPLATES, least_overlap, license_scan, template_words

    rng = random.Random(12)
    texts = [None, "", "MIT License mit\tlicense", "the MIT-License!", "mit licenses", "cc  BY 4.0\nReleased under the mit license.", "gnu general public license gnu general public license", "apache\nlicense",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.", "Mozilla public", "É mit license É " + "x " * 3000, "licensed under CC BY-NC 4.0",
             "released " + "a b c d " * 9 + "under " + "e f g h " * 9 + "the mit " + "i j k l " * 9 + "license", "the of and to " * 700 + TEMPLATES[16][0] + " the of and to" * 700, "license license " * 2000]
    for text, _ in TEMPLATES:  # wrapped, with words left out, replaced and put in
        w = text.split()
        texts.append("some words before\n" + "\n".join(textwrap.wrap(" ".join(w), 60)) + "\nand some after")
        texts += [" ".join(x for x in w if rng.random() > share) for share in (0.05, 0.15)]
        texts.append(" ".join(x if rng.random() > 0.3 else f"{x} {rng.choice(['the', 'of', 'software', 'zzz'])}" for x in w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"id": F.lit("clash"), "norm": F.lit("clash"), "row": F.lit(1)})
    got = license_scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        w, places, labels = words(t, ALNUM), [], set()
        for phrase, label in PHRASES:
            p = phrase.encode().split()
            mine = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += mine
            labels |= {label} if mine else set()
        more, best = set(), 0.0
        for template, label in TEMPLATES:
            want, width = {x.encode() for x in template_words(template)}, 2 * len(template_words(template))
            spots = [i for i, x in enumerate(w) if x in want]
            shared = max((len({w[j] for j in spots if i <= j < i + width}) for i in spots), default=0) if len(want & set(w)) >= least_overlap(template, 0.9) else 0
            if shared >= least_overlap(template, 0.9):
                more.add(label)
                best = max(best, shared / len(want))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None)), t
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(labels)), ",".join(sorted(labels | more))), t
        assert math.isclose(r["score"], 1.0 if places else best)
    assert license_scan(empty).count() == 0
    odd = spark.createDataFrame([(None, TEMPLATES[2][0]), (None, "none"), (1, TEMPLATES[11][0]), (1, TEMPLATES[2][0])], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["labels"]) for r in license_scan(odd).collect()) == [("1", "bsd"), ("1", "mpl"), ("None", ""), ("None", "bsd")]


def test_components(spark):
    from bazaarlake.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (300, 300), (7, 500)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 500: 0, 100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_against_sql(spark):
    """Each opN_ query with SQL against it, over the smallest tables."""
    import os

    duckdb = pytest.importorskip("duckdb")
    from bazaarlake.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")

    def plain(value):
        return float(f"{value:.9g}") if isinstance(value, (int, float)) and not isinstance(value, bool) else value

    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in result.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want, name
