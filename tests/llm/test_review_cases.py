"""Cases of the review: corpus operators."""


def test_license_over_line_ends(spark):
    """Notices in the line breaks they are published with; words scattered over a long line are none."""
    from bazaarlake.llm.license_scan import license_scan

    texts = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
        "mpl": "x\n" * 300 + "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "": "released " + "a b c d " * 9 + "under " + "e f g h " * 9 + "the mit " + "i j k l " * 9 + "license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()} == {label: label for label in texts}


def test_open_head_and_math():
    from bazaarlake.llm.html_main import page_blocks

    texts = lambda html: [text for _, _, text, _ in page_blocks(html)]
    assert texts("<html><head><title>t</title><meta charset=utf-8><body><p>one<p>two") == ["one", "two"]
    assert texts("<html><head><title>t</title><script>x</script><p>one</p>two") == ["one", "two"]
    assert texts("<head><noscript><img src=a>no</noscript><style>s</style></head><body>one") == ["one"]
    assert texts("<p>so <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds</p>") == ["so x=2 holds"]


def test_ids_with_several_texts_keep_their_links(spark):
    """Rows of one id are linked with each other, and with what each of their texts is linked with."""
    from bazaarlake.llm.ngram_jaccard import ngram_jaccard_join

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda text: text.replace(text.split()[0], "new", 1)
    rows = [(5, a), (5, b), (2, near(b)), (3, near(a)), (9, c), (8, near(c)), (7, c), (None, a), (5, a), (11, "x"), (11, None), (12, b), (13, "y"), (13, "z")]
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted(
        [(5, 56, 2)] * 3 + [(2, 56, 2), (3, 56, 2), (12, 56, 2), (9, 56, 7), (8, 56, 7), (7, 56, 7), (11, 1, 11), (11, 0, 11), (13, 1, 13), (13, 1, 13)]
    )
    assert [(r["component_id"], r["class_id"]) for r in found if r["doc_id"] is None] == [(2, 5)]


def test_comparisons_follow_the_links(spark, monkeypatch):
    """A family of texts with three variable words: pairs that are compared grow as the true pairs do, not as all pairs."""
    import random

    from bazaarlake.llm import ngram_jaccard as J

    compared = []
    plain = J._Texts.compare
    monkeypatch.setattr(J._Texts, "compare", lambda self, pairs: (compared.append(pairs.count()), plain(self, pairs))[1])
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    seen = {}
    for n in (400, 1600):
        texts = []
        for _ in range(n):
            w = list(base)
            for at in (10, 30, 50):
                w[at] = f"v{rng.randrange(60)}"
            texts.append(" ".join(w))
        compared.clear()
        found = J.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=4, percent=85).collect()
        keys = [tuple(t.split()[at] for at in (10, 30, 50)) for t in texts]
        linked = {}
        for i, k in enumerate(keys):  # two equal words of three: 8 of 57 shingles differ
            for hole in range(3):
                linked.setdefault((hole, *(x for j, x in enumerate(k) if j != hole)), []).append(i)
        pairs = {(x, y) for group in linked.values() for x in group for y in group if x < y}
        component = list(range(n))
        changed = True
        while changed:
            changed = False
            for x, y in pairs:
                low = min(component[x], component[y])
                if component[x] != low or component[y] != low:
                    component[x] = component[y] = low
                    changed = True
        assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(component))
        seen[n] = (sum(compared), len(pairs))
    assert all(c <= 6 * n + 2 * pairs for n, (c, pairs) in seen.items()), seen


def test_archives_cut_at_a_border(spark, tmp_path):
    """An archive that ends early, wherever, or lacks records, and bytes between records that are none, are errors."""
    import io
    import os

    import pytest
    from pyspark.sql import functions as F

    from bazaarlake.llm.warc import all_records, encode, read_warc, records_of_range, write_warc

    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 50 * i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = "file://" + str(tmp_path / "warc")
    archives = write_warc(pages, folder)
    assert all_records(read_warc(archives, folder, 300), archives).count() == 20
    with pytest.raises(Exception, match="were written"):
        all_records(read_warc(archives, folder), archives.withColumn("records", F.col("records") + 1))
    path = archives.first()["path"]
    last = len(encode(19, "http://a/19", b"x" * 950, None))
    os.truncate(path, os.path.getsize(path) - last)
    with pytest.raises(Exception, match="were written"):
        read_warc(archives, folder).collect()
    record = encode(1, "u", b"payload", None)
    for damaged in (record + b"junk" + record, record + b"\x1f", record + b"\x00" * 100 + record):
        with pytest.raises(ValueError):
            list(records_of_range(io.BytesIO(damaged), 0, len(damaged)))
