"""Many rules: equal to a look-up of all beginnings, and few copies of the rules."""

import random

from pyspark.sql import functions as F


def test_many_rules(spark):
    from bazaarlake.llm import url_rules as U

    draw = random.Random(3)
    hosts = [f"{a}.h{b}.org" if a else f"h{b}.org" for b in range(2000) for a in ("", "www", "m")] + ["org"]
    paths = ["/", "/a", "/a/b", "/b/", "/x/y/z"]
    rules = {(draw.choice(hosts), draw.choice(paths)): draw.choice(("allow", "block")) for _ in range(20_000)}
    urls = [f"http://{draw.choice(('', 'x.', 'www.'))}{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(('', 'b', '/q?z'))}" for _ in range(2000)]
    urls += ["http://m.h7.org/a/b/c"] * 1000 + [None, "h7.org/a", "http://", "http://m.h7.org"]  # a third is one url
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = U.rule_table(spark, [(v, h, p) for (h, p), v in rules.items()])

    def judge(url):
        if url is None or "://" not in url:
            return None, "allow"
        host, slash, path = url.split("://", 1)[1].partition("/")
        labels, path = host.lower().split("."), (slash + path).split("?")[0]
        fits = [(h, path[:n]) for i in range(len(labels)) for h in [".".join(labels[i:])] for n in range(len(path) + 1) if (h, path[:n]) in rules]
        if not fits:
            return None, "allow"
        h, p = min(fits, key=lambda x: (-len(x[0] + x[1]), -len(x[0]), x[0] + x[1]))
        return h + p, rules[h, p]

    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_urls(pages, table).collect()}
    assert got == {i: judge(url) for i, url in enumerate(urls)}

    # the host sweep's starts in 64 blocks: one copy each, and a range's for each further block
    keyed = table.select(U.host_key(F.col("host")).alias("key"), F.col("path")).distinct()
    cuts, _ = U._cuts(keyed)
    ends = [c["key"] for c in cuts.first()["cuts"]]
    keys = sorted(r["key"] for r in keyed.select("key").distinct().collect())
    widest = max(sum(sum(e <= k for e in ends) == n for k in keys) for n in range(len(ends) + 1))
    rows = pages.select(U.host_key(U.host_and_path(F.col("url"))[0]).alias("key"), F.xxhash64("page_id").alias("deal"))
    _, copied = U._blocks(rows, keyed.select("key").distinct(), cuts, 64, "key")
    assert len(ends) > 2 and copied.count() <= len(keys) + 64 * widest < 64 * len(keys) / 1.5
