"""The filter audit against running the filters one after another over each part."""

import random
from collections import defaultdict
from itertools import permutations

from brute import ROWS, words

from runforge.llm import filter_audit as fa

SF001 = "/root/testdata/sf0.001"
EXTRA = [(30, "Same words here. " * 20), (31, "Same words here. " * 20), (31, "Same words here. " * 20), (32, "A|b " * 60), (33, "ALL LOUD " + "quiet " * 60)]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, None), (6, 0, 1), (7, 1, 1), (8, None, 1), (30, 1, 0), (31, 1, 1), (None, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    """{(part, order, step): counts} by applying the filters in turn."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails, parts = [], defaultdict(list)
    for k, (i, t, part) in enumerate(rows):
        t = t or ""
        w = words(t)
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if set(t) & set("#$%&*|") else set()
        f |= {"E"} if i is not None and least[t] < i else set()
        fails.append(f)
        parts[part or ""].append(k)
    out = {}
    for part, own in parts.items():
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [k for k in left if x in fails[k]]
                left = [k for k in left if x not in fails[k]]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in fails[k] for k in own) - len(gone),
                                          sum(fails[k] == {x} for k in own), sum(rows[k][0] in good for k in gone),
                                          sum(rows[k][0] in toxic for k in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]] if isinstance(v[-1], str) else v[-1]
    return out


def check(spark, docs, labels, **options):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    posted = fa.postings(docs, labels, **options)
    got = {tuple(r)[:3]: list(r)[3:] for r in fa.audit(posted).collect()}
    assert got == plain(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    return posted


def test_odd_rows(spark):
    rows = [(i, t, (None, "", "a", "b")[k % 4]) for k, (i, t) in enumerate(ROWS + EXTRA)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 as id", "'p' as part", "2 as row", "3 as fails", "true as good", "'d' as digest").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 as id", "2 as good")
    posted = check(spark, docs, labels, range_rows=3)
    runs = posted.collect()
    assert sum(len(r.ids) for r in runs) == len(rows) and max(len(r.ids) for r in runs) <= 3
    for r in runs:
        assert [i for i in r.ids if i is not None] == sorted(i for i in r.ids if i is not None)
        assert all(list(r[x]) == sorted(r[x]) for x in fa.LISTS)
    check(spark, docs, labels.limit(0))
    assert fa.audit(fa.postings(docs.limit(0), labels)).count() == 0


def test_small_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check(spark, docs, spark.read.parquet(f"{SF001}/labels.parquet"), range_rows=7)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), (None, "x", "s")], "doc_id string, text string, source string")
    check(spark, docs, spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int"))


def test_merges():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            lists.append(list(range(100, 400)))
        union = sorted(set().union(*lists))
        assert fa.merged(lists) == union
        some = sorted(rng.sample(range(60), 20))
        assert fa.outside(some, union) == len(set(some) - set(union))
