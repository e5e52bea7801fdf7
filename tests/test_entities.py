"""Names of several words: counts and tags against a plain version."""

import re
from collections import Counter

from docweave.operators import entities as EN
from docweave.registry import all_queries


def _texts():
    base = ["We saw New York and Old Town today.", "In New York City the Red Cross met Anna Maria Lopez.", "New York City is large, York is not.",
            "The Red Cross helps. Red wine, Cross words.", "Anna Maria Lopez left New York. City life goes on.", "Old York New  York", "Anna Lopez and Maria Cross",
            "A B C D E F of X", "Éva Kovács rang Éva Kovács Bt twice", None, "", "no capitals here"]
    return base * 3 + ["Alpha Beta Alpha Beta Alpha"] * 4 + ["Alpha only", "Some Thing", "The The The The The"]


def plain_names(texts, least=3, ratio=4.0):
    count = Counter()
    for t in texts:
        for p in re.findall(r"[^\W_]+(?: [^\W_]+)*", t or ""):
            w = p.split(" ")
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    if all(x[0].isupper() for x in w[i:i + k]):
                        count[tuple(w[i:i + k])] += 1
    total = sum(n for g, n in count.items() if len(g) == 1)
    lift = {g: n * total / (count[g[:1]] * count[g[1:]]) for g, n in count.items() if len(g) == 2}
    return {" ".join(g): n for g, n in count.items() if len(g) > 1 and n >= least and all(lift[g[i:i + 2]] >= ratio for i in range(len(g) - 1))}


def plain_tags(text, names):
    toks = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
    out, i = [], 0
    while i < len(toks):
        for k in (4, 3, 2):
            part = toks[i:i + k]
            glued = len(part) == k and all(text[a[2]:b[1]] == " " for a, b in zip(part, part[1:]))
            if glued and " ".join(x[0] for x in part) in names:
                out.append(" ".join(x[0] for x in part))
                i += k
                break
        else:
            if toks[i][0][0].isupper() and len(toks[i][0]) >= 2:
                out.append(toks[i][0])
            i += 1
    return out


def test_names_and_tags_equal_a_plain_version(spark):
    texts = _texts()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, t string").repartition(4)
    names = EN.multiword_names(df)
    want = plain_names(texts)
    assert {r["name"]: r["n"] for r in names.collect()} == want
    assert {"New York City", "Anna Maria Lopez", "Red Cross", "Éva Kovács"} <= want.keys()
    got = {r["doc_id"]: r["entities"] for r in EN.tagged(df, names).collect()}
    assert got == {k: plain_tags(t, want) for k, t in enumerate(texts)}
    edges = {tuple(r) for r in EN.entity_edges(EN.tagged(df, names)).collect()}
    assert edges == {tuple(sorted(p)) for e in got.values() for p in zip(e, e[1:])}
    assert ("Anna Maria Lopez", "Red Cross") in edges
    assert EN.tagged(df.limit(0), names).count() == 0 and EN.multiword_names(df.limit(0)).count() == 0


def test_registered(spark, sf):
    assert all_queries()["named_entity_graph"](spark, sf).filter("src is null or dst is null").count() == 0


def test_runs_hold_the_capitalised_words(spark):
    texts = ["New York City is Big", "aNew York", "A  B C", "X-Ray Élan Vital", "3M Co 4U", "", None, "The_End Of It", "One Two\nThree"]
    got = {r["t"]: r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", EN.runs("t").alias("r")).collect()}
    assert got == {"New York City is Big": ["New York City", "Big"], "aNew York": ["York"], "A  B C": ["A", "B C"], "X-Ray Élan Vital": ["X", "Ray Élan Vital"],
                   "3M Co 4U": ["Co"], "": [], None: [], "The_End Of It": ["The", "End Of It"], "One Two\nThree": ["One Two", "Three"]}
