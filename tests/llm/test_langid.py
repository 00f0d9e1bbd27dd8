import math
from collections import Counter

import numpy as np

from codexferry.llm import langid, queries

SF = "/root/testdata/sf0.01"


def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def brute(rows, m):
    """The fusion with dictionaries, page by page."""
    n, out, pages = len(m.languages), [], []
    for _, url, page in rows:
        host, domain, suffix = langid.address(url)
        found = langid._LANG.search(page or "")
        text = m.evidence(langid.visible(page or ""))
        q = np.exp(text - text.max())
        pages.append({"host": host, "domain": domain, "suffix": suffix, "declared": found.group(1).lower() if found else None, "text": text, "q": q / q.sum()})
    sums = {by: Counter() for by in ("host", "domain", "suffix", "declared")}
    for p in pages:
        for by, c in sums.items():
            if p[by] is not None:
                c[p[by]] = c[p[by]] + p["q"]
    everything = sum(p["q"] for p in pages)
    for p in pages:
        own = {by: np.maximum(c[p[by]] - p["q"], 0) if p[by] is not None else None for by, c in sums.items()}
        total = np.maximum(everything - p["q"], 0)
        prior = (total + langid.SMOOTH) / (total.sum() + langid.SMOOTH * n)
        for by, weight in (("domain", langid.DOMAIN), ("host", langid.HOST)):
            if own[by] is not None:
                prior = (own[by] + weight * prior) / (own[by].sum() + weight)
        logs = p["text"] + np.log(prior)
        for by in ("declared", "suffix"):
            if own[by] is not None:
                share = (own[by].sum() + langid.SMOOTH) / (total.sum() + 2 * langid.SMOOTH)
                logs = logs + np.log((own[by] + langid.SMOOTH * share) / (total + langid.SMOOTH))
        post = np.exp(logs - logs.max())
        post /= post.sum()
        out.append((m.languages[int(post.argmax())], float(post.max())))
    return out


def test_matches_brute_force_and_odd_rows(spark):
    m = model(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").limit(80).collect()]
    rows += [(None, None, None), (900, "", ""), (901, "no address", "<html LANG=FR><p>"), (902, "http://u@A.B.example.com.:80/x", "<script>" + "x" * 300_000), rows[0], rows[0], (903, "http://localhost/", "<p>zzz")]
    df = spark.createDataFrame([(*r, "x", [1.0]) for r in rows], "page_id long, url string, html string, host string, text array<double>")
    found = langid.identify(df, m).collect()
    wanted = brute(rows, m)
    key = lambda d: (str(d[0]), d[1])
    assert sorted(((r["page_id"], r["lang"]) for r in found), key=key) == sorted(((r[0], w[0]) for r, w in zip(rows, wanted)), key=key)
    a, b = sorted(r["confidence"] for r in found), sorted(w[1] for w in wanted)
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a, b))


def test_held_out_accuracy_of_text_and_gain_of_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars > 100")
    m = langid.fit(docs.where("doc_id % 5 != 0"))
    held = docs.where("doc_id % 5 = 0").limit(800).collect()
    guess = [m.languages[int(m.evidence(r["text"]).argmax())] for r in held]
    text = sum(g == r["lang"] for g, r in zip(guess, held)) / len(held)
    assert text > 0.9
    found = queries.op3_fused_language(spark, SF).collect()
    own = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    right = [(r["lang"] == own[r["page_id"]].split("/")[3], r["text_lang"] == own[r["page_id"]].split("/")[3]) for r in found]
    fused, alone = (sum(x) / len(right) for x in zip(*right))
    assert fused > 0.95 and fused >= alone


def test_no_labels_and_no_pages(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    assert langid.identify(pages.limit(0), model(spark)).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert [r["lang"] for r in langid.identify(pages.limit(2), nothing).collect()] == [None, None]


def test_a_rare_language_keeps_its_model(spark):
    rows = [(i, f"the quick word {i} of many", "en") for i in range(3000)] + [(9000 + i, f"żółw ćma {i} śpi", "pl") for i in range(3)] + [(None, None, "xx"), (1, "lone", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, sample=50)
    assert m.languages == ["en", "pl"]
    assert m.evidence("ćma śpi")[1] > m.evidence("ćma śpi")[0]
