import random
import re

from codexferry.llm import decontam


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            t = words(item)
            n = min(len(t), decontam.WINDOW)
            if not n:
                continue
            for shift in range(-len(t), len(w) + 1):
                same = [int(0 <= k + shift < len(w) and w[k + shift] == t[k]) for k in range(len(t))]
                best = max(sum(same[j : j + n]) for j in range(len(t) - n + 1))
                if best >= n - decontam.tolerance(n):
                    found[d, i] = max(best, found.get((d, i), 0))
    return found


def cases():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdef", k=2)) for _ in range(24)]
    items = [(i, " ".join(draw.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 7, 8, 9, 12, 13, 14, 30, 40, 40])]
    items += [(20, None), (21, ""), (22, items[9][1]), (None, items[8][1])]
    docs = []
    for d in range(60):
        _, text = draw.choice(items[3:11])
        part = words(text)
        for _ in range(draw.choice([0, 1, 2, 2, 3, 4])):
            part[draw.randrange(len(part))] = "zz"
        if draw.random() < 0.3 and len(part) > 20:
            part = part[draw.randrange(10) :][: draw.choice([12, 13, 18])]
        docs.append((d, " \n".join(draw.choices(vocabulary, k=draw.randrange(30)) + part + draw.choices(vocabulary, k=draw.randrange(30))).upper()))
    return docs + [(100, None), (101, ""), (102, " \t"), (None, items[10][1]), docs[0], (0, items[9][1])], items


def run(spark, docs, items):
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item string, at int")
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return left, decontam.leaks(left, right)


def test_masks_survive_two_of_thirteen():
    assert decontam.tolerance(13) == 2 and decontam.tolerance(8) == 0


def test_matches_brute_force(spark):
    docs, items = cases()
    _, found = run(spark, docs, items)
    assert {(r["doc_id"], r["item_id"]): r["equal"] for r in found.collect()} == brute(docs, items)


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    left, found = run(spark, docs, items)
    wanted = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == set(wanted)
    kept = [r["doc_id"] for r in decontam.clean(left, found).collect()]
    bad = {d for d, _ in wanted}
    assert sorted(kept) == sorted(d for d, _ in docs if d not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items)[1].count() == 0
    assert run(spark, docs, [])[1].count() == 0
