import duckdb

from codexferry.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, prompt string, c int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(chosen, rejected):
    out = {}
    for pair in {r[0] for r in chosen + rejected}:
        sides = []
        for rows in (chosen, rejected):
            turns = {}
            for p, t, role, text in rows:
                if p == pair:
                    turns.setdefault(chat.FIRST if t is None else t, set()).add((role or "", text or ""))
            sides.append({t: sorted(m) for t, m in turns.items()})
        c, r = sides
        end = min((t for t in {*c, *r} if c.get(t) != r.get(t)), default=None)
        for t in sorted({*c, *r}):
            key = (pair, 0 if t == chat.FIRST else t // chat.TURNS)
            row = out.setdefault(key, {"prompt": [], "chosen": [], "rejected": []})
            if end is None or t < end:
                row["prompt"] += c[t]
            else:
                row["chosen"] += c.get(t, [])
                row["rejected"] += r.get(t, [])
    return out


def check(spark, chosen, rejected):
    found = chat.preferences(frame(spark, chosen), frame(spark, rejected)).collect()
    wanted = brute(chosen, rejected)
    assert {(r["conv_id"], r["chunk"]) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        for name, messages in wanted[r["conv_id"], r["chunk"]].items():
            assert r[name] == "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in messages)
            assert r[f"{name}_turns"] == len(messages)
            if name != "prompt":
                learned = [r[name][s["start"] : s["end"]] for s in r[f"{name}_spans"]]
                assert learned == [text + "<|end|>" for role, text in messages if role == "assistant"]


def test_prefix_completions_and_masks(spark):
    talk = [(1, 0, "system", "s"), (1, 1, "user", "hé 😀"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "fine")]
    other = talk[:2] + [(1, 2, "assistant", "bad"), (1, 3, "user", "more")]
    same = [(2, 0, "user", "a"), (2, 5, "assistant", "b")]
    odd = [(None, None, None, None), (None, 0, "assistant", ""), (None, 0, "assistant", ""), (None, 0, "user", "z"), (3, 1, "user", "only chosen")]
    check(spark, talk + same + odd, other + same + odd[:2] + [(4, 0, "assistant", "only rejected"), (5, 1, "user", "x")])
    check(spark, [], [])
    check(spark, talk, [])


def test_long_conversations_come_in_chunks(spark):
    talk = [(1, t, "user" if t % 2 else "assistant", "w" * 3) for t in range(1000)]
    other = [r if r[1] != 700 else (1, 700, "assistant", "changed") for r in talk]
    check(spark, talk, other)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    wanted = con.sql(queries.CHAT_SQL)
    found = queries.op4_preference_chat(spark, sf)
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = [tuple(r[c] for c in wanted.columns) for r in found.collect()]
    assert sorted(rows) == sorted(wanted.fetchall())
    assert sum(r["prompt_turns"] > 0 and r["rejected_turns"] > 0 for r in found.collect()) > 5
