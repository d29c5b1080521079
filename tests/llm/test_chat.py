import hashlib
import random

from pyspark.sql import functions as F

from walkmoments.llm import chat, registry


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda k: (k[0][0], k[0][1] or 0, k[1].encode(), k[2].encode()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_round_trip_of_hostile_texts(spark):
    random.seed(3)
    bits = ["\\", "</turn>", "<turn ", ">\n", "\n", "\\e", "\\b", "### Assistant:", "é😀", "word ", "<turn assistant>\n", "</turn>\n"]
    rows = []
    for c in range(40):
        for t in range(random.randint(1, 30)):
            role = random.choice(["user", "assistant", "system", "a>\nb", "", None])
            rows.append((c, t, role, random.choice([None, "", "".join(random.choices(bits, k=random.randint(1, 40)))])))
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (99, 5, "assistant", "dup"), (99, 5, "assistant", "dup"), (98, 0, "assistant", "long " * 9000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, window int")
    for budget, history in ((2048, 512), (60, 30), (40, 0)):
        assert found(chat.digests(df, budget, history)) == brute(rows)
    assert chat.digests(df.limit(0)).count() == 0


def tokens(marked):
    return -(-len(marked) // 4)


def pieces(formatted):
    return [x + "</turn>\n" for x in formatted.split("</turn>\n")[:-1]]


def test_windows_keep_the_budget(spark):
    """No window exceeds the budget but where one own turn, beside the system turn, does."""
    random.seed(9)
    rows = []
    for c in range(25):
        system = random.choice([0, 10, 700, 1500, 2300])
        if system:
            rows.append((c, 0, "system", "s" * system))
        for t in range(1, random.randint(2, 70)):
            rows.append((c, t, "user" if t % 2 else "assistant", f"turn {t} " + "\\" * random.choice([0, 300]) + "w" * random.choice([0, 3, 72, 400, 900, 5000])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(chat.digests(df, 600, 150)) == brute(rows)
    got = chat.format_windows(df, 600, 150).orderBy("conv_id", "window").collect()
    assert len(got) > 100
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    over = context = 0
    for windows in by.values():
        said = [pieces(w.formatted) for w in windows]
        whole = [x for w, p in zip(windows, said) for x in p[w.n_context :]]
        system = [x for x in whole if x.startswith("<turn system>")]
        seen = False
        if sum(map(tokens, whole)) <= 600:
            assert len(windows) == 1
        for k, (w, p) in enumerate(zip(windows, said)):
            own, masked = p[w.n_context :], p[: w.n_context]
            assert w.n_tokens == sum(map(tokens, p))
            if seen:
                assert masked and masked[0] == system[0]
                masked = masked[1:]
            if masked:  # the last turns of the window before, as far as the history reaches
                last = [x for x in said[k - 1][windows[k - 1].n_context :] if x not in system]
                assert last[-len(masked) :] == masked and sum(map(tokens, masked)) <= 150
                context += 1
            if w.n_tokens > 600:
                assert len(own) == 1 and not masked
                over += 1
            seen = seen or any(x in system for x in own)
    assert over and context > 20


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "w" * 72) for t in range(1, 21)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_windows(df, budget=130, history=30).orderBy("window").collect()
    assert len(got) > 3
    for r in got:
        assert r.formatted.count("<turn system>") == 1 and r.formatted.startswith("<turn system>\nbe kind</turn>\n")
        assert all(r.formatted[t.start : t.end].startswith("turn ") for t in r.targets) and r.n_tokens <= 130
    assert all(r.n_context == 2 for r in got[1:])  # the system turn and one repeated turn
    assert sum(len(r.targets) for r in got) == 10


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    df = registry.op2_chat_windows(spark, sf)
    assert found(df) == brute(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
