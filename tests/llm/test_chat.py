import hashlib
from collections import defaultdict

from mlwatch.llm import chat
from tests.oracle_check import mismatch

SCHEMA = "conv_id long, turn long, role string, text string, window int, loss int"


def formatted(spark, rows, **options):
    return chat.windows(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA), **options)


def test_read_back_gives_every_turn_once(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nyes", r"<\|x <\\| <", "", "a\n\nb", "<", "|", "\\"]
    rows = [(c, t, ("system", "user", "assistant")[t % 3], nasty[(c + t) % len(nasty)] * (1 + t % 5)) for c in (1, 2, 3) for t in range(40)]
    rows += [(None, 0, "user", "null conversation"), (None, None, None, None), (4, 0, "odd\n%0A<|role", "x"), (5, 0, "assistant", "y"), (5, 0, "assistant", "y")]
    out = formatted(spark, rows, budget=60, history=10).collect()
    back = {(r.conv_id, r.window): r for r in chat.read_back(formatted(spark, rows, budget=60, history=10)).collect()}
    turns, targets = defaultdict(list), defaultdict(list)
    for key in sorted(back, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
        turns[key[0]] += [(t.role, t.text) for t in back[key].turns]
        targets[key[0]] += back[key].targets
    expected = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    assert turns == expected
    assert targets == {c: [t for role, t in said if role == "assistant"] for c, said in expected.items()}
    assert max(r.window for r in out) > 3 and any(r.n_repeated > 1 for r in out)
    for r in out:
        pieces = r.text.split("<|im_start|>")
        assert pieces[0] == "" and len(pieces) == r.n_turns + 1 and r.text.count("<|im_end|>") == r.n_turns


def test_windows_keep_the_system_turn_and_the_budget(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, t, ("user", "assistant")[t % 2], "t" * 60) for t in range(1, 50)]
    out = sorted(formatted(spark, rows, budget=160, history=40).collect(), key=lambda r: r.window)
    tokens = lambda text: -(-len(text) // 4) + 4
    for r in out:
        parts = [p.split("\n", 1)[1][: -len("<|im_end|>\n")] for p in r.text.split("<|im_start|>")[1:]]
        assert parts[0] == "s" * 40 and sum(map(tokens, parts)) <= 160
        assert r.n_repeated == (0 if r.window == 0 else 1 + 40 // 19)
    assert len(out) > 5


def test_query_equals_sql(spark, sf, duck):
    assert mismatch(chat.op9_chat_windows(spark, sf), duck, chat.OP9_SQL) is None


def test_the_added_conversation(spark, sf):
    row = chat.op9_chat_windows(spark, sf).filter("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf):
    plan = chat.op9_chat_windows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0
