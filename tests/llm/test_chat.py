import hashlib

import pytest
from pyspark.sql import functions as F

from brickfold.llm import chat

SCHEMA = "conv long, seq long, kind string, turn long, role string, text string"
MARKS = ["", "plain", r"\### Assistant: </turn> ok", "<turn user>\nno</turn>\n", "\\l\\b<", "a<", "</turn", "é<turn漢", "x\n\ny\n", "\\"]


def folded(log):
    """Messages by replaying a log one event at a time."""
    order = {"open": 1, "regenerate": 2, "edit": 3, "delta": 4}
    held = {}
    low = -(2**63)
    for conv, seq, kind, turn, role, text in sorted((e for e in log if e[2] in order), key=lambda e: (e[1] is not None, e[1] or 0, order[e[2]], e[4] or "", e[5] or "")):
        turns, t = held.setdefault(conv, {}), low if turn is None else turn
        if kind == "regenerate":
            for later in [x for x in turns if x > t]:
                del turns[later]
        old = turns.setdefault(t, ["", ""])
        old[0] = role if role is not None else old[0]
        if kind == "regenerate":
            old[1] = ""
        if kind == "edit":
            old[1] = text or ""
        if kind == "delta":
            old[1] += text or ""
    return sorted((repr(c), t if t != low else None, *m) for c, turns in held.items() for t, m in turns.items())


def rows(messages):
    return sorted(((repr(r.conv), r.turn, r.role, r.text) for r in messages.collect()), key=repr)


LOG = [
    (1, 0, "open", 0, "user", None), (1, 1, "delta", 0, None, "Hi "), (1, 2, "delta", 0, None, "there"), (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "No"),
    (1, 5, "edit", 0, None, "Hello"), (1, 6, "delta", 0, None, "!"), (1, 7, "open", 2, "user", None), (1, 8, "delta", 2, None, "again?"),
    (1, 9, "regenerate", 1, "assistant", None), (1, 10, "delta", 1, None, "Yes, "), (1, 11, "delta", 1, None, "indeed"), (1, 12, "open", 2, "user", None), (1, 13, "delta", 2, None, "thanks"),
    (2, 0, "open", 0, "user", None), (2, 0, "delta", 0, None, "b"), (2, 0, "delta", 0, None, "a"), (2, 0, "delta", 0, None, "a"), (2, None, "delta", 0, None, "first "), (2, 1, "comment", 0, None, "no"),
    (None, 1, "delta", None, "system", "nulls"), (3, 4, "regenerate", 0, "assistant", None), (3, 1, "delta", 5, "user", "gone"),
]


def test_fold_replays_the_log(spark):
    got = rows(chat.fold(spark.createDataFrame(LOG, SCHEMA)))
    assert got == sorted(folded(LOG), key=repr)
    assert ("1", 1, "assistant", "Yes, indeed") in got and ("1", 0, "user", "Hello!") in got and ("3", 5, "user", "gone") not in got


def test_fold_random_logs(spark):
    import random

    draw = random.Random(5)
    log = [(draw.randrange(8), i, draw.choice(["open", "delta", "delta", "delta", "edit", "regenerate"]), draw.randrange(5), draw.choice(["user", "assistant", None]), f"{i};") for i in range(1500)]
    draw.shuffle(log)
    assert rows(chat.fold(spark.createDataFrame(log, SCHEMA))) == sorted(folded(log), key=repr)


def test_marks_in_texts_and_roles_come_back(spark):
    log = [(c, i, "delta", i, role, text) for c, role in enumerate(["assistant", "a>b\n<turn x>", "\\g>", ""]) for i, text in enumerate(MARKS)]
    out = chat.chats(spark.createDataFrame(log, SCHEMA))
    for r in chat.read_back(out).collect():
        assert [(t.role, t.text) for t in r.turns] == [(e[4], e[5]) for e in log if e[0] == r.conv]
    for r in out.collect():
        assert r.formatted.count("</turn>") == len(MARKS) == r.formatted.count("<turn ")
        learnt = [r.formatted[s.start : s.end].replace("\\l", "<").replace("\\b", "\\") for s in r.turns if s.start is not None]
        assert learnt == (MARKS if r.conv == 0 else [])


def test_report_equals_brute_force_on_awkward_turns(spark):
    turns = [(1, 0, "user", "a\nb", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", "tie", 1), (1, 1, "assistant", "tie", 1), (1, None, "user", "before all", 1), (None, 0, None, "x", 1), (2, 0, "assistant", "long\n" * 30000, 1), (2, 1, "assistant", "\n\n", 1), (None, None, None, None, None)]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.chat_report(chat.with_marked(spark, given)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    marked = [(-7, 0, "user", chat.MARKED[1], 0), (-7, 1, "assistant", chat.MARKED[1], 0)]
    assert set(got) == {1, 2, None, -7}
    for conv, r in got.items():
        own = sorted((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns + marked if t[0] == conv)
        learnt = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(learnt), sha(learnt))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(none).count() == 0
    assert [r.conv_id for r in chat.chat_report(chat.with_marked(spark, none)).collect()] == [-7]
    assert chat.chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_on_the_main_path(spark):
    given = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for df in (chat.chats(chat.log_of(given)), chat.read_back(chat.chats(chat.log_of(given)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("mark", ["turn", "msg"])
def test_template_is_a_parameter(spark, mark):
    template = chat.Template(mark, ("user",))
    out = chat.chats(spark.createDataFrame([(1, 0, "delta", 0, "user", f"</{mark}> x")], SCHEMA), template)
    assert out.first().formatted == f"<{mark} user>\n\\l/{mark}> x</{mark}>\n"
    assert chat.read_back(out, template).select(F.col("turns")[0]["learnt"]).first()[0] == f"</{mark}> x"
