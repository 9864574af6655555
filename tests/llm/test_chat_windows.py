import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import chat_windows as C


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learnt = "".join(text for _, _, role, text in turns if role.lower() == "assistant")
        out[conv] = len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()
    return out


def check(spark, rows, **kw):
    chats = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, span int")
    windows = C.format_chats(chats, **kw)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(windows).collect()}
    assert got == brute(rows)
    return windows.orderBy("conv_id", "span").collect()


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|end|>", "<\\s>", "\\", "\n", "a", "<", "é\U0001f600", "<\\\\/s>"]


def test_windows_repeat_and_mask(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"{i} " + "w" * 90) for i in range(1, 40)]
    got = check(spark, rows, stride=100, history=60)
    assert len(got) > 8
    for w in got[1:]:
        assert w.text.startswith("<s>system\nbe kind</s>") and w.n_repeated >= 2
        assert all(w.text[s.start : s.stop].split()[0].isdigit() for s in w.loss)


def test_edge_cases(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (2, None, None, None), (2, 3, "ro\\n\nle", "x"), (3, 5, "assistant", "y" * 30000), (3, 2000000, "assistant", ""), (3, 6, "user", "z"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    check(spark, rows, stride=64, history=64)
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 5), st.sampled_from(["system", "user", "assistant"]), st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)), min_size=1, max_size=25))
def test_any_conversation(spark, rows):
    check(spark, rows, stride=12, history=6)


def test_formatted_text_holds_no_stray_control_strings(spark):
    rows = [(1, 0, "user", "".join(CONTROL) * 2), (1, 1, "assistant", "</s></s>")]
    for w in check(spark, rows):
        assert w.text.count("</s>") == w.n_turns == w.text.count("<s>")


def test_any_role_comes_back(spark):
    roles = ["user", "a\\nb", "a\nb", "\\", "\\\\n", "\x00", "\\\x00n", "x\\\n\\n", "</s>[INST]", "<\\/s>\n\\", "\nB\nN", ""]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(roles)], "i int, role string")
    got = rows.select("i", C._escaped_role(rows.role).alias("e"), C._plain_role(C._escaped_role(rows.role)).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == roles and not any("\n" in r.e for r in got)
