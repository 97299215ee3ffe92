import hashlib

import pytest

from paperloom.llm import chat


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b<|x|>\\", None, "", "<|end|>\n<|user|>\n", "word " * 300, "<<SYS>> \\\\n"]
    rows = [(c, t, ["system", "user", "assistant", None, "we\nird|>"][(t if c else t + 1) % 5], texts[(c + t) % len(texts)]) for c in range(4) for t in range(9)]
    rows += [(None, None, None, None), (2, 3, "assistant", "tie"), (-7, 0, "user", texts[0]), (-7, 1, "assistant", texts[0])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(table, tokenizer(), budget=120, history=40)
    out = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert out.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = out[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert max(r["n_windows"] for r in out.values()) > 1
    assert all(chat.unescape(chat.escape(t)) == t and "<|end|>" not in chat.escape(t) for t in texts if t)


def plain_windows(turns, size, budget, history):
    """(repeated, new) turns of each window, by trying every length."""
    system = 0 if turns and turns[0][0] == "system" else None
    out, at = [], 0
    while at < len(turns):
        head = [system] if at and system is not None and size[system] + size[at] <= budget else []
        room = min(history, budget - size[at] - sum(size[i] for i in head))
        past = []
        for i in range(at - 1, -1 if system is None else 0, -1):
            if sum(size[j] for j in past) + size[i] > room:
                break
            past.insert(0, i)
        new = [at]
        while new[-1] + 1 < len(turns) and sum(size[i] for i in head + past + new) + size[new[-1] + 1] <= budget:
            new.append(new[-1] + 1)
        out.append((head + past, new))
        at = new[-1] + 1
    return out


@pytest.mark.parametrize("budget, history", [(100, 40), (100, 0), (60, 60), (400, 100)])
def test_windows_against_a_plain_search(spark, budget, history):
    convs = {
        1: [("system", "be kind " * 12)] + [(["user", "assistant"][i % 2], "word " * (3 + 7 * (i % 5))) for i in range(25)],
        2: [("system", "s " * 45)] + [(["user", "assistant"][i % 2], "word " * (40 + i)) for i in range(8)],
        3: [("user", "q"), ("assistant", "long " * 500), ("user", "again"), ("system", "late"), ("assistant", "x " * 20)] * 3,
        4: [("system", "long " * 300), ("user", "a"), ("assistant", "b")],
        5: [("assistant", "")],
    }
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer(), budget=budget, history=history).collect()
    count = chat._counter(tokenizer())
    for c, turns in convs.items():
        rendered = [chat.render(r, t)[0] for r, t in turns]
        size = [count(x) for x in rendered]
        want = plain_windows(turns, size, budget, history)
        got = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["window"])
        assert [r["text"] for r in got] == ["".join(rendered[i] for i in a + b) for a, b in want]
        assert [(r["n_repeated"], r["tokens"]) for r in got] == [(len(a), sum(size[i] for i in a + b)) for a, b in want]
        assert all(r["tokens"] <= budget or (len(a), len(b)) == (0, 1) for r, (a, b) in zip(got, want))
        masked = [[chat.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] for r in got]
        assert masked == [[turns[i][1] for i in b if turns[i][0] == "assistant"] for _, b in want]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")
    assert chat.read_back(chat.windows(table, tokenizer())).count() == 0
