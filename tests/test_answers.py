"""Services asked through lanes and a table of answers, with a fake transport that notes what it is asked."""

import json
import os

import pytest

from paperloom.operators import answers as A
from paperloom.operators import lookup, verify
from paperloom.sources import backends

ENTRIES = "entry_id long, title string, author string, year string, doi string, arxiv_id string, abstract string"
FEED = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'
ENTRY = "<entry><id>http://arxiv.org/abs/2001.00001v1</id><title>{}</title><published>2020-01-01</published><summary>{}</summary><author><name>Ann Lee</name></author></entry>"


def noting(folder, reply):
    """A transport that appends each question to a file of its process."""

    def send(source, kind, payload):
        with open(f"{folder}/asked-{os.getpid()}", "a") as f:
            f.write(json.dumps([source, kind, payload]) + "\n")
        return reply(source, kind, payload)

    return send


def asked(folder):
    return sorted(tuple(json.loads(line)) for name in os.listdir(folder) if name.startswith("asked-") for line in open(f"{folder}/{name}"))


class Clock:
    def __init__(self):
        self.now, self.slept = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def lane(policy, replies):
    clock, replies = Clock(), iter(replies)

    def send(*_):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    return A.Lane(policy, send, clock, clock.sleep), clock


def test_pace_and_repeats():
    own, clock = lane(A.Policy(3.0), [(200, "a"), (200, "b")])
    assert [own.ask("s", "k", "x")[1] for _ in range(2)] == ["a", "b"] and clock.slept == [3.0]
    own, clock = lane(A.Policy(1.5, lanes=2), [(429, ""), (200, "c")])
    assert own.ask("s", "k", "x") == (200, "c", None, 2) and clock.slept == [5.0] and not own.closed  # the wait covers the pace
    own, clock = lane(A.Policy(0.0), [OSError("down"), (500, "")])
    assert own.ask("s", "k", "x") == (500, None, "status 500", 2)
    own, _ = lane(A.Policy(0.0), [(404, "")])
    assert own.ask("s", "k", "x") == (404, None, "status 404", 1) and own.failures == 0
    own, clock = lane(A.Policy(10.0, jitter=(3.0, 5.0)), [(200, "")] * 3)
    for _ in range(3):
        own.ask("s", "k", "x")
    assert all(13.0 <= s <= 15.0 for s in clock.slept) and len(clock.slept) == 2


def test_breaker():
    own, _ = lane(A.Policy(0.0, tries=1, give_up=2), [(500, ""), (200, ""), (500, ""), OSError("x")])
    closed = []
    for _ in range(4):
        own.ask("s", "k", "x")
        closed.append(own.closed)
    assert closed == [False, False, False, True]
    for reply in [(429, ""), (200, "We see Unusual Traffic from you")]:
        own, _ = lane(A.Policy(0.0, refusal_ends=True), [reply])
        assert own.ask("s", "k", "x")[2:] == ("refused", 1) and own.closed


def test_nothing_is_asked_twice(spark, tmp_path):
    down = tmp_path / "down"

    def reply(source, kind, payload):
        if payload == "bad" and down.exists():
            return 500, ""
        return (404, "") if payload == "lost" else (200, f"{source} {payload}")

    down.touch()
    (tmp_path / "log").mkdir()
    send = noting(tmp_path / "log", reply)
    kept = A.Answers(spark, f"file://{tmp_path}/answers")
    policies = A.unpaced({s: p for s, p in A.POLICIES.items() if s in ("dblp", "arxiv")})
    rows = [("dblp", "title", p, p) for p in ["a", "b", "bad", "lost", "a"]] + [("arxiv", "title", "a", "a"), ("nobody", "title", "a", "a")]
    requests = spark.createDataFrame(rows, "source string, kind string, key string, payload string")
    got = lambda: sorted((r["source"], r["key"], r["body"]) for r in A.ask(requests, kept, send, policies, wave=2).collect())
    assert got() == [("arxiv", "a", "arxiv a"), ("dblp", "a", "dblp a"), ("dblp", "b", "dblp b")]
    first = asked(tmp_path / "log")
    assert first == sorted([("arxiv", "title", "a"), ("dblp", "title", "a"), ("dblp", "title", "b"), ("dblp", "title", "bad"), ("dblp", "title", "bad"), ("dblp", "title", "lost")])
    down.unlink()
    assert ("dblp", "bad", "dblp bad") in got()
    again = asked(tmp_path / "log")
    assert len(again) == len(first) + 2  # the two failures
    assert kept.all().filter("error IS NOT NULL").count() == 3 and kept.all().filter("tries = 2").count() == 1


def test_a_source_that_refuses_gets_nothing_more(spark, tmp_path):
    send = noting(tmp_path, lambda source, kind, payload: (429, "") if source == "scholar" else (200, "x"))
    rows = [(s, "title", f"{i}", f"{i}") for s in ("scholar", "dblp") for i in range(12)]
    requests = spark.createDataFrame(rows, "source string, kind string, key string, payload string")
    kept = A.Answers(spark, f"file://{tmp_path}/answers")
    assert A.ask(requests, kept, send, A.unpaced(), wave=5).count() == 12
    assert [s for s, _, _ in asked(tmp_path)].count("scholar") == 1
    assert kept.all().filter("source = 'scholar'").count() == 1


def test_cascade_at_services(spark, tmp_path):
    entries = spark.createDataFrame(
        [(1, "Deep Models: of Text", "Lee, Ann", "2020", "", "2001.00001v2", ""), (2, "Sparse Attention", "Chen, Bo", "2021", "10.1/x", "", ""), (3, "Small Rings", "Lee, Ann", "2020", "", "", "")],
        ENTRIES,
    )
    page = '<div class="gs_ri"><h3 class="gs_rt"><span>[PDF]</span> <a href="x">Small Rings</a></h3><div class="gs_a">Ann Lee, B Chen - Journal, 2020 - s.org</div><div class="gs_fl">Cited by 3</div></div>'

    def reply(source, kind, payload):
        if source == "arxiv":
            return 200, FEED.format(ENTRY.format("Deep Models of Text", "We study.") if payload in ("2001.00001", "Deep Models of Text") else ENTRY.format("Other", "no"))
        if source == "crossref" and kind == "doi":
            return 200, '{"status": "ok", "message": {"title": ["Sparse Attention"], "author": [{"given": "Bo", "family": "Chen"}], "published-print": {"date-parts": [[2021]]}}}'
        if source == "openalex" or source == "semantic_scholar":
            return 404, ""
        return (200, page) if source == "scholar" else (200, "{}")

    (tmp_path / "log").mkdir()
    services = lookup.Services(A.Answers(spark, f"file://{tmp_path}/answers"), noting(tmp_path / "log", reply), A.unpaced())
    for _ in range(2):  # the second time from the table
        found, steps = lookup.staged(entries, services)
        best = {r["entry_id"]: (r["source"], r["is_match"]) for r in verify.cascade(entries, found).collect()}
        assert best == {1: ("arxiv", True), 2: ("crossref", True), 3: ("scholar", True)}
    questions = asked(tmp_path / "log")
    # Entry 1 is asked once in all, entry 2 once; entry 3 by title at every service, and again by the second run where that failed.
    assert [q for q in questions if q[1] != "title"] == [("arxiv", "arxiv_id", "2001.00001"), ("crossref", "doi", "10.1/x")]
    assert all(p == "Small Rings" for _, kind, p in questions if kind == "title")
    assert {s: [q[0] for q in questions].count(s) for s in ("dblp", "semantic_scholar", "scholar")} == {"dblp": 1, "semantic_scholar": 2, "scholar": 1}
    assert {r["entry_id"]: r["abstract"] for r in lookup.abstracts(entries, found, services).collect()} == {1: "We study."}


def test_scorer_answers_are_kept(spark, tmp_path):
    contexts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "bad"), (4, "")], "entry_id long, full_context string")
    known = spark.createDataFrame([(i, "abstract") for i in (1, 2, 3, 4)], "entry_id long, abstract string")
    send = noting(tmp_path, lambda *_: None)

    def scorer(pairs):
        for c, a in pairs:
            send("scorer", c, a)
        if any(c == "bad" for c, _ in pairs):
            raise ValueError("no such luck")
        return [json.dumps({"relevance_score": 4, "is_relevant": True, "explanation": c}) for c, _ in pairs]

    kept = A.Answers(spark, f"file://{tmp_path}/answers")
    run = lambda: sorted((r["entry_id"], r["relevance_score"], r["score_label"], r["error"]) for r in lookup.relevance(contexts, known, scorer, kept).collect())
    want = [(1, 4, "Relevant", None)] * 2 + [(2, 4, "Relevant", None), (3, 0, "Unknown", "no such luck"), (4, 0, "Unknown", "Missing context or abstract for evaluation")]
    assert run() == want
    before = asked(tmp_path)
    assert run() == want
    new = list(asked(tmp_path))
    for q in before:
        new.remove(q)
    assert {q[1] for q in new} == {"bad"}


@pytest.mark.parametrize("kind", backends.ENDPOINTS)
def test_backends(kind):
    reply = {"anthropic": {"content": [{"type": "text", "text": "hi"}]}, "ollama": {"response": "hi"}, "gemini": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}}.get(kind, {"choices": [{"message": {"content": "hi"}}]})
    b = backends.Backend(kind, key="k")
    url, headers, body = b.request("Is it?")
    assert "Is it?" in body and headers["Content-Type"] == "application/json" and url.startswith("http")
    assert kind == "ollama" or "k" in (headers.get("Authorization", "") + headers.get("x-api-key", "") + url)
    assert b.reply(json.dumps(reply)) == "hi" and b.reply("{}") == ""
    assert b.sender(lambda *_: (200, json.dumps(reply)))("s", "k", "p") == (200, "hi") and b.sender(lambda *_: (500, "x"))("s", "k", "p") == (500, "x")
    with pytest.raises(ValueError):
        backends.Backend("other")
