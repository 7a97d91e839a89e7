import json
import random

from sievewright import cli
from sievewright.plans import transcript
from sievewright.sources.messages import parse_message, parse_messages

from . import restated as R


def pruned(messages, budget, recent_turns):
    """(kept places, pinned ids) in plain Python; messages are (role, tokens, ids)."""
    turn, turns = 0, []
    for role, _, _ in messages:
        turn += role == "user"
        turns.append(None if role == "system" else turn)
    last = max((t for t in turns if t is not None), default=0)
    safe = {i for i, t in enumerate(turns) if t is None or t > last - recent_turns}
    name = R.groups([m[2] for m in messages])
    must = {i for i in range(len(messages)) if name[i] in {name[j] for j in safe}}
    room, kept = budget - sum(messages[i][1] for i in must), set(must)
    loose = {}
    for i in range(len(messages)):
        if i not in must:
            loose.setdefault(name[i], []).append(i)
    for g in sorted(loose.values(), key=max, reverse=True):
        cost = sum(messages[i][1] for i in g)
        if cost <= room:
            room -= cost
            kept.update(g)
    return kept, sorted({x for i in kept - safe for x in messages[i][2]})


def test_pruning_at_random(spark):
    rng = random.Random(4)
    convs = [[(rng.choice(["user", "assistant", "tool", "system"]), rng.randint(0, 6), rng.choices("abcdefgh", k=rng.choice([0, 0, 1, 2]))) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(c, i, role, f"m{i}", n, ids, []) for c, m in enumerate(convs) for i, (role, n, ids) in enumerate(m)]
    m = spark.createDataFrame(rows, "conv_id long, index int, role string, text string, tokens int, tool_call_ids array<string>, tool_result_ids array<string>")
    out, pinned = {}, {r.conv_id: r.pinned for r in transcript.pinned_tool_results(transcript.mark_kept(m, 9, 1)).collect()}
    for r in transcript.prune_messages(m, 9, 1).orderBy("conv_id", "position").collect():
        out.setdefault(r.conv_id, []).append(r)
    for c, messages in enumerate(convs):
        kept, pins = pruned(messages, 9, 1)
        assert [r["index"] for r in out.get(c, []) if r["index"] >= 0] == sorted(kept)
        assert pinned.get(c, []) == pins
        gone = sum(int(r.text[1:].split()[0]) for r in out.get(c, []) if r["index"] < 0)
        assert gone == len(messages) - len(kept)


def test_message_shapes(spark):
    shapes = [
        ({"content": None}, ("user", "", [], [])),
        ({"role": "tool", "content": "ok", "tool_call_id": "c1"}, ("tool", "ok", [], ["c1"])),
        ({"role": "assistant", "content": "", "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": {"b": 1.0, "a": "é"}}}]}, ("assistant", 'f({"b": 1.0, "a": "\\u00e9"})', ["c1"], [])),
        ({"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "x"}]}, {"type": "image"}, 3]}, ("user", "x", [], ["t"])),
        ({"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "g", "input": {}}]}, ("assistant", "hi\ng({})", ["t"], [])),
    ]
    for raw, want in shapes:
        assert parse_message(raw) == want
    rows = spark.createDataFrame([(0, i, json.dumps(r)) for i, (r, _) in enumerate(shapes)], "conv_id long, index int, raw string")
    got = parse_messages(rows).orderBy("index").collect()
    assert [(r.role, r.text, r.tool_call_ids, r.tool_result_ids) for r in got] == [w for _, w in shapes]


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "in.md"
    path.write_text("one two three\n\nfour five six")
    assert cli.main([str(path), "--budget", "100", "--stats"], spark) == 0
    said = capsys.readouterr()
    assert said.out == "one two three\n\nfour five six\n" and said.err.startswith("kept 2 of 2 segments | 8 -> 8 tokens (budget 100)")
    chat = tmp_path / "chat.json"
    chat.write_text(json.dumps([dict(role=r, content=c) for r, c in (("user", "a b c d e f"), ("assistant", "x"), ("user", "y"))]))
    cli.main([str(chat), "--budget", "1", "--messages", "--recent-turns", "1", "--json"], spark)
    report = json.loads(capsys.readouterr().out)
    assert json.loads(report["text"])[0]["content"] == "[2 earlier messages elided]" and report["messages_out"] == 2
