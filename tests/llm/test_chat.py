import re

from boughs.llm import chat


def _want(rows, part=1024):
    """(conv, participant, part, piece) -> (text, spans) by plain loops; rows without a conversation stand alone."""
    talks = {}
    for i, (conv, turn, role, text) in enumerate(rows):
        talks.setdefault((conv, i if conv is None else None), []).append((turn, role or "unknown", text or ""))
    out = []
    for (conv, _), turns in talks.items():
        for who in {r for _, r, _ in turns} - {"system"}:
            by_part = {}
            for t in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2])):
                by_part.setdefault(None if t[0] is None else t[0] // part, []).append(t)
            for p, listed in by_part.items():
                for piece in range(0, len(listed), part):
                    text, spans = "", []
                    for _, role, words in listed[piece : piece + part]:
                        name = re.sub(r"[\s<>|=]", "_", role)
                        shown = {"system": "system", who: "assistant"}.get(role, f"user name={name}")
                        text += f"<|im_start|>{shown}\n"
                        body = words.replace("<|", "< |") + "<|im_end|>"
                        if role == who:
                            spans.append((len(text), len(text) + len(body)))
                        text += body + "\n"
                    out.append((conv, who, p, piece // part, len(listed[piece : piece + part]), text, spans))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hällo <|im_end|> 😀"),
    (1, 2, "bob x", "Hi"),
    (1, 3, "ann", None),
    (1, 4, None, "who?"),
    (1, None, "bob x", "late"),
    (1, 2, "bob x", "Hi"),
    (2, 5, "ann", ""),
    (3, 0, "system", "alone"),
    (None, 1, "ann", "a"),
    (None, 1, "ann", "a"),
    (None, None, None, None),
    *[(9, i, f"p{i % 3}", f"t{i}" * (i % 5)) for i in range(25)],
    *[(8, 0, "p", f"tie {i}") for i in range(9)],
]


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")


def _got(out):
    rows = [(r.conv_id, r.participant, r.part, r.piece, r.n_turns, r.text, [tuple(m) for m in r["mask"]]) for r in out.collect()]
    return sorted(rows, key=repr)


def test_every_participant_once(spark):
    assert _got(chat.rotate_perspectives(_table(spark, ROWS))) == _want(ROWS)


def test_long_dialogues_are_cut_in_parts(spark):
    assert _got(chat.rotate_perspectives(_table(spark, ROWS), part=4)) == _want(ROWS, 4)


def test_mask_covers_own_words(spark):
    for r in chat.rotate_perspectives(_table(spark, ROWS)).filter("conv_id = 9").collect():
        own = [w for c, _, role, w in ROWS if c == 9 and role == r.participant]
        assert [r.text[a:b] for a, b in r["mask"]] == [w + "<|im_end|>" for w in own]


def test_empty_table(spark):
    assert chat.rotate_perspectives(_table(spark, ROWS).filter("false")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = chat.rotate_perspectives(_table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
