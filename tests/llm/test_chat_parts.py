"""Typed parts: control strings over part borders, and part lists of any shape."""

from __future__ import annotations

import itertools

from tessera.llm import chat


def read_back(turn):
    ((role, content),) = chat.FRAGMENT.findall(turn["fragment"])
    assert chat.TURN + role + chat.TEXT + content + chat.END == turn["fragment"]
    return chat.unescape(role), chat.unescape(chat.PLACEHOLDER.sub("", content))


PIECES = ["", "<", "|", "\\", "a<", "|end|><|turn|>", "|image:0|>y", "x<", "<|text|>", "\\<", "|>", "<<", "||", "\\\\|"]


def test_texts_read_back_over_all_borders():
    for pieces in itertools.product(PIECES, repeat=3):
        parts = [{"type": "text", "text": p} for p in pieces]
        turn = chat.format_turn("assistant", None, parts)
        assert read_back(turn) == ("assistant", "".join(pieces)), pieces
        trained = "".join(chat.unescape(turn["fragment"][s["start"] : s["start"] + s["length"]]) for s in turn["loss_spans"])
        assert trained == "".join(pieces)


def test_texts_beside_placeholders_read_back():
    for a, b in itertools.product(PIECES, repeat=2):
        parts = [{"type": "text", "text": a}, {"type": "image", "width": 20, "height": 14}, {"type": "text", "text": b}, {"type": "audio", "seconds": 1.0}]
        turn = chat.format_turn("<|", None, parts)
        assert read_back(turn) == ("<|", a + b)
        assert [turn["fragment"][x["start"] :].split(">")[0] for x in turn["attachments"]] == ["<|image:0|", "<|audio:1|"]
        assert [x["tokens"] for x in turn["attachments"]] == [2, 25]


def test_part_lists_of_other_shapes(spark):
    shapes = {
        "array<struct<type:string,text:string>>": [("text", "hi")],
        "array<struct<text:string,type:string,width:string,extra:array<int>>>": [("hi", "text", "x", [1]), (None, "image", "28", None)],
        "array<struct<type:array<int>,text:int>>": [([1], 5)],
        "array<string>": ["hi"],
        "string": "hi",
        "map<string,string>": {"type": "text"},
    }
    got = {}
    for kind, value in shapes.items():
        df = spark.createDataFrame([(1, 0, "user", "own", value), (1, 1, "assistant", "own", None)], f"conv_id long, turn long, role string, text string, parts {kind}")
        rows = chat.format_turns(df).orderBy("turn").collect()
        assert rows[1].fragment == "<|turn|>assistant<|text|>own<|end|>"
        got[kind] = (rows[0].fragment.removeprefix("<|turn|>user<|text|>").removesuffix("<|end|>"), rows[0].attachment_tokens)
    assert list(got.values()) == [("hi", 0), ("hi<|image:0|>", 2), ("5", 0), ("own", 0), ("own", 0), ("own", 0)]
