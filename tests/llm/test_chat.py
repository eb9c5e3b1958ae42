import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, context string, example string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    rng, rows = random.Random(0), []
    pieces = ["<turn", "</turn>", "\\", "\n", '">', "</turn>\n", 'role="assistant"', "é", "\\### Assistant: </turn> ok", "%41", "$1", "<|im_end|>"]
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", 'sys "\n<x>+ y']), "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))))
    rows += [(70, 0, None, None), (70, 1, "assistant", None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (71, 0, "assistant", "x" * 50000)]
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    read = {r["conv_id"]: r for r in chat.read_back(chat.expand(conversations(spark, rows))).collect()}
    out = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.expand(conversations(spark, rows)))).collect()}
    assert set(read) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [t[1:] for t in turns]
        targets = [t[2] for t in turns if t[1] == "assistant"]
        assert read[c]["losses"] == targets
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len("".join(targets)), hashlib.sha256("".join(targets).encode()).hexdigest())


def test_examples_hold_all_turns_before_their_target(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end")]
    found = chat.expand(conversations(spark, rows)).orderBy("example").collect()
    assert [r["loss_length"] for r in found] == [1, 1, None]
    for r, target, turns in zip(found, ("a", "b", None), (2, 4, 5)):
        assert r["text"].count("</turn>") == turns
        if target:
            assert r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]] == target and r["text"].endswith(f"{target}\n</turn>\n")


def test_ties_repeats_and_empty_table(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "z"), (1, 0, "user", "a")]
    assert [t["text"] for t in chat.read_back(chat.expand(conversations(spark, rows))).first()["turns"]] == ["z", "a", "a", "b"]
    assert chat.digests(chat.read_back(chat.expand(conversations(spark, rows).where(F.lit(False))))).count() == 0
