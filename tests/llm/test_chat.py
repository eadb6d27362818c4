"""Chat formatting: exact round trip, conversations over many tasks, oracle SQL."""

import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from callqc.llm import chat, queries

pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "im_end", ">", "é", "\n", "a", "[", "INST]"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), min_size=1, max_size=5))
def test_round_trip(turns):
    out, rows, begin, end = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    whole = bytes(out)
    assert chat.parse(whole.decode()) == turns
    for k, (_, t) in enumerate(turns):
        own = whole[begin[k] : end[k]].decode()
        assert chat.unescape(own) == t and not any(c in own for c in chat.CONTROL)
        assert chat.parse(whole[rows[k] : rows[k + 1]].decode()) == [turns[k]]


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(frame).collect()}


def test_query(spark, sf_dir, tables):
    rows = tables.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    got = queries.op3_chat(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows)
    sql = {r[0]: r for r in tables.sql(queries.ORACLE["op3_chat"]).fetchall()}
    assert {r.conv_id: tuple(r) for r in got} == sql


def test_edge_cases_and_a_long_conversation(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", ""), (2, 5, "assistant", "é\\<s>" * 50_000), (None, 1, "user", "a"),
            (None, 0, "assistant", "b"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 0, "user\n<|im_sep|>", "</s>")]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k} \\ <|im_end|>") for k in range(30_000)]
    turns = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    formatted = chat.format_turns(turns)
    assert digests(formatted) == want(rows)
    pieces = {r.conv_id: r["count"] for r in formatted.groupBy("conv_id").count().collect()}
    assert pieces[9] > 1 and pieces[3] == 1
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_texts_of_one_turn_that_begin_alike_keep_their_order(spark):
    rows = [(1, 0, "user", "same beginning " * 8 + str(k * 7919 % 4000)) for k in range(4000)]
    rows += [(1, 0, "user", f"{k * 31 % 4000:05} other") for k in range(4000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(joined)
    spark.conf.set(joined, "false")
    try:
        formatted = chat.format_turns(turns)
        assert digests(formatted) == want(rows)
        assert formatted.count() > 1
    finally:
        spark.conf.set(joined, before)
