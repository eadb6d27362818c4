"""Decontamination: tiling against a plain greedy tiling, planted passages, edge cases."""

import unicodedata

import numpy as np

from callqc.llm import decontam, queries


def plain_tiling(item, doc, width):
    """Greedy string tiling by looking at all pairs of places, longest match first."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_i[a + n] and free_d[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < width:
            return out
        for k in range(n):
            free_i[a + k] = free_d[b + k] = False
        out.append((a, b, n))


def test_tiling_equals_a_plain_one():
    rng = np.random.default_rng(5)
    for trial in range(60):
        words = [bytes([97 + int(c)]) for c in rng.integers(0, 3 + trial % 4, 400)]
        item, doc = words[: int(rng.integers(3, 25))], words[100 : 100 + int(rng.integers(0, 60))]
        if trial % 2 and len(item) > 8:  # the halves in the other order
            doc = doc + item[len(item) // 2 :] + [b"zz"] + item[: len(item) // 2]
        width = 3
        block = decontam.build(["i"], [b" ".join(item)], width)
        got = decontam.matches(block, b" ".join(doc))
        want = sum(n for _, _, n in plain_tiling(item, doc, width)) / len(item)
        assert (got[0][1] if got else 0) == want


def test_leaving_out_items_of_a_low_bound_keeps_the_best_and_the_covered():
    rng = np.random.default_rng(6)
    items = [b" ".join(b"w%d" % c for c in rng.integers(0, 6, int(rng.integers(4, 30)))) for _ in range(40)]
    block, left_out = decontam.build(list(range(40)), items, 3), 0
    for _ in range(40):
        parts = [items[k] for k in rng.integers(0, 40, 2)]
        text = b" ".join(w for p in parts for w in p.split()[: int(rng.integers(3, 20))])
        every = {k: (share, n) for k, share, n in decontam.matches(block, text)}
        some = {k: (share, n) for k, share, n in decontam.matches(block, text, 0.6)}
        assert some.items() <= every.items() and {k for k, (s, _) in every.items() if s >= 0.6} <= some.keys()
        assert max((s for s, _ in every.values()), default=0) == max((s for s, _ in some.values()), default=0)
        left_out += len(every) - len(some)
    assert left_out


def test_query_flags_exactly_the_documents_with_whole_items(spark, sf_dir, tables):
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, sf_dir).collect()}
    items = {i: decontam.words_of(t.encode()) for i, t in tables.sql("SELECT item_id, text FROM benchmark").fetchall()}
    held = {}
    for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        text = b" " + b" ".join(decontam.words_of((t or "").encode())) + b" "
        held[i] = {k for k, w in items.items() if b" " + b" ".join(w) + b" " in text}
    assert got.keys() == held.keys() and any(held.values())
    for i, k in held.items():
        assert got[i].contaminated == (got[i].best_coverage >= decontam.COVERAGE)
        if k:
            assert got[i].best_coverage == 1 and k <= {int(x) for x in got[i].item_ids.split(",")}


def test_reordered_and_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x"), (9, "", "x"), (None, "too short", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "Intro. " + " ".join(w[8:]).upper() + "! And then: " + ", ".join(w[:8])), (2, None), (3, ""), (4, " ".join(w[:6])),
            (5, "word " * 100_000 + item), (6, " ".join(w[k] for k in (0, 2, 4, 6, 8, 10, 12, 14, 1, 3, 5, 7, 9, 11, 13, 15))), (1, item), (None, item)]
    docs = spark.createDataFrame([(i, t, "a", 1.5) for i, t in rows], "doc_id long, text string, item_id string, best_coverage double")
    found = decontam.find(docs, bench).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.contaminated} == {1, 5, None}
    assert all(r.n_items == 2 and [x.item_id for x in r["items"]] == [7, 7] for r in found if r.contaminated)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontam.find(docs.limit(0), bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_of_the_benchmark_change_nothing(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontam.find(docs, bench).orderBy("doc_id").collect()
    assert decontam.find(docs, bench, block_bytes=4000).orderBy("doc_id").collect() == whole


def words(text):
    """Runs of letters, marks and numbers, one character after the other."""
    out = [""]
    for c in unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()):
        if unicodedata.category(c)[0] in "LMN":
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def test_words_of_any_script_without_case_and_punctuation():
    every = "".join(chr(c) + (" x" if c % 3 else "") for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not decontam.unspaced(c))
    for text in ("Ça\u00a0va\u2014“ÉTÉ”, l’ÂGE_d’or… STRASSE Straße", "ΟΔΟΣ οδος", "हिन्दी \U0001d538\U00010400x", "e\u0301te\u0301", "a-b_C 1", every):
        assert [w.decode() for w in decontam.words_of(text.encode())] == words(text)
    assert decontam.words_of(b"a\xffB") == [b"a", b"b"] and decontam.words_of(None) == []


def test_upper_case_and_other_punctuation_hide_no_item(spark, tables):
    items = dict(tables.sql("SELECT item_id, text FROM benchmark").fetchall())
    item = max(items.values(), key=lambda t: sum(not c.isascii() for c in t))
    assert not item.isascii() and len(words(item)) >= decontam.SEED_WORDS
    forms = [item.upper(), "“" + item.replace(" ", "\u00a0") + "”", item.replace(" ", "\u2014"), unicodedata.normalize("NFD", item.upper())]
    docs = spark.createDataFrame([(k, "Vor: " + t + " – danach") for k, t in enumerate(forms)] + [(9, "Vor: danach")], "doc_id long, text string")
    found = decontam.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.best_coverage for r in found} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 9: 0.0}


def test_query_finds_every_whole_item_by_the_plain_words(spark, sf_dir, tables):
    items = {i: " " + " ".join(words(t)) + " " for i, t in tables.sql("SELECT item_id, text FROM benchmark").fetchall()}
    got = {r.doc_id: set(r.item_ids.split(",")) for r in queries.op5_decontamination(spark, sf_dir).collect()}
    for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        text = " " + " ".join(words(t or "")) + " "
        assert {str(k) for k, w in items.items() if w in text} <= got[i]


def test_unspaced_scripts_and_short_items(spark):
    cases = {1: ("我们今天讨论机器学习模型的评测数据泄漏问题", "前言里写道我们今天讨论机器学习模型的评测数据泄漏问题然后结束"),
             2: ("これは評価用の文章なので学習に使わないでください", "序文。これは評価用の文章なので学習に使わないでください終わり"),
             3: ("ประโยคนี้ใช้สำหรับทดสอบเท่านั้น", "คำนำประโยคนี้ใช้สำหรับทดสอบเท่านั้นจบ"),
             4: ("Zwei Wörter", "es sind nur ZWEI WÖRTER hier"), 5: ("Einzelwort", "ein einzelwort!"), 6: ("数据", "大数据库")}
    bench = spark.createDataFrame([(k, item) for k, (item, _) in cases.items()] + [(7, "?!"), (8, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, text) for k, (_, text) in cases.items()] + [(9, "zwei andere wörter"), (10, "数 a 据"), (11, "Einzelworte")],
                                 "doc_id long, text string")
    found = decontam.find(docs, bench).collect()
    assert {r.doc_id: {x.item_id for x in r["items"] if x.coverage == 1} - ({6} if r.doc_id == 1 else set()) for r in found} == {
        **{k: {k} for k in cases}, 9: set(), 10: set(), 11: set()}
    assert [w.decode() for w in decontam.words_of("กำลัง abc漢字x".encode())] == ["กำ"[:1], "กำ"[1:], "ลั", "ง", "abc", "漢", "字", "x"]


def test_several_blocks_are_held_one_at_a_time(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(30)]
    rows = [(1, items[3][1] + " zz " + items[20][1]), (1, items[3][1]), (2, None), (None, items[7][1].upper()), (4, "w3x0 w3x1 w3x2 w3x3"), (5, "")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    live, most, built = set(), 0, 0
    make, destroy = type(spark.sparkContext).broadcast, decontam.Broadcast.destroy

    def made(context, value):
        nonlocal most, built
        out = make(context, value)
        if isinstance(value, decontam.Block):
            live.add(id(out))
            most, built = max(most, len(live)), built + 1
        return out

    def ended(self, *args):
        live.discard(id(self))
        return destroy(self, *args)

    def plain(found):
        return sorted(str((r.doc_id, r.best_coverage, [tuple(x) for x in r["items"]])) for r in found.collect())

    want = plain(decontam.find(docs, bench))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", made)
    monkeypatch.setattr(decontam.Broadcast, "destroy", ended)
    found = decontam.find(docs, bench, block_bytes=800)
    assert plain(found) == want and len(want) == 7 and built > 3 and most == 1
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(str(r.doc_id) for r in decontam.clean(docs, bench, block_bytes=800).collect()) == ["2", "4", "5"]
