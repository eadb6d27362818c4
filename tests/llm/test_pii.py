"""PII: plain spans against the plain expressions, disguises, spans that map back."""

import hashlib
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from callqc.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    double = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in double) % 10 == 0


def plain(text):
    out = []
    for kind, expression in PLAIN.items():
        for m in re.finditer(expression, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.y", ".", "-", "1", "23", "255", "1.2.3.4", " ", "+", "+1 (23) 456-78-90", "4111111111111111",
                                 "4111 1111 1111 1111", "é", "%", "\n"]), max_size=14).map("".join))
def test_plain_spans(text):
    assert pii.identifiers(text) == plain(text)


def test_query(spark, sf_dir, tables):
    got = {r.doc_id: r for r in queries.op6_pii(spark, sf_dir).collect()}
    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        every = [x.split(":") for x in got[i].spans.split(",") if x]
        assert set(pii.listed(base).split(",")) <= {":".join(x) for x in every} | {""}
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in every) for k in pii.KINDS]


def found(text):
    base, added = pii.spans(text)
    return [text[a:b] for _, a, b in base], [(k, text[a:b]) for k, a, b in added]


def test_disguises():
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "4111111111111111")
    cyrillic = "j" + chr(0x43E) + "hn@ex" + chr(0x430) + "mple.com"
    cases = {
        "write eve [at] corp [dot] org now": ("email", "eve [at] corp [dot] org"),
        "carl dot k at mail dot example dot com, ok": ("email", "carl dot k at mail dot example dot com"),
        "bob(at)site.net!": ("email", "bob(at)site.net"),
        f"mail {cyrillic} ok": ("email", cyrillic),
        f"card {wide} é": ("card", wide),
        "call plus one nine eight eight five five five two four eight five ok": ("phone", "plus one nine eight eight five five five two four eight five"),
        "host one nine two dot one six eight dot zero dot one up": None,
        "host 192 dot 168 dot 0 dot 7 up": ("ip", "192 dot 168 dot 0 dot 7"),
        "four one one one one one one one one one one one one one one one": ("card", "four one one one one one one one one one one one one one one one"),
    }
    for text, span in cases.items():
        base, added = found(text)
        assert not base and (span is None or added == [span]), (text, base, added)


def test_base_spans_stay_and_clean_text_stays_clean():
    text = "x@y.zz and joe at y dot com"
    assert found(text) == (["x@y.zz"], [("email", "joe at y dot com")])
    for clean in ("we met at the house dot", "one two three, four", "look at dot matrix printers", "at nine one one dot", "dota at la dotación", "5 at 6 dot 7"):
        assert found(clean) == ([], []), clean
    assert pii.masked(text, [*pii.spans(text)[0], *pii.spans(text)[1]]) == "<email> and <email>"


def test_edge_cases(spark):
    long = "a" * 300_000 + " 1" * 200_000 + "@" * 1000 + "9" * 100_000
    rows = [(1, None), (2, ""), (3, long), (4, "a@b.c"), (4, "a@b.c"), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.report(pii.find(docs)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.spans for r in got}[4] == "email:0:5"
    assert {r.doc_id: r.n_ip for r in got}[None] == 1
    assert pii.report(pii.find(docs.limit(0))).count() == 0


def test_digits_and_marks_of_every_script():
    zeros = [c for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0]
    assert len(zeros) > 60
    for zero in zeros:
        def of(text, zero=zero):
            return "".join(chr(zero + int(c)) if c.isdigit() else c for c in text)

        for kind, text in (("card", "4111 1111 1111 1111"), ("phone", "+44 20 7946 0958"), ("ip", "192.168.0.7")):
            assert (kind, of(text)) in found(f"x {of(text)} y")[1], (hex(zero), kind)
    for text in ("eve\ufe6bcorp\ufe52org", "eve\uff20corp\uff0eorg"):
        assert found(f"x {text} y") == ([], [("email", text)])
    for c in map(chr, range(0x110000)):
        assert bool(pii._ALIKE.match(c)) == (c >= "\x80" and pii._plain(c) is not None)


def test_every_disguise_alone_is_found():
    mixed = "4" + " one 1" * 7 + " one"
    cases = {"jane at example.com": ("email", "jane at example.com"), "plus 442079460958": ("phone", "plus 442079460958"),
             "plus 44 20 7946 0958": ("phone", "plus 44 20 7946 0958"), "10dot0dot0dot7": ("ip", "10dot0dot0dot7"), mixed: ("card", mixed),
             "host 10 dot 0.0.7 up": ("ip", "10 dot 0.0.7"), "JANE@example DOT com": ("email", "JANE@example DOT com"),
             "bob { AT } site.net": ("email", "bob { AT } site.net")}
    for text, span in cases.items():
        assert span in found(text)[1], text


PIECES = ["jane", "site", "com", " ", " ", " at ", " AT ", " dot ", "dot", "Dot", ".", "@", "[at]", "( dot )", "{.}", "plus ", "PLUS", "one", "Four", "oh",
          "1", "44", "192", "0", "-", "--", "+", ",", "4 one 1 one 1", "é", "\u017fix"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_first_test_and_other_characters_change_no_span(text):
    base, added = pii.spans(text)
    assert added == pii.rewritten(text, base)
    assert pii.spans(text + " , \u2013") == (base, added)
