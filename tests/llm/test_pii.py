import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantspark.llm import pii
from tests.llm import plain
from tests.llm.conftest import EDGES, prose

CARD = "4539 1488 0343 6467"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@+- ()09:%\n", max_size=60))
def test_base_patterns(text):
    assert pii.detect(text) == plain.personal(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "1.2.3.4", "300.1.1.1", CARD, "+1 (555) 010-9999", " ", ".", "@", "-", "x", "0", "+"]), max_size=12))
def test_base_patterns_of_pieces(parts):
    text = "".join(parts)
    assert pii.detect(text) == plain.personal(text)


def found(text):
    base = pii.detect(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.disguised(text, base)]


def test_disguises():
    assert found("mail jane (at) example [dot] com now") == [("email", "jane (at) example [dot] com")]
    assert found("mail jane at example dot org now") == [("email", "jane at example dot org")]
    assert found("mail john dot smith at mail dot example dot com, please") == [("email", "john dot smith at mail dot example dot com")]
    assert found("mail jane@example dot com now") == [("email", "jane@example dot com")]
    assert found("host 10 dot 0 dot 0 dot 7 is up") == [("ip", "10 dot 0 dot 0 dot 7")]
    assert found("host 10[dot]0[dot]0[dot]7 is up") == [("ip", "10[dot]0[dot]0[dot]7")]
    assert found("ask bоb@exаmple.com") == [("email", "bоb@exаmple.com")]
    assert found("ｂob＠example．com!") == [("email", "ｂob＠example．com")]
    assert found("call plus one five five five zero one zero nine nine nine nine please") == [("phone", "plus one five five five zero one zero nine nine nine nine")]
    assert found("host one nine two dot one six eight dot one dot seven up") == [("ip", "one nine two dot one six eight dot one dot seven")]
    assert found("pay ４５３９ 1488 0343 6467 now") == [("card", "４５３９ 1488 0343 6467")]
    assert found("ring +1 555​ 010 9999.") == [("phone", "+1 555​ 010 9999")]


def test_clean_text_has_none():
    for text in ("look at the dot on the i", "one two three", "we met at noon. The end (at last)", prose(1, 300), "trois un deux", "Жук и ёж", "point par point"):
        assert not pii.detect(text) and not found(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "one " * 50_000, "( at ) " * 30_000, "1 " * 100_000, "a dot " * 40_000, "@a dot " * 40_000, "a at b dot com " * 20_000, "a [at] b.c " + "x dot " * 60_000):
        pii.disguised(text, pii.detect(text))


def test_frame(docs):
    rows = [*EDGES, (30, f"a@b.co {CARD}; 10.0.0.1; +1 555 010 9999 x (at) y (dot) z")]
    got = {(r.doc_id, i): r for i, r in enumerate(pii.find_personal_data(docs(rows)).collect())}
    assert len(got) == len(rows)
    last = next(r for (d, _), r in got.items() if d == 30)
    assert [s.kind for s in last.base_spans] == ["email", "card", "ip", "phone"]
    assert [s.kind for s in last.spans] == ["email", "card", "ip", "phone", "email"]
    assert all(not r.spans for (d, _), r in got.items() if d != 30)
    assert pii.find_personal_data(docs([])).count() == 0


def test_mixed_disguises():
    """Spelled and plain digits, with @ and dots written out in any way, in one number or address."""
    for kind, span in (
        ("phone", "+1 555 010 99 nine nine"),
        ("phone", "plus one 5 five 5 zero 1 zero 9 nine 9 nine"),
        ("ip", "10 dot 0 dot zero dot seven"),
        ("ip", "one nine two [dot] one six eight [dot] one [dot] seven"),
        ("ip", "１０ dot 0 (dot) zero [.] seven"),
        ("card", "4539 1488 0343 six 4 6 7"),
        ("phone", "+1 (five five five) 010 9999"),
        ("email", "jane at example.com"),
        ("email", "jane at mail.example dot com"),
        ("email", "jane at one two three dot com"),
        ("email", "jаne (at) eight [dot] org"),
        ("email", "bob@example.cоm"),
    ):
        assert found(f"so {span}, please") == [(kind, span)], span
    assert found("bob@example.co dot uk") == [("email", "bob@example.co dot uk")]
    assert not found("nine@example.com has one dot") and not found("one of the 2019 papers, two of 1,500")


def test_mixed_runs_take_linear_time():
    for text in ("1 " * 100_000 + "x one", "one (" * 50_000, "a at b." * 40_000, "one dot " * 40_000, "+ one " * 50_000, "one [dot] " * 30_000, "bob@a.cо " * 20_000):
        pii.disguised(text, pii.detect(text))


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \t"])
def test_long_runs_of_blanks_are_linear(blank):
    gap = blank * (1_000_000 // len(blank))
    for text in (f"( dot at x{gap}jane (at) mail (dot) org", f"jane [at] mail{gap}[dot] org{gap}( dot", f"dot ({gap}at{gap})"):
        start = time.perf_counter()
        pii.disguised(text, [])
        assert time.perf_counter() - start < 2
    near = blank * 30
    found = pii.disguised(f"write to jane{near}[at]{near}mail{near}[dot]{near}org now", [])
    assert [(s, e) for s, _, e in found] == [(9, 9 + len(f"jane{near}[at]{near}mail{near}[dot]{near}org"))]
