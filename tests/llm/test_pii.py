import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import pii

from . import helpers as H


@given(st.integers(1, 400), st.binary(min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_feistel_is_a_permutation(size, key):
    assert sorted(pii.feistel(x, size, key, b"t") for x in range(size)) == list(range(size))


TEXT = "Mail jo.doe7@mail2.example.com or call +1 (663) 555-6869; card 4539 1488 0343 6467, 4539148803436467! IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, host 192.168.7.12; born 1980-02-29, 31/12/1999, 12/31/1999, 05.06.2001. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""


def test_formats_and_checks_are_kept():
    p = pii.Pseudonyms(b"k")
    out, spans = p.rewrite(TEXT)
    assert len(spans) == 12
    shape = lambda s: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", s))
    for kind, a, b in spans:
        old = TEXT[a:b]
        new = p.of(kind, old)
        assert new in out and new != old and old not in out
        if kind not in ("ip", "secret", "iban"):
            assert shape(new) == shape(old)
        if kind == "card":
            d = re.sub(r"\D", "", new)
            assert pii.luhn_digit(d[:-1]) == int(d[-1])
        if kind == "iban":
            assert pii.iban_remainder(new.replace(" ", "")) == 1
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in new.split("."))
        if kind == "day":
            assert p.day(new)  # still a date
    # the same card with and without spaces stays linked
    assert re.sub(r"\D", "", p.of("card", "4539 1488 0343 6467")) == p.of("card", "4539148803436467")
    # different keys, different pseudonyms
    assert pii.Pseudonyms(b"other").rewrite(TEXT)[0] != out


def test_values_that_are_not_valid_stay():
    for s in ("4539148803436468", "32/13/2000", "2021-02-30", "999.1.1.1", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "1.2.3.4.5", "12345", "N = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "no@host"):
        assert pii.Pseudonyms(b"k").rewrite(s) == (s, [])


def test_phones_of_other_countries():
    p = pii.Pseudonyms(b"k")
    for s, stays in (("+49 30 1234567", "+49"), ("+33 6 12 34 56 78".replace(" 6 ", " 61 "), "+33"), ("+44 (20) 7946 0958", "+44"), ("+351 21 123 4567", "+351"), ("06 12 34 56 78", "0"), ("01.23.45.67.89", "0"), ("612 345 678", ""), ("912-345-678", ""), ("612 34 56 78", "")):
        out, spans = p.rewrite(f"call {s}, please")
        assert [k for k, *_ in spans] == ["abroad" if s[0] == "+" else "national"]
        new = out[5:].removesuffix(", please")
        assert new != s and new.startswith(stays) and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", s)
    # one number in two layouts stays linked, and valid
    a, b = p.national("612 345 678"), p.national("612 34 56 78")
    assert re.sub(" ", "", a) == re.sub(" ", "", b) and a[0] in "6789"
    assert len({p.national(f"06 12 34 {x // 100:02d} {x % 100:02d}") for x in range(2000)}) == 2000
    for s in ("+12", "+1 22 33", "+999999999999999999", "00 12 34 56 78", "512 345 678", "1.06.12.34.56.78"):
        assert p.rewrite(s) == (s, [])


def test_very_long_text():
    p = pii.Pseudonyms(b"k")
    out, spans = p.rewrite("12 word " * 100_000 + "jo.doe7@mail2.example.com" + " x" * 1000)
    assert len(spans) == 1 and out.startswith("12 word 12 word")


def test_values_behind_others_are_found():
    p = pii.Pseudonyms(b"k")
    out, spans = p.rewrite("72224148 663-555-6869 4539148803436467 4539148803436467 256.1.1.1 10.0.0.1")
    assert [k for k, *_ in spans] == ["phone", "card", "card", "ip"]
    assert out.split()[2] == out.split()[3]


def test_different_values_stay_different():
    p = pii.Pseudonyms(b"k")
    cards = {p.phone(f"(555) 123-{x:04d}") for x in range(2000)}
    assert len(cards) == 2000


def test_table(spark):
    rows = [(10, TEXT), (11, TEXT), *H.ODD]
    got = {r["doc_id"]: r for r in pii.pseudonymise(H.documents(spark, rows, extra=True)).collect() if r["doc_id"] is not None}
    assert got[10]["text"] == got[11]["text"] != TEXT
    assert got[1]["text"] is None and not got[1]["spans"] and got[2]["text"] == ""
    assert got[6]["text"] == dict(H.ODD)[6]
    kept = pii.pseudonymise_text(H.documents(spark, rows, extra=True))
    assert kept.columns == H.documents(spark, rows, extra=True).columns and kept.count() == len(rows)
    assert pii.pseudonymise(H.documents(spark, [])).count() == 0
