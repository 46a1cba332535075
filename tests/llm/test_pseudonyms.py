import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import pseudonyms as P
from tests.llm import cases

KEY = b"k" * 32


def masked(text, key=KEY):
    return P._masked(text, P.findings(text, key))


def kinds(text):
    return [k for _, _, k, _ in P.findings(text, KEY)]


def test_permutation_is_one_to_one():
    assert len({P.permute(f"{i:04d}", KEY, "t") for i in range(10_000)}) == 10_000
    assert len({P.permute(a + b, KEY, "t") for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"}) == 260


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("0123456789abcXYZé-. "), min_size=1, max_size=20))
def test_format_stays(value):
    out = P.permute(value, KEY, "t")
    assert [P._PLACE.get(c, (c,))[0] for c in out] == [P._PLACE.get(c, (c,))[0] for c in value]


def test_values_stay_linked_and_depend_on_the_key():
    a, b = masked("mail jo.do+x@corp.example.org now"), masked("(jo.do+x@corp.example.org)")
    new = re.search(r"\S+@corp\.example\.org", a)[0]
    assert new in b and "jo.do" not in a
    assert masked("call +1 (017) 555-7713") != masked("call +1 (017) 555-7713", b"x" * 32)


def test_validated_values_only():
    card = "4845168114407329"
    assert kinds(card) == ["card"] and kinds("9807915762804490") == []
    assert kinds(f"9807915762804490 {card} 7536784127813051") == ["card"]
    out = masked(card)
    assert out != card and P._luhn(out[:-1]) == int(out[-1])
    assert kinds("2024-02-30 31.02.2001 13/13/2001 999.1.1.1 000-12-3456 12:30 4.0 3.141592653589") == []
    day = masked("born 1999-12-31.")
    assert dt.date.fromisoformat(day[5:15]) and day != "born 1999-12-31."
    ip = masked("from 97.51.17.173,")
    assert max(map(int, re.findall(r"\d+", ip))) < 256 and ip != "from 97.51.17.173,"
    iban = masked("GB82 WEST 1234 5698 7654 32")
    plain = iban.replace(" ", "")
    assert plain[:2] == "GB" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert kinds("123-45-6789") == ["ssn"] and P._ssn_ok(masked("123-45-6789"))


def test_documents_against_the_plain_function(spark, small):
    import hashlib

    key = hashlib.blake2b(P.QUERY_KEY.encode()).digest()
    got = {r.doc_id: r for r in P.op6_feistel_pseudonyms(spark, small).collect()}
    for d, t in cases.texts(small):
        assert got[d].text == masked(t, key)
        for value in re.findall(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) 555-\d{4}", t):
            assert value not in got[d].text


def test_edge_rows(spark):
    docs = cases.docs(spark)
    out = P.mask(docs, key="secret")
    assert out.columns == docs.columns
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r[1] for r in cases.ROWS)))
    assert P.mask(cases.docs(spark, []), key="secret").count() == 0


def test_values_before_other_words_and_numbers():
    for value, kind, behind in (
        ("DE89370400440532013000", "iban", " EUR 50"),
        ("DE89 3704 0044 0532 0130 00", "iban", " BIC"),
        ("4111111111111111", "card", " 12/25"),
        ("4111 1111 1111 1111", "card", " 123"),
        ("+1 212 555 7713", "phone", " 42 times"),
        ("+1 (017) 555-7713", "phone", " 20"),
        ("+44 20 7946 0958", "phone", " 1234"),
    ):
        text = f"here {value}{behind}"
        assert P.findings(text, KEY)[0][:3] == (5, 5 + len(value), kind) and len(P.findings(text, KEY)) == 1
        assert masked(text) == f"here {masked(value)}{behind}" != text


def test_nothing_stands_for_itself():
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        assert all(P.permute(c, KEY, t) != c for c in alphabet for t in ("t", "u", "v"))
    assert all(P.permute(f"{i:03d}", KEY, "t") != f"{i:03d}" for i in range(1000))
    assert all(masked(f"a{c}@x.example.org") != f"a{c}@x.example.org" for c in "abcdefgh")
    days = [f"2001-03-{d:02d}" for d in range(1, 32)]
    assert len({masked(d) for d in days}) == 31 and all(masked(d) != d for d in days)


def test_dates_of_timestamps():
    out = masked("at 2024-01-15T10:00:00Z sharp")
    assert kinds("at 2024-01-15T10:00:00Z sharp") == ["date"] and out.endswith("T10:00:00Z sharp") and "2024-01-15" not in out
    assert kinds("2024-01-15Thing") == []


def test_a_key_is_needed(spark):
    docs = cases.docs(spark)
    import pytest

    with pytest.raises(ValueError):
        P.mask(docs)
    assert P.mask(docs, key="secret").count() == len(cases.ROWS)
    assert P.mask(cases.docs(spark, []), key="secret").count() == 0
