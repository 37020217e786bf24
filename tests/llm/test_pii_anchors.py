import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kalendarium.llm import pii_anchors
from tests.llm.tables import documents, odd_rows


def doubled(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and doubled(digits):
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def base(text):
    return [s for s in pii_anchors.find_spans(text) if s[0] in ("email", "ip", "card", "phone")]


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="a1.@ -+()%é٣9/:", max_size=60))
def test_like_plain_patterns(text):
    assert base(text) == brute(text)


def test_pieces_like_plain_patterns():
    draw = random.Random(9)
    pieces = ["me@host.de", "a.b+c%d@x-y.co.uk", "@", "x@y", "..", "10.0.0.1", "256.1.2.3", "1.2.3.4.5.6.7.8.9", "0010.000255.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+49 (5241) 123-456", "+1", "+44 20 7946 0958 1", " ", "-", ".", "7", "http://a.b/c?d=1", "IBAN DE89 3704 0044 0532 0130 00", "account number: 12345678", "é", "\n"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(9)))
        assert base(text) == brute(text), repr(text)


def test_added_kinds():
    kinds = lambda text: [(k, text[a:b]) for k, a, b in pii_anchors.find_spans(text) if k in ("url", "iban", "account")]
    assert kinds("see https://x.de/a?b=c> or") == [("url", "https://x.de/a?b=c")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("account number: 12345678, Konto 12") == [("account", "12345678")]
    assert kinds("İ HTTPS://X.de/A ACCOUNT NO. 123456 Iban DE89370400440532013000") == [("url", "HTTPS://X.de/A"), ("account", "123456"), ("iban", "DE89370400440532013000")]


def test_odd_rows(spark):
    rows = odd_rows() + [(30, "\U0001f600 mail me@host.de")] * 2
    df = pii_anchors.find_personal_data(documents(spark, rows))
    base_of = lambda r: tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("email", "ip", "card", "phone"))
    assert sorted((r["doc_id"] or 0, base_of(r)) for r in df.collect()) == sorted((d[0] or 0, tuple(brute(d[1] or ""))) for d in rows)
    assert pii_anchors.find_personal_data(documents(spark, [])).collect() == []
