import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import pii


def brute(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(found)]


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.scan(text) if s.kind in pii.BASE_KINDS]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.1290+- ()%b", max_size=60))
def test_base_spans_like_the_patterns(text):
    assert base(text) == brute(text)


def test_known_spans():
    text = "mail é.a.b@x.example.com ip 10.0.0.256 and 1.2.3.4.5.6.7.8 card 4111-1111 1111 1111 call +1 (555) 010-9999"
    assert base(text) == brute(text)
    assert [k for k, _, _ in base(text)] == ["email", "ip", "ip", "card", "phone"]


def test_what_the_method_adds():
    assert [s.kind for s in pii.scan("IBAN DE89 3704 0044 0532 0130 00 .")] == ["iban"]
    assert pii.scan("DE88 3704 0044 0532 0130 00 .") == []  # mod 97 fails
    assert [s.kind for s in pii.scan("my SSN is 123-45-6789")] == ["ssn"]
    assert pii.scan("part 123-45-6789") == []  # no context
    near, far = (pii.scan(t)[0].score for t in ("email: a@b.co", "see a@b.co"))
    assert near > far


def test_ibans_before_other_capitals():
    german = "DE89 3704 0044 0532 0130 00"
    spans = lambda text: [text[s.start : s.end] for s in pii.scan(text) if s.kind == "iban"]
    for behind in ("", " BIC COBADEFF", " EUR", " A note", " 12 EUR", "EUR", " Bank", ", BIC X"):
        assert spans(f"pay {german}{behind}") == [german]
    assert spans(f"{german} GB29 NWBK 6016 1331 9268 19 EUR") == [german, "GB29 NWBK 6016 1331 9268 19"]
    assert spans(f"REF AB12 0000 {german} BIC COBADEFF") == [german]
    check = next(f"{k:02}" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}12345678901234"))
    assert spans(f"ZZ{check} 1234 5678 9012 34 EUR") == [f"ZZ{check} 1234 5678 9012 34"]  # no length known
    assert pii.redact(f"to {german} EUR", pii.scan(f"to {german} EUR")) == "to [IBAN] EUR"
    assert spans("DE88 3704 0044 0532 0130 00 EUR") == []


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "a@" * 50_000):
        pii.scan(text)


def test_redaction():
    text = "write a@b.co or +1 555 010 9999 now"
    assert pii.redact(text, pii.scan(text)) == "write [EMAIL] or [PHONE] now"
    assert pii.redact(None, []) is None


def test_table(docs):
    rows = [(1, "a@b.co"), (2, None), (3, ""), (4, "a@b.co"), (4, "a@b.co"), (5, "x " * 50_000 + "9.9.9.9")]
    out = {r["doc_id"]: r for r in pii.report(docs(rows)).collect()}
    assert out[1]["spans"] == out[4]["spans"] == "email:0:6" and out[5]["n_ip"] == 1 and out[5]["spans"] == "ip:100000:100007"
    assert out[2]["spans"] == out[3]["spans"] == "" and out[2]["base_sha256"] == out[3]["base_sha256"]
    assert pii.report(docs([])).count() == 0
