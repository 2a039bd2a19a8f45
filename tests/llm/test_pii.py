import hashlib
import random
import re


from cubelark.llm import pii


def brute(text):
    """The contract, read literally, with Python's engine."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def texts():
    rng = random.Random(5)
    yield from [None, "", "a@b.c", "x" * 3000, "1" * 2000, "a@b.c_d@e.f", "été 😀 a@b.co, 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
                "card 4111 1111 1111 1111 and 4111-1111-1111-1111-1 4111111111111111", "+1 (017) 555-7713 tel +12 +49 30 1234567890123456", "IBAN DE89 3704 0044 0532 0130 00 ok", "+" + "(" * 5000]
    for _ in range(300):
        yield "".join(rng.choice(["a", "B", "@", ".", "-", "_", "+", "1", "23", "4111111111111111", " ", "é", "(", ")", "255", "😀"]) for _ in range(rng.randrange(40)))


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text[:100], joined, found[i].spans)
        assert found[i].spans.startswith(joined)
        assert [found[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
    assert "iban:5:" in found[9].spans


def test_long_runs_stay_linear(spark):
    df = spark.createDataFrame([(1, "x" * 300_000 + " a@b.co"), (2, "1" * 300_000), (3, "1." * 100_000), (4, "+1" + "(" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(pii.find_pii(df)).collect()}
    assert got == {1: (1, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 25_000, 0, 0), 4: (0, 0, 0, 0)}


def test_redaction_and_edges(spark):
    df = spark.createDataFrame([(1, "write a@b.co now", "x"), (None, None, "y"), (3, "plain", None)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.text, r.row) for r in pii.redact(df).collect()}
    assert got == {1: ("write [EMAIL] now", "x"), None: (None, "y"), 3: ("plain", None)}
    assert pii.digest(pii.find_pii(df.limit(0))).count() == 0


def iban(country, rest):
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{country}{98 - int(number) % 97:02}{rest}"


def test_ibans_in_running_text(spark):
    de, gb, other = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", iban("QQ", "1234567890123456")
    assert de == iban("DE", de[4:])
    grouped = " ".join(de[i : i + 4] for i in range(0, len(de), 4))
    cases = []
    for one in (de, gb, grouped, other):
        for before in ("", "IBAN ", "AB12 ", "NR 2024 XY99 "):
            for after in ("", " BIC COBADEFFXXX", " Thanks", " EUR 50", " 2024", " BIC WESTGB2L", ". Then", " " + de, " A" * 40):
                weak = one == other and before != "IBAN "  # without a registered length a word must speak for it
                cases.append((f"{before}{one}{after}", [(len(before), len(before) + len(one))] * (not weak) + ([(len(before + one) + 1, len(before + one) + 1 + len(de))] if after == " " + de else [])))
    cases += [(x, []) for x in ("DE89370400440532013001 EUR 50", de + "x", "X" + de, de[:-1], "DE89 3704")]
    found = {r.doc_id: [(s["start"], s["end"]) for s in r.iban] for r in pii.find_pii(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(cases):
        assert found[i] == want, text
    df = spark.createDataFrame([(1, f"pay {gb} BIC WESTGB2L now")], "doc_id long, text string")
    assert pii.redact(df).first().text == "pay [IBAN] BIC WESTGB2L now"


def test_words_nearby_decide_on_weak_kinds(spark):
    filler = "x" * 60
    cases = {
        "My SSN is 123-45-6789.": [(10, 21)],
        "social security: 123-45-6789": [(17, 28)],
        "call 123-45-6789": [],
        "SSN order 123-45-6789": [],
        f"SSN {filler} 123-45-6789": [],
        "ssn 000-45-6789 666-45-6789 912-45-6789 123-00-6789 123-45-0000 123-45-67890 1-123-45-6789": [],
        "ssn 123-45-6789 and 899-45-6789": [(4, 15), (20, 31)],
    }
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert [(s["start"], s["end"]) for s in found[i].ssn] == want, text
    scores = {
        "IBAN DE89370400440532013000": 1.0,
        "DE89370400440532013000": 0.8,
        "example DE89370400440532013000": 0.6,
        f"IBAN {iban('QQ', '1234567890123456')}": 0.7,
        f"sample IBAN {iban('QQ', '1234567890123456')}": 0.5,
    }
    rows = spark.createDataFrame(list(enumerate(scores)), "doc_id long, text string")
    assert {r.doc_id: r.iban[0]["score"] for r in pii.find_pii(rows).collect()} == dict(enumerate(scores.values()))


def test_many_spans(spark):
    text = " ".join(f"a{i}@b.co" for i in range(200)) + " mail " + "é 1.2.3.4, " * 300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.digest(pii.find_pii(df)).first()
    assert got.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert pii.redact(df).first().text == re.sub(r"1\.2\.3\.4", "[IP]", re.sub(r"a\d+@b\.co", "[EMAIL]", text))


def test_clashing_names_and_empty_tables(spark):
    names = "doc_id long, text string, spans string, clean string, _spans string, __spans string, row string"
    df = spark.createDataFrame([(1, "a@b.co", "p", "q", "r", "s", "t"), (1, "a@b.co", "p", "q", "r", "s", "t")], names)
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "[EMAIL]", "p", "q", "r", "s", "t")] * 2
    assert pii.redact(df.limit(0)).count() == 0 and pii.redact(df).columns == df.columns
