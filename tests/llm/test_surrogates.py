import re

from lodeweave.llm import surrogates as sg


def test_find_and_checks():
    text = 'Mail jo.24@mail4.example.com or +1 (990) 555-1864 190.137.223.204 card 4541241989961675, not 9807915762804490. token = "6a4589e4112292221d28c7e47303eee368e0b111" CC BY-NC 4.0 v3.0.1 Mrs Anna Smith'
    kinds = [(k, text[a:b]) for a, b, k, _ in sg.find(text)]
    assert kinds == [
        ("email", "jo.24@mail4.example.com"), ("phone", "+1 (990) 555-1864"), ("ip", "190.137.223.204"), ("card", "4541241989961675"),
        ("secret", "6a4589e4112292221d28c7e47303eee368e0b111"), ("name", "Anna Smith"),
    ]
    new, n = sg.rewrite(text, sg.KEY, {}, {})
    assert n == 6 and "9807915762804490" in new and "CC BY-NC 4.0 v3.0.1" in new
    for _, raw in kinds:
        assert raw not in new
    again = sg.find(new)
    assert [k for _, _, k, _ in again] == [k for k, _ in kinds]
    assert new.count("555-") == 1 and "@mail" not in new and re.search(r"\.example\.com", new)
    given = re.search(r"Mrs (\w+) (\w+)", new)[1]
    assert given in sg.GIVEN["latin", "f"]


def test_permutation_is_one_to_one():
    for fixed in ((), {0}):
        forms = [f"{k:03d}" for k in range(1000)]
        assert len({sg.permute(f, fixed, b"k", "t") for f in forms}) == 1000
    cards = [c for k in range(3000) for c in [f"400000000000{k:03d}"] if True]
    whole = [next(c + d for d in "0123456789" if sg._luhn(c + d) == 0) for c in cards]
    new = {sg.surrogate("card", c) for c in whole}
    assert len(new) == len(set(whole)) and all(sg._luhn(c) == 0 and c[0] == "4" for c in new)
    ips = {sg.surrogate("ip", f"10.0.{a}.{b}") for a in range(20) for b in range(256)}
    assert len(ips) == 20 * 256
    iban = "DE89370400440532013000"
    assert sg.canonical("iban", "DE89 3704 0044 0532 0130 00") == iban and sg._mod97(sg.surrogate("iban", iban)) == 1


def test_format_case_and_coreference():
    text = "A: +1 (826) 555-4081. B: +1-826-555-4081. C: MR JOHN DOE? Mr JOHN DOE, Mr John Doe; JO@X.COM jo@x.com"
    new, _ = sg.rewrite(text, sg.KEY, {}, {})
    digits = re.findall(r"\+1[ \-]\(?(\d{3})\)?[ \-]555-(\d{4})", new)
    assert len(digits) == 2 and digits[0] == digits[1]
    upper, title = re.search(r"Mr ([A-Z]+ [A-Z]+), Mr (\w+ \w+);", new).groups()
    assert upper == title.upper() and title.split()[0] in sg.GIVEN["latin", "m"]
    a, b = new.split("; ")[1].split()
    assert a.isupper() and a.lower() == b


def test_collisions_are_resolved(spark):
    names = [("name", f"m person{k} fam{k % 97}") for k in range(1500)]
    df = spark.createDataFrame(names + [("ssn", f"{k:09d}") for k in range(50)], "kind string, form string")
    rows = sg.assign(df).collect()
    assert len(rows) == 1550
    new = {(r["kind"], r["new"]) for r in rows}
    assert len(new) == 1550 and not new & {(r["kind"], r["form"]) for r in rows}


def test_documents_nulls_and_repeats(spark):
    names = [f"Mr Person{k} Fam{k}" for k in range(1200)]
    rows = [(k, f"{n} wrote to a{k}@b.org", "x") for k, n in enumerate(names)] + [(7, f"{names[5]} wrote", "y"), (7, f"{names[5]} wrote", "y"), (None, None, None), (None, "", None), (3, "nothing here\t ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_found string")
    got = sg.hide(df).collect()
    assert len(got) == len(rows)
    called = {}
    for r in got:
        if r["doc_id"] is not None and r["text"].endswith("org"):
            called[r["doc_id"]] = re.match(r"Mr (\w+ \w+) wrote", r["text"])[1]
            assert r["n_found"] == 2
    assert len(set(called.values())) == 1200
    assert [r["text"] for r in got if r["doc_id"] == 7 and r["text"].endswith("wrote")] == [f"Mr {called[5]} wrote"] * 2
    assert sorted(repr(r["text"]) for r in got if r["doc_id"] is None) == ["''", "None"]
    assert any(r["text"] == "nothing here\t " and r["n_found"] == 0 for r in got)
    kept = sg.hide_rows(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert sg.hide(df.limit(0)).count() == 0


def test_phones_and_addresses_in_other_forms():
    for raw in ("+33 6 12 34 56 78", "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "+7 495 123-45-67", "555 123 4567", "(555) 123 4567", "06 12 34 56 78"):
        new, n = sg.rewrite(f"call {raw}, please", sg.KEY, {}, {})
        assert n == 1 and raw not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {raw}, please")
    assert sg.canonical("phone", "+33 (0)1 23 45 67 89") == sg.canonical("phone", "+33123456789")
    for raw in ("2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "fe80::1"):
        new, n = sg.rewrite(f"from {raw}.", sg.KEY, {}, {})
        assert n == 1 and raw not in new and [k for _, _, k, _ in sg.find(new)] == ["ip6"]
    for text in ("at 12:30:45", "std::vector", "a::b", "::"):
        assert sg.rewrite(text, sg.KEY, {}, {}) == (text, 0)


def test_one_person_in_many_forms():
    text = "John Smith met Dr Jones. Mr J. Smith, Mr Smith, Dr Smith and Mr John Peter Smith are one; Smith's house, said John. Jones left."
    new, n = sg.rewrite(text, sg.KEY, {}, {})
    assert not re.search("John|Smith|Jones|Peter", new)
    given, family, other, initial, *rest = re.fullmatch(
        r"(\w+) (\w+) met Dr (\w+)\. Mr (\w)\. (\w+), Mr (\w+), Dr (\w+) and Mr (\w+) \w+ (\w+) are one; (\w+)'s house, said (\w+)\. (\w+) left\.", new
    ).groups()
    assert rest == [family, family, family, given, family, family, given, other] and initial == given[0] and other != family
