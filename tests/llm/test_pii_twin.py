"""Pseudonyms against the same networks in plain Python: the oracle of the query, which SQL can't say."""

from __future__ import annotations

import datetime
import hashlib
import re

from tracelode.llm import pii, queries

ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def keyed(key, kind, turn, *over):
    return int(hashlib.sha256("|".join([key, kind, str(turn), *map(str, over)]).encode()).hexdigest()[:15], 16)


def pair(key, kind, a, b, of_a, of_b):
    for turn in range(8):
        if turn % 2 == 0:
            a = (a + keyed(key, kind, turn, b) % of_a) % of_a
        else:
            b = (b + keyed(key, kind, turn, a) % of_b) % of_b
    return a, b


def text(key, kind, value):
    def moved(half, other, turn):
        out = ""
        for k, c in enumerate(half):
            for letters in ALPHABETS:
                if c in letters:
                    c = letters[(letters.index(c) + keyed(key, kind, turn, other, k) % len(letters)) % len(letters)]
                    break
            out += c
        return out

    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(8):
        a, b = (moved(a, b, turn), b) if turn % 2 == 0 else (a, moved(b, a, turn))
    return a + b


def refill(form, digits):
    left = iter(digits)
    return re.sub("[0-9]", lambda _: next(left), form)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))


def mod97(value):
    return int("".join(str(int(c, 36)) for c in value)) % 97


def card(key, m):
    d = re.sub(r"\D", "", m)
    body = d[0] + text(key, "card", d[1:-1])
    return refill(m, body + str(-luhn(body + "0") % 10))


def iban(key, m):
    plain = m.replace(" ", "")
    bank = refill(plain[4:], text(key, "iban", re.sub(r"\D", "", plain[4:])))
    check = 98 - mod97(bank + plain[:2] + "00")
    return refill(m, f"{check:02d}" + re.sub(r"\D", "", bank))


def ssn(key, m):
    area, group, serial = map(int, m.split("-"))
    a, b = pair(key, "ssn", area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + 2 if a >= 665 else a + 1:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def phone(key, m):
    d = re.sub(r"\D", "", m)
    code, rest = d[:-10], d[-10:]
    a, b = pair(key, "phone", int(rest[:3]) - 200, (int(rest[3:6]) - 200) * 10000 + int(rest[6:]), 800, 8_000_000)
    return refill(m, f"{code}{a + 200:03d}{b // 10000 + 200:03d}{b % 10000:04d}")


def address(key, m):
    p = list(map(int, m.split(".")))
    a, b = pair(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(key, m):
    form = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%d/%m/%Y"
    first = datetime.date(1900, 1, 1)
    a, b = pair(key, "date", *divmod((datetime.datetime.strptime(m, form).date() - first).days, 4297), 17, 4297)
    return (first + datetime.timedelta(days=a * 4297 + b)).strftime(form)


def mail(key, m):
    name, at, domain = m.partition("@")
    return text(key, "mail", name) + at + domain


CASES = {
    card: ["4366826422043230", "4366-8264-2204-3230", "378282246310005", "5555 5555 5555 4444"],
    iban: ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"],
    ssn: ["123-45-6789", "001-01-0001", "899-99-9999", "667-10-2000"],
    phone: ["366-555-9807", "(366) 555-9807", "+1 (366) 555-9807"],
    address: ["61.131.143.218", "0.0.0.0", "255.255.255.255"],
    date: ["2000-02-29", "31.12.1999", "01.01.1900", "31/12/2099", "05/06/1987"],
    mail: ["bo.42@mail8.example.com", "Ann_B+x@host.org", "q@a.bc"],
}


def test_each_kind_equals_plain_python(spark):
    rows = [(k, m, f"on {m} and {m}; ") for k, m in enumerate(m for listed in CASES.values() for m in listed)]
    wanted = [f(queries.PII_KEY, m) for f, listed in CASES.items() for m in listed]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id int, m string, text string"), queries.PII_KEY).orderBy("doc_id").collect()
    assert [r.text for r in got] == [f"on {w} and {w}; " for w in wanted]
    assert all(r.pseudonyms == [w, w] and r.n_replaced == 2 for r, w in zip(got, wanted))


def test_query_over_a_document_table(spark, tmp_path):
    """The registered query: every planted value in its pseudonym's place, all other text as it was, a long one too."""
    values = [(f, m) for f, listed in CASES.items() for m in listed]
    rows, wanted = [(90, None), (91, "")], {90: None, 91: ""}
    for k in range(40):
        chosen = [values[(5 * k + 3 * j) % len(values)] for j in range(k % 4)]
        filler = "; some words, more words; " * (30_000 if k == 3 else 2)
        rows.append((k, filler.join(["x", *(m for _, m in chosen), "y"])))
        wanted[k] = filler.join(["x", *(f(queries.PII_KEY, m) for f, m in chosen), "y"])
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op1_feistel_pseudonyms(spark, str(tmp_path)).collect()}
    assert got == wanted
