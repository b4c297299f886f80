"""Personal numbers, dates and mail addresses as keyed pseudonyms of the same format, by DataFrame functions alone.

Each kind is recognised by form, validated (Luhn, mod 97, calendar, number plans) and permuted within its valid
values by a Feistel network whose round function is SHA-256 over key, kind, round and the other half. A permutation:
different values keep different pseudonyms, and a value has the same one in every document.

    card        13 to 19 digits, Luhn        first digit stays, check digit made anew
    iban        mod 97                       letters stay, check digits made anew
    ssn         ddd-dd-dddd in valid ranges  stays in them
    phone       North American plan          area and exchange from 200 on; +country code stays
                +country code, other plans   digits after the country code
    ip          four numbers up to 255       over all addresses
    date        1900 to 2099                 yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, mm/dd/yyyy (if only that is valid)
    mail        name@domain                  letters and digits of the name within their kind

What has the form and isn't valid stays as it is. Digits and capitals next to a value may have the form together with
it; so a match that isn't valid as a whole is searched for valid parts from one separator to another: first IBANs of
their country's length and cards of an issuer's prefix and length in its groups, then dates, SSNs and phones, then
other cards, the longest first. Parts don't overlap, and what lies between them stays.

Scale: a projection; no shuffle, no state. Texts without a match pass after one search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import unused

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FORMS = {
    "mail": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "card": r"(?<![\w.+])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w+.])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,5}|\+[0-9]{8,15})(?!\w)",
}
#: A further number of a run, unless an address or a date starts with it.
NEXT = r"[0-9]+(?!\w|[./][0-9]{1,3}[./][0-9]|[.%+-]*[\w.%+-]*@)"
#: IBANs, cards and other plans' phones are searched as runs: with all numbers that follow, so that no value is cut by the end of a match.
RUNS = FORMS | {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]|[\w.%+-]*@|[./][0-9]{1,3}[./][0-9])(?:[ -]" + NEXT + ")*+",
    "card": r"(?<![\w.+])(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:[ -]" + NEXT + r")*+(?!\w)",
    "phone": FORMS["phone"].replace("{2,8}){1,5}", r"{2,8}(?!\w|[./][0-9]{1,3}[./][0-9])){1,5}+(?:[ -]" + NEXT + ")*+"),
}
KINDS = ("mail", "iban", "date", "ssn", "ip", "card", "phone")
#: One search for all kinds; a match starts with a letter, digit, plus or bracket after none of its own kind.
ANY = "|".join(f"(?:{RUNS[kind]})" for kind in KINDS)
#: A part of a match with the characters around it, if any: a value from one separator to another.
PART = "^[ .-]?(?:" + "|".join(f"(?:{FORMS[kind]})" for kind in KINDS) + ")[ .-]?$"
#: Separators that a part has at most: 13 to 19 digits one by one.
MOST_TOKENS = 19
#: Prefixes and lengths of issuers.
ISSUED = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7]|35)[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|6[0-9]{15,18})$"
#: A card's groups as printed, in a part with the characters around it: no other separator next to them.
GROUPED = r"^ ?(?:[0-9]+|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,4}(?: [0-9]{3})?|[0-9]{4} [0-9]{6} [0-9]{4,5}) ?$|^[ -]?(?:[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,4}(?:-[0-9]{3})?|[0-9]{4}-[0-9]{6}-[0-9]{4,5})[ -]?$"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _bound(value: Column, to) -> Column:
    """to(value) with value computed once and named, which keeps expressions small."""
    return F.element_at(F.transform(F.array(value), to), 1)


def _hash(key: str, kind: str, turn: Column, *over: Column) -> Column:
    """60 keyed bits."""
    joined = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *[c.cast("string") for c in over])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint")


def feistel_pair(key: str, kind: str, a: Column, b: Column, of_a: int, of_b: int) -> Column:
    """A permutation of the pairs of a below of_a and b below of_b, as struct<a, b>."""
    turn = lambda s, r: F.when(
        r % 2 == 0,
        F.struct(((s["a"] + _hash(key, kind, r, s["b"]) % of_a) % of_a).alias("a"), s["b"].alias("b")),
    ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + _hash(key, kind, r, s["a"]) % of_b) % of_b).alias("b")))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def feistel_text(key: str, kind: str, text: Column) -> Column:
    """A permutation of texts of the same pattern: digits, lower and upper letters change within their own, the rest stays."""

    def moved(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            out = c
            for alphabet in (DIGITS, LOWER, UPPER):
                at = F.instr(F.lit(alphabet), c)
                to = (at - 1 + _hash(key, kind, r, other, k) % len(alphabet)) % len(alphabet) + 1
                out = F.when(at > 0, F.substr(F.lit(alphabet), to.cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    cut = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1).alias("b"))
    turn = lambda s, r: F.when(r % 2 == 0, F.struct(moved(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], r).alias("b")))
    done = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), halves, turn)
    return _bound(done, lambda x: F.concat(x["a"], x["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced by others, in order."""
    at = lambda k: F.length(_digits(F.substr(form, F.lit(1), k + 1)))
    put = lambda d: F.transform(F.split(form, ""), lambda c, k: F.when(c.rlike("^[0-9]$"), F.substr(d, at(k), F.lit(1))).otherwise(c))
    return _bound(digits, lambda d: F.array_join(put(d), ""))


def _int(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start, size).cast("bigint")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counting once."""
    last = F.length(digits) - 1

    def value(c: Column, k: Column) -> Column:
        d = c.cast("int")
        return F.when((last - k) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, v: s + v)


def mod97(text: Column) -> Column:
    """Letters as 10 to 35, the whole as a decimal number, modulo 97."""

    def step(s: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, (s * 100 + letter + 9) % 97).otherwise((s * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(key: str, m: Column) -> Column:
    check = lambda body: (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    body = lambda d: F.concat(F.substring(d, 1, 1), feistel_text(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
    made = lambda d: _bound(body(d), lambda b: F.concat(b, check(b).cast("string")))
    return _bound(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _refill(m, made(d))))


def _iban(key: str, m: Column) -> Column:
    def made(plain: Column) -> Column:
        country, bank = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
        valid = mod97(F.concat(bank, F.substring(plain, 1, 4))) == 1
        check = lambda new: F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        new = _bound(_refill(bank, feistel_text(key, "iban", _digits(bank))), lambda new: _refill(m, F.concat(check(new), _digits(new))))
        return F.when(valid & bank.rlike("[0-9]"), new)

    return _bound(F.replace(m, F.lit(" "), F.lit("")), made)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = _int(m, 1, 3), _int(m, 5, 2), _int(m, 8, 4)
    new = feistel_pair(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    number = _bound(new, lambda x: F.format_string("%03d-%02d-%04d", F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1), F.floor(x["b"] / 9999) + 1, x["b"] % 9999 + 1))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), number)


def _phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1)
    digits = _digits(m)
    rest = F.substr(digits, F.length(code) + 1)
    plan = (F.length(rest) == 10) & code.isin("", "1") & (_int(rest, 1, 3) >= 200) & (_int(rest, 4, 3) >= 200)
    new = feistel_pair(key, "phone", _int(rest, 1, 3) - 200, (_int(rest, 4, 3) - 200) * 10000 + _int(rest, 7, 4), 800, 8_000_000)
    number = _bound(new, lambda x: F.format_string("%03d%03d%04d", x["a"] + 200, F.floor(x["b"] / 10000) + 200, x["b"] % 10000))
    other = F.when(m.startswith("+") & F.length(digits).between(8, 15), _refill(m, F.concat(code, feistel_text(key, "phone+", rest))))
    return F.when(plan, _refill(m, F.concat(code, number))).otherwise(other)


def _ip(key: str, m: Column) -> Column:
    part = [F.element_at(F.split(m, r"\."), k + 1).cast("bigint") for k in range(4)]
    valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
    new = feistel_pair(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536)
    return F.when(valid, _bound(new, lambda x: F.format_string("%d.%d.%d.%d", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)))


def _late_days() -> list[str]:
    """mmdd of the days that can't be months: from the 13th on, without February 29th. 221 of them."""
    size = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return [f"{m + 1:02d}{d:02d}" for m in range(12) for d in range(13, size[m] + 1)]


def _date(key: str, m: Column) -> Column:
    iso = m.substr(5, 1) == "-"
    year = F.when(iso, _int(m, 1, 4)).otherwise(_int(m, 7, 4))
    first, second = F.when(iso, _int(m, 9, 2)).otherwise(_int(m, 1, 2)), F.when(iso, _int(m, 6, 2)).otherwise(_int(m, 4, 2))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    months = F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))

    def valid(day: Column, month: Column) -> Column:
        most = F.try_element_at(months, F.greatest(month, F.lit(1)).cast("int")) + F.when(leap & (month == 2), 1).otherwise(0)
        return F.coalesce((month >= 1) & (day >= 1) & (day <= most), F.lit(False))

    # 1900-01-01 to 2099-12-31 are 73,049 = 17 * 4,297 days.
    known = F.to_date(F.format_string("%04d-%02d-%02d", year, second, first))
    days = F.datediff(known, F.lit("1900-01-01").cast("date"))
    new = feistel_pair(key, "date", F.floor(days / 4297), days % 4297, 17, 4297)
    day = _bound(new, lambda x: F.date_add(F.lit("1900-01-01").cast("date"), (x["a"] * 4297 + x["b"]).cast("int")))
    mark = m.substr(3, 1)
    written = _bound(day, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).when(mark == ".", F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "dd/MM/yyyy")))
    # Month first: 221 days that can only be read so in each of 200 years, and February 29th of 49 = 7 * 7 leap years.
    late = F.array(*map(F.lit, _late_days()))
    slot = F.array_position(late, F.format_string("%02d%02d", first, second)) - 1
    apart = feistel_pair(key, "month first", year - 1900, slot, 200, 221)
    found = lambda x: F.try_element_at(late, (x["b"] + 1).cast("int"))
    plain = _bound(apart, lambda x: F.format_string("%s/%s/%04d", F.substring(found(x), 1, 2), F.substring(found(x), 3, 2), x["a"] + 1900))
    step = F.floor((year - 1904) / 4)
    leaps = feistel_pair(key, "leap day", F.floor(step / 7), step % 7, 7, 7)
    leap_day = _bound(leaps, lambda x: F.format_string("02/29/%04d", 1904 + 4 * (7 * x["a"] + x["b"])))
    return F.when(valid(first, second), written).when((mark == "/") & valid(second, first), F.when((first == 2) & (second == 29), leap_day).otherwise(plain))


def _mail(key: str, m: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(key, "mail", name), F.substr(m, F.length(name) + 1))


def pseudonym(key: str, match: Column) -> Column:
    """The pseudonym of a match of ANY or a part of one; null if it isn't valid as a whole."""
    whole = lambda kind: match.rlike(f"^(?:{FORMS[kind]})$")
    return (
        F.when(F.contains(match, F.lit("@")), _mail(key, match))
        .when(match.rlike("^[A-Z]{2}"), F.when(whole("iban"), _iban(key, match)))
        .when(whole("date"), _date(key, match))
        .when(whole("ssn"), _ssn(key, match))
        .when(whole("ip"), _ip(key, match))
        .when(whole("card"), F.coalesce(_card(key, match), F.when(whole("phone"), _phone(key, match))))
        .when(whole("phone"), _phone(key, match))
    )


def _spans(ch: Column, alone: Column) -> Column:
    """array<array<struct<s, e>>>: the first and last place of a match of characters ch, then of its parts from each separator to later ones."""
    size = F.size(ch)
    apart = lambda k: F.get(ch, k).isin(" ", ".", "-")
    places = F.sequence(F.lit(1), size)
    starts = F.filter(places, lambda k: (k == 1) | apart(k - 2))
    ends = F.filter(places, lambda k: (k == size) | apart(k))
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    fits = lambda x: (x["e"] - x["s"]).between(6, 44) & (x["e"] - x["s"] + 1 < size)
    # The k-th start goes with the k-th end and later ones.
    parts = _bound(ends, lambda ends: F.transform(starts, lambda s, k: F.filter(F.transform(F.slice(ends, k + 1, MOST_TOKENS), lambda e: span(s, e)), fits)))
    whole = F.array(F.array(span(F.lit(1), size)))
    return F.when(alone, whole).otherwise(F.concat(whole, parts))


def _judged(key: str, ch: Column, x: Column) -> Column:
    """struct<rank, short, s, e, p> for a span of a match; p is null if it isn't valid."""
    length = F.create_map(*[F.lit(v) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for v in (c, n)])
    all_of_it = x["e"] - x["s"] + 1 == F.size(ch)
    # A slice would copy the whole match.
    text = lambda s, e: F.array_join(F.transform(F.sequence(s, e), lambda k: F.get(ch, k - 1)), "")

    def ranked(part: Column, around: Column) -> Column:
        size = F.length(F.replace(part, F.lit(" "), F.lit("")))
        fits = ~part.rlike("^[A-Z]{2}") | (size == F.coalesce(F.try_element_at(length, F.substring(part, 1, 2)), size))
        card = part.rlike(f"^(?:{FORMS['card']})$")
        issued = _digits(part).rlike(ISSUED)
        rank = F.when(part.rlike("^[A-Z]{2}") | (card & issued & around.rlike(GROUPED)), 0).when(~card, 1).when(issued, 2).otherwise(3)
        p = F.when(all_of_it | (around.rlike(PART) & fits), pseudonym(key, part))
        return F.struct(rank.alias("rank"), (x["s"] - x["e"]).alias("short"), x["s"].alias("s"), x["e"].alias("e"), p.alias("p"))

    around = text(F.greatest(x["s"] - 1, F.lit(1)), F.least(x["e"] + 1, F.size(ch)))
    return _bound(F.struct(text(x["s"], x["e"]).alias("part"), around.alias("around")), lambda t: ranked(t["part"], t["around"]))


def _replaced(key: str, m: Column) -> Column:
    """struct<t, p> for a match of ANY: what takes its place, and the pseudonyms in it.

    A match is cut into characters once, so that a part costs what it is long and not what stands before it.
    """
    kind = "array<struct<rank:int,short:int,s:int,e:int,p:string>>"
    none = F.array().cast(kind)
    # Dates, SSNs, addresses and names of mail have no parts.
    alone = ~m.rlike("[ -]") | F.contains(m, F.lit("@")) | (F.length(m) <= 11)

    def found(ch: Column) -> Column:
        def step(found: Column, spans: Column) -> Column:
            # The whole match comes first; if it is valid, its parts aren't looked at.
            known = (F.size(found) > 0) & (F.element_at(found, 1)["short"] == 1 - F.size(ch))
            judged = F.filter(F.transform(spans, lambda x: _judged(key, ch, x)), lambda j: j["p"].isNotNull())
            return F.when(F.coalesce(known, F.lit(False)), found).otherwise(F.concat(found, judged))

        return F.array_sort(F.aggregate(_spans(ch, alone), none, step))

    apart = lambda taken, x: ~F.exists(taken, lambda t: (x["s"] <= t["e"]) & (t["s"] <= x["e"]))
    valid = _bound(F.split(m, ""), found)
    taken = F.aggregate(valid, none, lambda taken, x: F.when(apart(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    in_order = F.array_sort(F.transform(taken, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["p"].alias("p"))))

    def joined(parts: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(1).alias("at"))
        done = F.aggregate(parts, start, lambda r, x: F.struct(F.concat(r["t"], F.substr(m, r["at"], x["s"] - r["at"]), x["p"]).alias("t"), (x["e"] + 1).alias("at")), lambda r: F.concat(r["t"], F.substr(m, r["at"])))
        return F.struct(done.alias("t"), F.transform(parts, lambda x: x["p"]).alias("p"))

    return _bound(in_order, joined)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and n_replaced (bigint) and pseudonyms (array<string>, in order) added.

    A null text stays null with n_replaced 0. Columns other than `text` stay; ones named n_replaced or pseudonyms
    give way. Repeated rows and equal values give equal results everywhere.
    """
    # Every form has a digit or an @; a text without is not searched for forms.
    found, made = unused(docs.columns, "_m"), unused(docs.columns, "_p")
    matches = F.coalesce(F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))), F.array().cast("array<string>"))
    rows = docs.withColumn(found, matches)
    # With no match the row keeps its text: neither the split nor the pseudonyms are computed.
    rows = rows.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda m: _replaced(key, m))))
    between = F.split(F.col(text), ANY, -1)
    put = F.zip_with(F.col(made), F.slice(between, F.lit(2), F.size(found)), lambda p, rest: F.concat(p["t"], rest))
    whole = F.when(F.size(found) > 0, F.concat(F.element_at(between, 1), F.array_join(put, ""))).otherwise(F.col(text))
    valid = F.coalesce(F.flatten(F.transform(made, lambda p: p["p"])), F.array().cast("array<string>"))
    return rows.withColumn(text, whole).withColumn("pseudonyms", valid).withColumn("n_replaced", F.size("pseudonyms").cast("bigint")).drop(found, made)
