"""Format-preserving Feistel pseudonyms of personal numbers and dates, in SQL expressions only.

Candidates found by pattern are validated (check digits, ranges, calendar).  A valid value is permuted
within its own format by eight rounds of a Feistel network whose round function is a keyed SHA-256, so the
same value gets the same pseudonym in every document and no two values share one.  Where the format has
rules (a Luhn digit, the ranges of a number, the calendar), check digits are computed anew and the
permutation is repeated until its result is valid again, which keeps it a permutation of the valid values.

Kinds: card numbers (Luhn), social security numbers, telephone numbers (with + or in national notation), IPv4
addresses, IBANs (mod 97, also in groups of four), dates from 1900 to 2099 in three notations, and the local part
of e-mail addresses.

Every place of a text is tried by every kind, and only valid values take up their text: a run of digits which
is no card hides no card that begins inside it.  For this a text is cut at blanks which no pattern spans; the
places of a part are those of its candidates, whatever overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Repetitions after which a walk to a valid value has ended but for a chance below 1e-20.
WALK = 128
_DAYS, _SIDE = 73049, 271  # days from 1900 to 2099; the square of the side is a little more

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(rf"(?:{'|'.join(names.split())})\d{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, names in IBAN_LENGTHS.items())

#: Places between two parts of a text which no pattern spans: behind white space, but for a blank between
#: digits, capitals and brackets.
CUT = r"(?<=[\t-\r])|(?<=[^A-Z0-9)] )|(?<= )(?=[^A-Z0-9(])"

#: Pattern of each kind, tried in this order at each place.
PATTERNS = {
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|\b\d{2}\.\d{2}\.\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "card": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b|\b\d{4}[ -]\d{6}[ -]\d{5}\b|\b\d{13,19}\b",
    "phone": (r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}\b|\+\d{1,3}(?<sep>[ .-])\d{3}\k<sep>\d{3}\k<sep>\d{4}\b|\+\d{8,15}\b|"
              r"(?<![\w)])\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\w.+-])(?:1-)?\d{3}-\d{3}-\d{4}\b(?!-)|(?<![\w.+-])\d{3}\.\d{3}\.\d{4}\b(?![.-]\d)"),
    "iban": rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_GROUPED})\b|\b[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}


def _sql(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _hash(key: str, kind: str, r: str, x: str) -> str:
    return f"sha2(concat({_sql(key + '/' + kind + '/')}, {r}, '/', {x}), 256)"


def _shift(x: str, h: str) -> str:
    """Move each digit, small and capital letter of ``x`` within its kind by a byte of the hash."""
    c, k = f"substr({x}, i, 1)", "cast(conv(substr(h, 2 * pmod(i - 1, 32) + 1, 2), 16, 10) as int)"
    moved = (f"case when {c} between '0' and '9' then cast(pmod(ascii({c}) - 48 + {k}, 10) as string) "
             f"when {c} between 'a' and 'z' then chr(97 + pmod(ascii({c}) - 97 + {k}, 26)) "
             f"when {c} between 'A' and 'Z' then chr(65 + pmod(ascii({c}) - 65 + {k}, 26)) else {c} end")
    return f"if({x} = '', '', {_let(h, 'h', f'''array_join(transform(sequence(1, length({x})), i -> {moved}), '')''')})"


def _permute(key: str, kind: str, x: str) -> str:
    """Permutation of the strings with the same kind of character at each place."""
    half = f"cast(ceil(length({x}) / 2) as int)"
    step = (f"if(r % 2 = 1, named_struct('a', {_shift('f.a', _hash(key, kind, 'r', 'f.b'))}, 'b', f.b), "
            f"named_struct('a', f.a, 'b', {_shift('f.b', _hash(key, kind, 'r', 'f.a'))}))")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({x}, 1, {half}), 'b', substr({x}, {half} + 1)), "
            f"(f, r) -> {step}, f -> concat(f.a, f.b))")


def _permute_pair(key: str, kind: str, a: str, b: str, side: int) -> str:
    """Permutation of pairs of numbers below ``side``, as a struct."""
    def part(x: str) -> str:
        return f"cast(conv(substr({_hash(key, kind, 'r', f'cast({x} as string)')}, 1, 8), 16, 10) as bigint)"

    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (f, r) -> "
            f"if(r % 2 = 1, named_struct('a', pmod(f.a + {part('f.b')}, {side}), 'b', f.b), "
            f"named_struct('a', f.a, 'b', pmod(f.b + {part('f.a')}, {side}))))")


def _walk(start: str, step: str, valid: str) -> str:
    """``step`` applied to x until ``valid`` holds for it."""
    return f"aggregate(sequence(1, {WALK}), {start}, (x, n) -> if({valid}, x, {step}))"


def _refill(m: str, digits: str, own: str = "[0-9]") -> str:
    """The text ``m`` with its digits, or what else matches ``own``, replaced one after the other."""
    return _let(digits, "d", f"array_join(transform(sequence(1, length({m})), j -> if(substr({m}, j, 1) rlike '{own}', "
                             f"substr(d, j - length(regexp_replace(substr({m}, 1, j), '{own}', '')), 1), substr({m}, j, 1))), '')")


def _mod97(x: str) -> str:
    v = f"substr({x}, i, 1)"
    return (f"aggregate(sequence(1, length({x})), 0, (s, i) -> if({v} between '0' and '9', (s * 10 + ascii({v}) - 48) % 97, "
            f"(s * 100 + ascii({v}) - 55) % 97))")


def _pseudonyms(key: str) -> dict[str, str]:
    """For each kind: the pseudonym of the candidate ``m``, null if it is not valid."""
    digits = "regexp_replace(m, '[^0-9]', '')"

    date = []
    for pattern, form in (("^[0-9]{4}-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), ("[.]", "dd.MM.yyyy")):
        pair = "x.a * {0} + x.b".format(_SIDE)
        start = _permute_pair(key, "date", f"datediff(t, date'1900-01-01') div {_SIDE}", f"datediff(t, date'1900-01-01') % {_SIDE}", _SIDE)
        moved = _walk(start, _permute_pair(key, "date", "x.a", "x.b", _SIDE), f"{pair} < {_DAYS}")
        day = _let(moved, "x", f"date_format(date_add(date'1900-01-01', cast({pair} as int)), '{form}')")
        date.append(f"when m rlike '{pattern}' then " + _let(
            f"try_to_date(m, '{form}')", "t", f"if(t between date'1900-01-01' and date'2099-12-31', {day}, null)"))

    good_ssn = ("substr({0}, 1, 3) not in ('000', '666') and substr({0}, 1, 1) <> '9' and substr({0}, 4, 2) <> '00' "
                "and substr({0}, 6) <> '0000'")
    ssn = _let(digits, "s", f"if({good_ssn.format('s')}, "
               f"{_refill('m', _walk(_permute(key, 'ssn', 's'), _permute(key, 'ssn', 'x'), good_ssn.format('x')))}, null)")

    octets = "transform(split(m, '[.]'), o -> cast(o as int))"
    address = _permute_pair(key, "ip", "q[0] * 256 + q[1]", "q[2] * 256 + q[3]", 65536)
    ip = _let(octets, "q", f"if(exists(q, o -> o > 255), null, {_let(address, 'f', '''concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)''')})")

    payload = _permute(key, "card", "substr(s, 1, length(s) - 1)")
    checked = _let(payload, "p", "concat(p, filter(transform(sequence(0, 9), c -> cast(c as string)), c -> luhn_check(concat(p, c)))[0])")
    card = _let(digits, "s", f"if(luhn_check(s), {_refill('m', checked)}, null)")

    # numbers of +1 and national ones: neither area nor exchange begins with 0 or 1
    good_phone = "(m rlike '^[+](?!1[ .(-])' or (substr({0}, 1, 1) >= '2' and substr({0}, 4, 1) >= '2'))"
    kept = "if(m rlike '[ .(-]', length(s) - 10, if(startswith(s, '1'), 1, 2))"
    national = f"substr(s, {kept} + 1)"
    moved = _walk(_permute(key, "phone", national), _permute(key, "phone", "x"), good_phone.format("x"))
    phone = _let(digits, "s", f"if({good_phone.format(national)}, {_refill('m', f'concat(substr(s, 1, {kept}), {moved})')}, null)")

    checked = f"lpad(cast(98 - {_let('''concat(p, substr(s, 1, 2), '00')''', 'z', _mod97('z'))} as string), 2, '0')"
    account = _let(_permute(key, "iban", "substr(s, 5)"), "p", f"concat(substr(s, 1, 2), {checked}, p)")
    iban = _let("replace(m, ' ', '')", "s", f"if({_let('concat(substr(s, 5), substr(s, 1, 4))', 'z', _mod97('z'))} = 1, "
                                            f"{_refill('m', account, '[A-Z0-9]')}, null)")

    email = f"concat({_permute(key, 'email', '''substring_index(m, '@', 1)''')}, '@', substring_index(m, '@', -1))"
    return {"date": f"case {' '.join(date)} end", "ssn": ssn, "ip": ip, "card": card, "phone": phone, "iban": iban, "email": email}


def _replaced(g: str, kinds: list[str], key: str) -> str:
    """The part ``g`` of a text with valid values replaced, and the list of them, as a struct."""
    how = _pseudonyms(key)
    # one entry for each character: the candidate which begins there, or an empty text
    places = ", ".join(f"regexp_extract_all({g}, {_sql(f'(?s)(?=(?<own>{PATTERNS[k]}))|.')}, 1)" for k in kinds)
    value = ", ".join(
        f"if(found[{n}][pos] = '', null, " + _let(f"found[{n}][pos]", "m", _let(
            how[k], "code", f"if(code is null, null, named_struct('pos', pos, 'len', length(m), 'kind', '{k}', 'pseudonym', code))")) + ")"
        for n, k in enumerate(kinds))
    values = _let(f"array({places})", "found", f"filter(transform(sequence(0, size(found[0]) - 1), pos -> coalesce({value})), v -> v is not null)")
    end = "coalesce(get(kept, {0}).pos + get(kept, {0}).len, 0)"
    kept = (f"aggregate({values}, cast(array() as array<struct<pos: int, len: int, kind: string, pseudonym: string>>), (kept, v) -> "
            f"if({end.format('size(kept) - 1')} <= v.pos, concat(kept, array(v)), kept))")
    before = end.format("y - 1")
    text = (f"concat(array_join(transform(kept, (v, y) -> concat(substr({g}, {before} + 1, v.pos - {before}), v.pseudonym)), ''), "
            f"substr({g}, {end.format('size(kept) - 1')} + 1))")
    listed = "transform(kept, v -> named_struct('kind', v.kind, 'pseudonym', v.pseudonym))"
    return _let(kept, "kept", f"named_struct('text', {text}, 'list', {listed})")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """Replace the valid personal numbers and dates of each whole text by pseudonyms under ``key``.

    Returns the columns of ``docs`` with the text replaced, and pseudonyms (array of kind and pseudonym in order
    of place), n_pseudonyms; input columns with these names are replaced.

    A null text stays null and has none, as have texts without candidates; candidates which are not valid stay as
    they are.  Of valid values which overlap the first counts, of those which start together the first kind.
    Equal values of one kind get equal pseudonyms in every row; separators, the country of telephone numbers and
    IBANs and the domain of addresses stay.  Time grows with the text; only within one part without a cut (white
    space beside small letters or punctuation) it grows with the square of the number of its values.
    """
    kinds = kinds or list(PATTERNS)
    numbers = [k for k in kinds if k != "email"]
    text = f"cast(`{text_col}` as string)"
    may = " or ".join(["{0} like '%@%'"] * ("email" in kinds) + ["{0} rlike '[0-9]'"] * bool(numbers))
    some = f"({may}) and (" + " or ".join(f"{{0}} rlike {_sql(PATTERNS[k]).replace('{', '{{').replace('}', '}}')}" for k in kinds) + ")"
    none = "named_struct('text', {0}, 'list', cast(array() as array<struct<kind: string, pseudonym: string>>))"
    parts = (f"if({some.format('__text')}, transform(split(__text, {_sql(CUT)}, -1), g -> if({some.format('g')}, {_replaced('g', kinds, key)}, "
             f"{none.format('g')})), array({none.format('__text')}))")
    new = ["pseudonyms", "n_pseudonyms"]
    coded = docs.drop(*new).withColumn("__text", F.expr(text)).withColumn("__parts", F.expr(parts))
    out = coded.withColumn(new[0], F.expr("flatten(transform(__parts, w -> w.list))")).withColumn(
        text_col, F.expr("if(__text is null, null, if(size(pseudonyms) = 0, __text, array_join(transform(__parts, w -> w.text), '')))"))
    return out.withColumn(new[1], F.size(new[0])).drop("__text", "__parts")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymize(docs.select("doc_id", "text"), key="corpus-1").select("doc_id", "text", "n_pseudonyms")
